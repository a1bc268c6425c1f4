"""The variables that datasets may hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Names, labels and colour maps of the known variables.
KNOWN = [
    ("thetao", "Potential Temperature", "cmo:thermal"),
    ("bottomT", "Sea water potential temperature at sea floor", "cmo:thermal"),
    ("thetao_mean", "Mean Sea water potential Temperature", "cmo:thermal"),
    ("to", "Observed Sea water potential Temperature", "cmo:thermal"),
    ("so", "Practical Salinity", "viridis"),
    ("o2", "Dissolved Oxygen", "cmo:deep"),
    ("chl", "Chlorophyll-a", "cmo:algae"),
    ("nppv", "Net Primary Production", "cmo:matter"),
    ("uo", "Zonal Velocity", "cmo:balance"),
    ("vo", "Meridional Velocity", "cmo:balance"),
    ("mlotst", "Mixed Layer Depth", "cmo:deep"),
    ("ph", "pH", "cmo:balance"),
    ("no3", "Nitrate", "cmo:matter"),
    ("po4", "Phosphate", "cmo:matter"),
    ("si", "Silicate", "cmo:matter"),
    ("B1c", "Aerobic and Anaerobic Bacteria carbon", "viridis"),
    ("B1n", "Aerobic and Anaerobic Bacteria nitrogen", "viridis"),
    ("B1p", "Aerobic and Anaerobic Bacteria phosphorous", "viridis"),
    ("P1c", "Diatoms Biomass_carbon", "cmo:matter"),
    ("P2c", "Flagellates Biomass_carbon", "cmo:matter"),
    ("P3c", "PicoPhytoplankton Biomass_carbon", "cmo:matter"),
    ("P4c", "Large Phytoplankton Biomass_carbon", "cmo:matter"),
    ("Z3c", "Carnivorous Mesozooplankton_carbon", "viridis"),
    ("Z4c", "Omnivorous Mesozooplankton_carbon", "viridis"),
    ("Z5c", "Microzooplankton_carbon", "viridis"),
    ("Z6c", "Heterotrophic Nanoflagellates", "viridis"),
    ("R1c", "Dissolved Organic Carbon", "cmo:matter"),
    ("R2c", "Semi-labile Dissolved Organic Carbon", "cmo:matter"),
    ("R3c", "Semi-refactory Dissolved Organic Carbon", "cmo:matter"),
    ("R6c", "Particulate Organic Carbon", "cmo:matter"),
]

# Label, unit and colour map of the variables that plots name in their own way.
PLOTTED = {
    "o2": ("Oxygen", "µmol/m³", "cmo:deep"),
    "chl": ("Chlorophyll-a", "mg/m³", "cmo:algae"),
    "nppv": ("Net Primary Production", "mg C/m²/day", "cmo:matter"),
    "thetao": ("Temperature", "°C", "coolwarm"),
    "so": ("Salinity", "PSU", "viridis"),
}


@dataclass(frozen=True)
class Variable:
    name: str
    label: str
    cmap: str = "viridis"


class Registry:
    """Variables by unique name."""

    def __init__(self) -> None:
        self._by_name: dict[str, Variable] = {}
        for v in KNOWN:
            self.add(Variable(*v))

    def add(self, variable: Variable) -> None:
        if variable.name in self._by_name:
            raise ValueError(f"there is a variable {variable.name} already")
        self._by_name[variable.name] = variable

    def get(self, name: str) -> Variable:
        if name not in self._by_name:
            raise ValueError(f"there is no variable {name}")
        return self._by_name[name]

    def check(self, names: list[str]) -> list[Variable]:
        """The variables of these names, each once; a name given twice or unknown is a ValueError."""
        if len(set(names)) != len(names):
            raise ValueError("a variable is given twice")
        return [self.get(n) for n in names]

    def all(self) -> list[Variable]:
        return list(self._by_name.values())


REGISTRY = Registry()


def plot_metadata(name: str, labelled: bool = False) -> dict[str, str]:
    """label, unit and cmap for a plot of the variable; a variable without its own has no unit, and its name as label.

    ``labelled``: for tables, whose label is the registry's, where the variable is known, without a unit."""
    if labelled:
        known = {v.name: v.label for v in REGISTRY.all()}
        return {"label": known.get(name, name), "unit": "", "cmap": "viridis"}
    return dict(zip(("label", "unit", "cmap"), PLOTTED.get(name, (name, "", "viridis"))))


def variables_table(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """name, label, cmap of the known variables (or of these), by name."""
    rows = REGISTRY.all() if names is None else [REGISTRY.get(n) for n in names]
    return spark.createDataFrame([(v.name, v.label, v.cmap) for v in rows], "name string, label string, cmap string").orderBy("name")
