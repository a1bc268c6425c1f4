"""Command line: reduce a collection by an analysis, ingest and resume collections, write the data of plots, list variables and providers."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from .frame import DIMS
from .functions.calendar import FREQUENCIES
from .operators.actions import ACTIONS, run_action
from .operators.domain import cut_to
from .operators.plotdata import MAP_AGGREGATES
from .session import session
from .sources.collection import Collection
from .sources.domains import read_domain
from .sources.plots import MODES, plot_data
from .sources.providers import available, ingest, provider_from, providers_table, resume
from .sources.sinks import write_ascii, write_ascii_compat, write_csv, write_geotiff, write_netcdf, write_parquet
from .sources.store import write_text
from .sources.variables import variables_table

SINKS = {"parquet": write_parquet, "csv": write_csv, "ascii": write_ascii, "ascii-compat": write_ascii_compat, "geotiff": write_geotiff, "netcdf": write_netcdf}


def _argument(text: str) -> tuple[str, object]:
    """name=value; a value that is JSON is read as such, one that is a date as midnight of that day."""
    name, _, value = text.partition("=")
    try:
        return name, json.loads(value)
    except ValueError:
        pass
    try:
        return name, datetime.strptime(value, "%Y-%m-%d")
    except ValueError:
        return name, value


def _day(text: str) -> datetime:
    return datetime.strptime(text, "%Y-%m-%d")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegrid", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("reduce", help="run an analysis on a collection and write its result")
    r.add_argument("action", choices=sorted(ACTIONS))
    r.add_argument("arguments", nargs="*", type=_argument, metavar="name=value")
    r.add_argument("--dataset", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--format", choices=sorted(SINKS), default="parquet")
    r.add_argument("--variables", nargs="+")
    r.add_argument("--domain", help="YAML file of a region (the collection's own, if not given)")
    c = sub.add_parser("ingest", help="make a collection from a provider")
    c.add_argument("--variables", nargs="+", required=True)
    c.add_argument("--frequency", choices=FREQUENCIES, required=True)
    c.add_argument("--start", type=_day, required=True)
    c.add_argument("--end", type=_day, required=True)
    c.add_argument("--split-by", choices=("month", "year"))
    for x in (c, sub.add_parser("resume", help="make the missing files of a collection")):
        x.add_argument("--dataset", required=True)
        x.add_argument("--provider", required=True, help="YAML file of a provider")
        x.add_argument("--domain", required=x is c, help="YAML file of a region" + ("" if x is c else " (the collection's own, if not given)"))
    g = sub.add_parser("plot", help="write the data of a plot, and its label, unit and colour map, as CSV and JSON")
    g.add_argument("mode", choices=MODES)
    g.add_argument("--input-file", required=True)
    g.add_argument("--variable", required=True)
    g.add_argument("--output-dir", required=True)
    for x in ("--start-date", "--end-date", "--time"):
        g.add_argument(x, type=_day)
    g.add_argument("--aggregation-dimension", choices=DIMS)
    g.add_argument("--aggregation-method", choices=sorted(MAP_AGGREGATES), default="mean")
    w = sub.add_parser("variables", help="list the known variables, or those that providers have")
    w.add_argument("--provider", nargs="+", help="YAML files of providers")
    w.add_argument("--frequency", choices=FREQUENCIES)
    s = sub.add_parser("providers", help="list what providers have")
    s.add_argument("configs", nargs="+")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session()
    if a.command == "reduce":
        made = Collection.load(a.dataset)
        frame = made.frame(spark, a.variables)
        frame = cut_to(frame, read_domain(a.domain)) if a.domain else made.inside(frame)
        SINKS[a.format](run_action(a.action, frame, **dict(a.arguments)), a.output)
    elif a.command == "ingest":
        ingest(spark, a.dataset, read_domain(a.domain), a.variables, a.frequency, a.start, a.end, provider_from(a.provider), a.split_by)
    elif a.command == "resume":
        region = read_domain(a.domain) if a.domain else Collection.load(a.dataset).region
        if region is None:
            raise SystemExit("the collection's catalogue names no region; give --domain")
        resume(spark, a.dataset, region, provider_from(a.provider), print)
    elif a.command == "plot":
        data, about = plot_data(spark, a.input_file, a.variable, a.mode, a.start_date, a.end_date, a.time, a.aggregation_dimension, a.aggregation_method)
        data.write.csv(f"{a.output_dir}/{a.variable}_{a.mode}", header=True)
        write_text(f"{a.output_dir}/{a.variable}_{a.mode}.json", json.dumps(about, ensure_ascii=False))
    elif a.command == "variables":
        if a.frequency and not a.provider:
            raise SystemExit("a frequency needs a provider")
        listed = available(spark, [provider_from(c) for c in a.provider], a.frequency) if a.provider else variables_table(spark)
        listed.show(1000, truncate=False)
    else:
        providers_table(spark, [provider_from(c) for c in a.configs]).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
