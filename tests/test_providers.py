import io
import tarfile

import pandas as pd
import pytest

from tests.grids import DEPTHS, LATS, LONS, TIMES, values
from tidegrid.operators.domain import RectangularDomain
from tidegrid.sources.providers import ingest, provider_from, providers_table, read_config, resume

BOX = RectangularDomain("Box", (42.0, 44.0), (30.0, 31.0), (0.0, 3.0))
CONFIG = "name: test\nkind: {kind}\nsource: {source}\nvariables:\n- variable: thetao\n  dataset_name: set-t\n  unit: C\nfrequencies:\n- frequency: daily\n  variables: [thetao]\n  path: day\n"


def _member(data, t):
    rows = [(d, DEPTHS[d], y, LATS[y], x, LONS[x], float(data[0][t, d, y, x])) for d in range(3) for y in range(4) for x in range(5)]
    raw = io.BytesIO()
    pd.DataFrame(rows, columns=["depth_idx", "depth", "lat_idx", "latitude", "lon_idx", "longitude", "thetao"]).to_parquet(raw)
    return f"ave.{TIMES[t]:%Y%m%d-%H:%M:%S}.thetao.parquet", raw.getvalue()


@pytest.fixture
def configs(tmp_path):
    data = values()
    (tmp_path / "in" / "day" / "2025").mkdir(parents=True)
    with tarfile.open(tmp_path / "in" / "day" / "set-t.tar", "w") as tar:
        for t in range(2):
            name, raw = _member(data, t)
            (tmp_path / "in" / "day" / "2025" / name).write_bytes(raw)
            info = tarfile.TarInfo(name)
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    for kind in ("local", "tar"):
        (tmp_path / f"{kind}.yaml").write_text(CONFIG.format(kind=kind, source=tmp_path / "in"))
    return tmp_path


@pytest.mark.parametrize("kind", ["local", "tar"])
def test_ingest_and_resume(spark, configs, kind):
    provider = provider_from(configs / f"{kind}.yaml")
    made = ingest(spark, configs / kind, BOX, ["thetao"], "daily", TIMES[0], TIMES[1], provider)
    frame = made.frame(spark)
    data = values()[0][:, :2, :3, :3]
    got = {(r["time"], r["depth_idx"], r["lat_idx"], r["lon_idx"]): r["thetao"] for r in frame.table().collect()}
    assert len(got) == data.size and all(v is None or v == data[TIMES.index(t), d, y, x] for (t, d, y, x), v in got.items())
    assert made.axes == {"depth": DEPTHS[:2], "latitude": LATS[:3], "longitude": LONS[:3]}
    with pytest.raises(FileExistsError):
        ingest(spark, configs / kind, BOX, ["thetao"], "daily", TIMES[0], TIMES[1], provider)
    path = configs / kind / made.files["thetao"][0].path
    (path / "_SUCCESS").unlink()
    said = []
    again = resume(spark, configs / kind, RectangularDomain("Box", (42.0, 44.0), (30.0, 31.0), (0.0, 1.0)), provider, said.append)
    assert (path / "_SUCCESS").exists() and again.frame(spark).table().where("depth > 1").count() == 0 and not said
    with pytest.raises(ValueError):
        ingest(spark, configs / "other", BOX, ["so"], "daily", TIMES[0], TIMES[1], provider)


def test_configs_are_checked(spark, configs):
    assert providers_table(spark, [provider_from(configs / "tar.yaml")]).count() == 1
    good = (configs / "tar.yaml").read_text()
    for i, bad in enumerate([good.replace("kind: tar", "kind: web"), good.replace("source:", "sauce:"), good.replace("frequency: daily", "frequency: hourly"), good.replace("[thetao]", "[so]"), good.replace("variable: thetao", "variable: nothing")]):
        (configs / f"{i}.yaml").write_text(bad)
        with pytest.raises(ValueError):
            read_config(configs / f"{i}.yaml")


def test_command_line(spark, configs, capsys):
    from tidegrid.__main__ import main

    (configs / "box.yaml").write_text("name: Box\ngeometry:\n  type: rectangle\n  min_latitude: 42\n  max_latitude: 44\n  min_longitude: 30\n  max_longitude: 31\n")
    common = ["--provider", str(configs / "local.yaml"), "--domain", str(configs / "box.yaml"), "--dataset", str(configs / "made")]
    assert main(["ingest", *common, "--variables", "thetao", "--frequency", "daily", "--start", "2025-01-01", "--end", "2025-01-02"]) == 0
    assert main(["resume", *common]) == 0 and main(["resume", "--provider", common[1], "--dataset", common[5]]) == 0
    out = str(configs / "out")
    assert main(["reduce", "reduce_axes", 'axes=["depth"]', "operator=max", "depth_max=2.0", "--dataset", str(configs / "made"), "--output", out, "--format", "csv"]) == 0
    back = spark.read.csv(out, header=True)
    assert back.columns == ["time", "latitude", "longitude", "thetao"] and back.count() == 18
    assert main(["variables"]) == 0 and main(["providers", str(configs / "tar.yaml")]) == 0
    assert "Potential Temperature" in capsys.readouterr().out
