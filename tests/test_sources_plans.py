"""Sources, sinks, history, pipelines, workflows, extensions and streams."""

import json
import math
import shutil

import numpy as np
import pandas as pd
import pytest

import gridloom as gl
from gridloom import errors as er
from gridloom.functions.units import convert
from gridloom.plans import registry
from gridloom.streaming.passthrough import stream_grid


@pytest.fixture
def campaign(tmp_path):
    (tmp_path / "run_m01.csv").write_text('# taken on site\n alpha ,CT,note\n0,1,"a, b"\n1,,x\n')
    (tmp_path / "run_m02.csv").write_text("alpha,CT,V\n0,5,9\n1,7\n")
    return tmp_path


def test_csv_files_and_folders(spark, campaign):
    with pytest.raises(er.DataError, match="hold text"):
        gl.load(campaign / "run_m01.csv", dims=["alpha"])
    one = gl.load(campaign / "run_m01.csv", dims=["alpha", "note"])
    assert one.dim("note").coords == ("a, b", "x") and one.to_pandas().shape == (4, 3)
    two = gl.load(campaign / "run_m02.csv", dims=["alpha"])
    assert two.to_numpy()["CT"].tolist() == [5, 7] and math.isnan(two.to_numpy()["V"][1])
    folder = gl.load(campaign, pattern="run_m02*")
    assert folder.is_datapoint and list(folder.vars) == ["alpha", "CT", "V"]
    assert gl.load(campaign, pattern=r"run_m0[2]\.csv").cells.count() == 2
    with pytest.raises(er.DataError):
        gl.load(campaign, pattern="nothing*")
    (campaign / "wide.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(er.DataError, match="more than the header"):
        gl.load(campaign / "wide.csv")
    (campaign / "twice.csv").write_text("a,a\n1,2\n")
    with pytest.raises(er.DuplicateNameError):
        gl.load(campaign / "twice.csv")
    (campaign / "odd.csv").write_text('a,b\n"1",1_0\n"2\n",inf\n#3,nan\n')
    with pytest.raises(er.DataError, match="hold text"):
        gl.load(campaign / "odd.csv")


def test_declared_coordinates(spark, tmp_path):
    for m, v in ((1, 5), (2, 6)):
        (tmp_path / f"m{m}.csv").write_text(f"alpha,CT\n0,{v}\n1,{v + 1}\n")
    g = gl.load({(0.1, "*"): str(tmp_path / "m1.csv"), (0.2, "*"): str(tmp_path / "m2.csv")}, dims=["mach", "alpha"])
    assert g.shape == (2, 2) and g.to_numpy()["CT"].tolist() == [[5, 6], [6, 7]]
    made = json.loads(g.manifest(tmp_path / "m.json").read_text())
    assert made["files"][0]["coordinates"] == {"mach": 0.1}
    assert "mach" in g.manifest(tmp_path / "m.csv").read_text()
    with pytest.raises(er.LoadCoordinateError):
        gl.load({(0.1,): str(tmp_path / "m1.csv")}, dims=["mach", "alpha"])
    with pytest.raises(er.DuplicateNameError):
        gl.load({(0.1, 3): str(tmp_path / "m1.csv")}, dims=["mach", "alpha"])


def test_other_sources(spark, tmp_path):
    pdf = pd.DataFrame({"a": [0, 1], "v": [1.5, 2.5]})
    assert gl.load(pdf).pivot(["a"]).to_numpy()["v"].tolist() == [1.5, 2.5]
    df = spark.createDataFrame([(0, "x", 1.0), (1, "y", None)], "a int, s string, v double")
    g = gl.load(df, dims=["s"])
    assert g.dim("s").coords == ("x", "y") and math.isnan(g.to_numpy()["v"][1])
    df.drop("s").write.parquet(f"{tmp_path}/t.parquet")
    assert gl.load(f"{tmp_path}/t.parquet", dims=["a"]).shape == (2,)
    for bad in (3, "nowhere.csv", tmp_path / "t.txt"):
        with pytest.raises(er.DataError):
            gl.load(bad)
    with pytest.raises(er.DataError):
        gl.load(np.zeros((2, 2)))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"k{i % 3}", float(i), 2.0 * i) for i in range(9)], "a int, k string, v double, w double").write.parquet(f"{tmp_path}/t.parquet")
    g = gl.load(f"{tmp_path}/t.parquet", dims=["a", "k"]).select({"a": [1, 4], "k": "k1"}).compute("z = v * 2")
    plan = g.cells.select("a", "z")._jdf.queryExecution().executedPlan().toString()
    assert "In(a, [1,4])" in plan and "EqualTo(k,k1)" in plan and "ReadSchema: struct<a:int,k:string,v:double>" in plan
    zero = gl.load(spark.createDataFrame([(-0.0, 1.0), (1.0, 2.0)], "x double, v double"), dims=["x"])
    assert zero.dim("x").coords == (0.0, 1.0) and zero.at(x=0).to_numpy()["v"].tolist() == [1.0]
    with pytest.raises(er.DataError):
        gl.load(spark.createDataFrame([(None, 1.0)], "x double, v double"), dims=["x"])


@pytest.fixture(scope="module")
def grid(spark):
    rows = [[m, a, 0.1 + m + a] for m in (0.1, 0.2) for a in (0.0, 2.0) if (m, a) != (0.2, 2.0)]
    return gl.load(np.array(rows), names=["mach", "alpha", "CT"], version="v1", user="me").pivot(["mach", "alpha"])


def test_exports(grid, tmp_path):
    text = grid.to_csv(tmp_path / "o.csv").read_text().splitlines()
    body = [x for x in text if not x.startswith("#")]
    assert body[0] == "mach,alpha,CT" and body[-1] == "0.2,2.0," and any("pivot" in x for x in text)
    files = grid.to_csv(tmp_path / "s.csv", split_by="mach")
    assert [f.name for f in files] == ["s_mach_0p1.csv", "s_mach_0p2.csv"]
    made = json.loads(grid.set_uncertainty({"CT": 0.3}).set_uncertainty({"CT": 0.4}, component="random").to_json(tmp_path / "o.json").read_text())
    assert made["variables"]["CT"]["values"][1][1] is None and made["uncertainty"]["variables"]["CT"]["combined"][0][0] == pytest.approx(0.5)
    arrays, dims = grid.to_numpy(return_dims=True)
    assert arrays["CT"].shape == (2, 2) and dims["alpha"].tolist() == [0, 2] and not arrays["CT"].flags.writeable
    grid.to_parquet(f"{tmp_path}/p")
    summary = grid.summary()
    assert summary.variables["CT"]["max"] == pytest.approx(2.2) and summary.shape == (2, 2)
    report = grid.diagnostics(tmp_path / "d.csv")
    assert report.variables["CT"]["missing"] == 1 and (tmp_path / "d.csv").read_text().startswith("variable")


def test_distributed_exports(spark, grid, tmp_path):
    folder = grid.to_csv(f"{tmp_path}/parts", distributed=True)
    back = spark.read.option("header", True).schema("mach double, alpha double, CT double").csv(folder)
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(0.1, 0.0, 0.2), (0.1, 2.0, 2.2), (0.2, 0.0, 0.30000000000000004), (0.2, 2.0, None)], key=str)
    assert "pivot" in (tmp_path / "parts" / "_banner.txt").read_text()
    split = grid.to_csv(f"{tmp_path}/split", distributed=True, split_by="mach")
    assert sorted(p.name for p in (tmp_path / "split").glob("mach=*")) == ["mach=0.1", "mach=0.2"] and split.endswith("split")
    lines = spark.read.json(grid.to_json(f"{tmp_path}/lines", distributed=True))
    assert lines.count() == 4 and lines.where("CT is null").count() == 1
    with pytest.raises(er.DimensionError):
        grid.to_csv(f"{tmp_path}/none", distributed=True, split_by="nothing")


def test_modes(grid, tmp_path):
    draft = grid.demote(comment="trial")
    quiet = draft.compute("z = CT * 2")
    assert len(quiet.history) == len(draft.history) and len(draft.compute("z = CT", history=True).history) == len(draft.history) + 1
    with pytest.raises(er.ExportError):
        quiet.to_csv(tmp_path / "x.csv")
    with pytest.warns(UserWarning):
        quiet.to_pandas()
    assert quiet.to_csv(tmp_path / "x.csv", allow_draft=True).read_text().startswith("# DRAFT")
    assert quiet.promote().mode == "production"
    with pytest.raises(er.ModeError):
        grid.promote()
    with pytest.raises(er.CombineError):
        grid.combine(draft, op="sum")
    gl.set_mode("draft")
    gl.set_user("someone")
    try:
        made = gl.load(np.zeros((1, 1)), names=["a"])
        assert made.mode == "draft" and made.provenance.user == "someone"
    finally:
        gl.set_mode("production")
        gl.set_user(None)


def test_state_hash(grid):
    shuffled = gl.load(np.array([[0.2, 0.0, 0.3], [0.1, 2.0, 2.2], [0.1, 0.0, 0.2]]), names=["mach", "alpha", "CT"]).pivot(["mach", "alpha"])
    plain = gl.load(np.array([[0.1, 0.0, 0.2], [0.1, 2.0, 2.2], [0.2, 0.0, 0.3]]), names=["mach", "alpha", "CT"]).pivot(["mach", "alpha"])
    assert plain.state_hash == shuffled.state_hash == plain.densified().state_hash
    assert plain.state_hash != plain.set_metadata({"CT": {"unit": "N"}}).state_hash
    zero = lambda x: gl.load(np.array([[x]]), names=["v"]).state_hash
    assert zero(0.0) != zero(-0.0) and zero(float("nan")) == zero(-float("nan"))


def test_archive(grid, tmp_path):
    full = grid.set_uncertainty({"CT": "5%"}).compute("z = 2 * CT").register_axis(gl.Axis("t", rotation_matrix=np.eye(3))).set_metadata({"alpha": {"unit": "deg"}}).interpolate({"alpha": [0, 1]})
    full.save(tmp_path / "a")
    back = gl.open(tmp_path / "a")
    assert back.state_hash == full.state_hash and back.dimensions == full.dimensions and back.vars == dict(full.vars) and back.roots == dict(full.roots)
    assert [e.operation for e in back.history] == [e.operation for e in full.history]
    with pytest.raises(er.ExportError):
        full.save(tmp_path / "a")
    for member, change in (("history.json", lambda t: t.replace("z = 2", "z = 3")), ("frame.json", lambda t: t.replace('"deg"', '"rad"'))):
        shutil.copytree(tmp_path / "a", tmp_path / "b")
        (tmp_path / "b" / f".{member}.crc").unlink(missing_ok=True)
        path = tmp_path / "b" / member
        path.write_text(change(path.read_text()))
        with pytest.raises(er.IntegrityError):
            gl.open(tmp_path / "b")
        shutil.rmtree(tmp_path / "b")
    full.compute("z = 3 * CT").cells.sparkSession.read.parquet(f"{tmp_path}/a/cells").limit(1).write.parquet(f"{tmp_path}/other")
    shutil.copytree(tmp_path / "a", tmp_path / "b")
    shutil.rmtree(tmp_path / "b" / "cells")
    shutil.copytree(tmp_path / "other", tmp_path / "b" / "cells")
    with pytest.raises(er.IntegrityError, match="cells"):
        gl.open(tmp_path / "b")
    with pytest.raises(er.DataError):
        gl.open(tmp_path / "none")


def test_pipelines(grid, tmp_path):
    done = grid.set_uncertainty({"CT": 0.1}).compute("z = 2*CT", comment="double").select({"alpha": 0}).set_correlation({("CT", "z"): 0.5}).register_axis(gl.Axis("t", rotation_matrix=np.eye(3)))
    steps = done.history.to_pipeline()
    again = gl.load_pipeline(steps.save(tmp_path / "p.json")).apply(grid)
    assert len(steps) == 5 and again.state_hash == done.state_hash
    with pytest.raises(er.PipelineError):
        done.combine(done, op="sum").history.to_pipeline()
    with pytest.raises(er.PipelineError):
        done.history.to_pipeline(1, 99)
    (tmp_path / "p.json").write_text((tmp_path / "p.json").read_text().replace("2*CT", "3*CT"))
    with pytest.raises(er.IntegrityError):
        gl.load_pipeline(tmp_path / "p.json")


FILE = """
[meta]
name = "balance"
version = "2"
[constants]
S = 2.0
k = -1.5
[uncertainties]
FZ = "1%"
CL = 0.01
[equations]
q = "0.5 * rho * V**2"
CL = "FZ / (q * S)"
[corrections]
CL = "CL + k * 0"
"""


def test_workflow(spark, tmp_path):
    path = tmp_path / "w.toml"
    path.write_text(FILE)
    g = gl.load(np.array([[0, 10.0, 2.0, 1.2], [1, 12, 2, 1.2]]), names=["a", "FZ", "V", "rho"]).pivot(["a"])
    run = gl.processor(path, config={"S": 4.0})
    assert run.required == ["V", "rho", "FZ"] and run.name == "balance"
    run.info()
    out = run(g, comment="first")
    assert out.to_numpy()["CL"].tolist() == pytest.approx([10 / (0.5 * 1.2 * 4) / 4, 12 / (0.5 * 1.2 * 4) / 4])
    assert out.vars["CL"].sys and [e.comment for e in out.history][-1] == "pproc balance v2: first"
    with pytest.raises(er.WorkflowError):
        run(out)
    with pytest.warns(UserWarning):
        run(out.drop_correlation(), force=True)
    with pytest.raises(er.WorkflowError):
        gl.processor(path, config={"T": 1.0})
    with pytest.raises(er.WorkflowError):
        run(g.compute("S = 1"))
    with pytest.raises(er.WorkflowError):
        run(g, report="x")
    bad = {
        "unknown": FILE + "[other]\n", "no meta": "[equations]\na = '1'\n", "cycle": "[meta]\n[equations]\na = 'b'\nb = 'a'\n", "self": "[meta]\n[equations]\na = 'a + 1'\n",
        "forward": "[meta]\n[equations]\na = 'b'\nb = 'c'\n", "constant": "[meta]\n[constants]\nc = inf\n[equations]\na = 'c'\n", "target": "[meta]\n[constants]\nc = 1\n[equations]\nc = '2'\n",
    }
    for text in bad.values():
        path.write_text(text)
        with pytest.raises(er.GridError):
            gl.processor(path)
    path.write_text(bad["forward"])
    assert [x.target for x in gl.processor(path, auto_sort=True).spec.lines] == ["b", "a"]


def test_extensions(grid):
    @gl.register_accessor("shapes")
    class Shapes:
        def __init__(self, g):
            self.g = g

        def count(self):
            return len(self.g.dims)

    assert grid.shapes.count() == 2 and grid.shapes is grid.shapes
    for name in ("select", "shapes", "not a name"):
        with pytest.raises(er.RegistryError):
            gl.register_accessor(name)(Shapes)
    with pytest.raises(AttributeError):
        grid.nothing  # noqa: B018

    class Run:
        name, version = "r", "1"

        def validate(self, g):
            pass

        def info(self):
            pass

        def __call__(self, g, **kwargs):
            return g.compute("w = CT + 1")

    gl.register_processor("runner", Run)
    try:
        assert "w" in gl.processor("runner")(grid).vars and gl.registered_processors() == ["runner"]
        with pytest.raises(er.RegistryError):
            gl.register_processor("runner", Run)
        gl.register_processor("wrong", dict)
        with pytest.raises(er.RegistryError):
            gl.processor("wrong")
    finally:
        registry._processors.clear()
    with pytest.raises(er.RegistryError):
        gl.processor("runner")


def test_units():
    assert convert(1.0, "ft", "m") == 0.3048 and convert(212.0, "F", "C") == pytest.approx(100) and convert(180.0, "deg", "rad") == pytest.approx(math.pi)
    with pytest.raises(er.DataError):
        convert(1.0, "m", "s")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, f"2024-01-01 00:0{i}:00", float(i)) for i in range(6)], "id int, at string, v double").selectExpr("id", "cast(at as timestamp) as at", "v").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id int, at timestamp, v double").parquet(f"{tmp_path}/in")
    g = stream_grid(source, ["v"]).set_uncertainty({"v": "10%"}).compute("w = 2*v + 1", where="v > 1")
    query = g.frame.writeStream.format("memory").queryName("rows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    rows = {r.id: r for r in spark.table("rows").collect()}
    assert rows[5].w == 11 and rows[5].u_sys__w == pytest.approx(1.0) and math.isnan(rows[0].w)
    for call in ("average", "smooth", "interpolate", "fill"):
        with pytest.raises(er.StreamingError):
            getattr(stream_grid(source, ["v"]), call)("v")
    with pytest.raises(er.StreamingError):
        stream_grid(source, ["v"]).compute("m = np.mean(v)")
    means = stream_grid(source, ["v"]).windowed_average("at", "2 minutes", "1 minute")
    query = means.writeStream.format("memory").queryName("means").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.v for r in spark.table("means").collect()) == [0.5, 2.5, 4.5]
