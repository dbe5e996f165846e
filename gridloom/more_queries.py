"""More registered queries: sources, sinks, refusals, functions, higher degrees, extensions."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import Axis, Grid, errors, load, load_pipeline, processor, register_processor, set_user
from .plans import registry
from .queries import _DET, _SUMS, STENCIL, _f1, _f3, _r, _table, daily, parts, query, rows, shipments, vectors


def priorities(spark: SparkSession, sf: str) -> Grid:
    """Mean price of orders by the remainder of the customer and priority: every cell is there."""
    t = _table(spark, sf, "orders")
    df = t.groupBy((F.col("o_custkey") % 12).cast("double").alias("x"), F.col("o_orderpriority").alias("pr")).agg(F.avg(F.col("o_totalprice") / 1000).alias("v"))
    return load(df, dims=["x", "pr"])


F6 = "f6 AS (SELECT (o_custkey % 12)::DOUBLE AS x, o_orderpriority AS pr, avg(o_totalprice / 1000) AS v FROM orders GROUP BY 1, 2)"
_X = np.arange(12.0)


def _weighted(weights: np.ndarray, targets, name: str = "x", value: str = "v") -> str:
    """SQL: weights[i, j] of source j in target i, over the complete lines of f6."""
    table = ", ".join(f"({t!r}, {s!r}::DOUBLE, {w!r}::DOUBLE)" for t, row in zip(targets, weights.tolist(), strict=True) for s, w in zip(_X.tolist(), row, strict=True))
    return f"WITH {F6} SELECT w.t AS {name}, pr, round(sum(f6.v * w.w), 6) AS {value} FROM f6 JOIN (VALUES {table}) AS w(t, s, w) ON w.s = f6.x GROUP BY 1, 2"


def _moving(window: int, deg: int, slope: bool) -> np.ndarray:
    """Weights of moving fits, window by window, by least squares."""
    out = np.zeros((12, 12))
    for i in range(12):
        lo = min(max(0, i - window // 2), 12 - window)
        fit = np.linalg.lstsq(np.vander(_X[lo : lo + window] - _X[i], deg + 1, increasing=True), np.eye(window), rcond=None)[0]
        out[i, lo : lo + window] = fit[1 if slope else 0]
    return out


def _smoothing(s: float) -> np.ndarray:
    """The spline that minimises squared distance plus s times squared curvature, from its penalty on a fine grid of values."""
    second = np.zeros((10, 12))
    for i in range(10):
        second[i, i : i + 3] = 1.0, -2.0, 1.0
    gram = np.diag(np.full(10, 2.0 / 3.0)) + np.diag(np.full(9, 1.0 / 6.0), 1) + np.diag(np.full(9, 1.0 / 6.0), -1)
    return np.linalg.solve(np.eye(12) + s * second.T @ np.linalg.inv(gram) @ second, np.eye(12))


# ---------------------------------------------------------------------- smoothing, fits, translation


@query(_weighted(_smoothing(2.0), _X.tolist()))
def smooth_spline(spark, sf):
    return rows(priorities(spark, sf).smooth(along="x", method="spline", smoothing=2.0), "v")


@query(_f3(f"SELECT ct AS t, type, round((y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / {_DET}, 6) AS v FROM m", STENCIL, _SUMS))
def smooth_savgol_deg2(spark, sf):
    return rows(daily(spark, sf).smooth(along="t", method="savgol", window=5, polyorder=2), "v")


@query(_weighted(_moving(7, 3, False), _X.tolist()))
def smooth_savgol_deg3(spark, sf):
    return rows(priorities(spark, sf).smooth(along="x", method="savgol", window=7, polyorder=3), "v")


@query(_weighted(_moving(7, 3, True), _X.tolist(), value="dv_dx"))
def diff_deg3(spark, sf):
    return rows(priorities(spark, sf).diff(along="x", window=7, deg=3), "dv_dx")


@query(_weighted(_moving(5, 2, True), _X.tolist(), value="dv_dx"))
def diff_shorthand(spark, sf):
    return rows(priorities(spark, sf).d["x"], "dv_dx")


@query(_weighted(np.linalg.lstsq(np.vander(_X, 4, increasing=True), np.eye(12), rcond=None)[0], [f"x^{k}" for k in range(4)], "x_coef"))
def fitmodel_deg3(spark, sf):
    return rows(priorities(spark, sf).fitmodel(along="x", deg=3), "v")


@query(_weighted(np.vander([0.5, 7.25, 12.0], 4, increasing=True) @ np.linalg.lstsq(np.vander(_X, 4, increasing=True), np.eye(12), rcond=None)[0], [0.5, 7.25, 12.0]))
def interpolate_polyfit3(spark, sf):
    return rows(priorities(spark, sf).interpolate({"x": [0.5, 7.25, 12.0]}, method="polyfit", deg=3), "v")


@query(
    _f3(
        "SELECT q.n, type, round(regr_intercept(v, f3.n) + regr_slope(v, f3.n) * q.n, 6) AS v FROM f3, (VALUES (0.5::DOUBLE), (40.5::DOUBLE), (97.5::DOUBLE)) AS q(n) GROUP BY q.n, type"
    )
)
def axis_translate_polyfit(spark, sf):
    return rows(daily(spark, sf).interpolate({"n": [0.5, 40.5, 97.5]}, method="polyfit", deg=1, axisTranslation={"from": "t", "to": "n"}), "v")


@query(_f3("SELECT q.n, type, round(arg_min(v, abs(f3.n - q.n) + t * 1e-9), 6) AS v FROM f3, (VALUES (0.25::DOUBLE), (40.3::DOUBLE), (97.3::DOUBLE)) AS q(n) GROUP BY q.n, type"))
def axis_translate_nearest(spark, sf):
    return rows(daily(spark, sf).interpolate({"n": [0.25, 40.3, 97.3]}, method="nearest", axisTranslation={"from": "t", "to": "n"}), "v")


_WINDOW9 = """d AS (SELECT s.size, s.i, s.m, b.brand, f2.retail FROM (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT size FROM f2)) s
  CROSS JOIN (SELECT DISTINCT brand FROM f2) b LEFT JOIN f2 ON f2.size = s.size AND f2.brand = b.brand),
w AS (SELECT g.size AS ct, g.brand AS type, p.size - g.size AS z, p.retail AS v FROM d g JOIN d p ON p.brand = g.brand AND p.i >= greatest(0, g.i - 4) AND p.i < greatest(0, g.i - 4) + 9
  WHERE g.retail IS NULL AND p.retail IS NOT NULL)"""


@query(
    "WITH f2 AS (SELECT p_size::DOUBLE AS size, p_brand AS brand, avg(p_retailprice) AS retail FROM part GROUP BY 1, 2), " + _WINDOW9 + ", " + _SUMS + f"""
SELECT size, brand, round(1.23e-7 + coalesce(retail, CASE WHEN s0 > 2 THEN (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / {_DET} END), 6) AS retail,
  CASE WHEN retail IS NULL AND s0 > 2 THEN 1 ELSE 0 END AS tag__retail FROM d LEFT JOIN m ON m.ct = d.size AND m.type = d.brand"""
)
def fill_polyfit(spark, sf):
    g = parts(spark, sf).fill("size", method="polyfit", deg=2, window=9)
    # Prices are decimal, so fits can end in a 5 exactly; the shift keeps such ties off the rounding.
    return g.cells.select("size", "brand", _r(F.col("retail") + F.lit(1.23e-7)).alias("retail"), g.tag_column("retail").cast("int").alias("tag__retail"))


# ---------------------------------------------------------------------- functions


def _customers(spark, sf) -> Grid:
    return load(_table(spark, sf, "customer").select(F.col("c_custkey").cast("double"), (F.col("c_acctbal") / 10000).alias("a"), (F.col("c_nationkey") - 12).cast("double").alias("b")))


def _c(select: str) -> str:
    return f"WITH c AS (SELECT c_custkey::DOUBLE AS c_custkey, c_acctbal / 10000 AS a, (c_nationkey - 12)::DOUBLE AS b FROM customer) SELECT c_custkey, {select} FROM c"


@query(_c("round(pi() * a * a + exp(1) * b, 6) AS r"))
def compute_constants(spark, sf):
    return rows(_customers(spark, sf).compute("r = pi * a**2 + e * b"), "c_custkey", "r")


@query(_c("CASE WHEN abs(a) <= 1 THEN round(asin(a) - acos(a), 6) END AS r, round(atan(a * b) + abs(b) - abs(-a), 6) AS s"))
def compute_inverse_trig_abs(spark, sf):
    return rows(_customers(spark, sf).compute("r = asin(a) - acos(a)").compute("s = atan(a * b) + abs(b) - abs(-a)"), "c_custkey", "r", "s")


@query(
    _c(
        """round(sin(a) + sqrt(abs(b)) + log10(abs(a) + 1), 6) AS alias_,
        floor(a * 10) + ceil(a * 3) + sign(b) AS steps, round(a * a + cbrt(b) + sqrt(a * a + b * b) + pow(2, a) + log2(abs(b) + 1) + ln(1 + abs(a)) + exp(a) - 1, 6) AS powers,
        round((exp(a) - exp(-a)) / 2 + (exp(a) + exp(-a)) / 2 + tanh(a) + radians(b) + degrees(a), 6) AS curves,
        least(greatest(b, -3), 4) + CASE WHEN b > 0 THEN a ELSE -a END + greatest(a, b) - least(a, b) + (b - 5 * floor(b / 5)) AS picks"""
    ).replace("AS picks", "AS picks0").join(("SELECT c_custkey, alias_, steps, powers, curves, round(picks0, 6) AS picks FROM (", ")"))
)
def compute_np_functions(spark, sf):
    g = _customers(spark, sf)
    g = g.compute("alias_ = np.sin(a) + np.sqrt(np.abs(b)) + np.log10(np.absolute(a) + 1)")
    g = g.compute("steps = np.floor(a * 10) + np.ceil(a * 3) + np.sign(b)")
    g = g.compute("powers = np.square(a) + np.cbrt(b) + np.hypot(a, b) + np.exp2(a) + np.log2(abs(b) + 1) + np.log1p(abs(a)) + np.expm1(a)")
    g = g.compute("curves = np.sinh(a) + np.cosh(a) + np.tanh(a) + np.deg2rad(b) + np.rad2deg(a)")
    g = g.compute("picks = np.clip(b, -3, 4) + np.where(np.maximum(np.sign(b), 0), a, -a) + np.maximum(a, b) - np.minimum(a, b) + np.mod(b, 5)")
    return rows(g, "c_custkey", "alias_", "steps", "powers", "curves", "picks")


# ---------------------------------------------------------------------- refusals


def _refused(spark: SparkSession, calls: dict) -> DataFrame:
    """What each call raises, by name."""
    found = []
    for name, call in calls.items():
        try:
            call()
            found.append((name, "none"))
        except errors.GridError as e:
            found.append((name, type(e).__name__))
    return spark.createDataFrame(found, "refused string, error string")


def _refusals(**cases: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in cases.items()) + ") AS r(refused, error)"


@query(_refusals(absent="DimensionNotFoundError", text="NonNumericDimensionError", repeated="DimensionError", interpolated="UncertaintyLineageError", twice="none"))
def refuse_reductions(spark, sf):
    g = priorities(spark, sf)
    points = g.set_uncertainty({"v": 0.1}, component="random").interpolate({"x": [0.5, 1.5]})
    return _refused(
        spark,
        {
            "absent": lambda: g.average("nowhere"),
            "text": lambda: g.integrate("v", over="pr"),
            "repeated": lambda: g.average(["x", "x"]),
            "interpolated": lambda: points.average("x"),
            "twice": lambda: g.average(["x", "pr"]),
        },
    )


@query(_refusals(method="GridError", needed="GridError", unused="GridError", window="DegreeError", order="DegreeError", text="NonNumericDimensionError", uncertain="UncertaintyError", negative="GridError"))
def refuse_smoothing(spark, sf):
    g = priorities(spark, sf)
    return _refused(
        spark,
        {
            "method": lambda: g.smooth(along="x", method="wavelet", window=3),
            "needed": lambda: g.smooth(along="x", method="moving_avg"),
            "unused": lambda: g.smooth(along="x", method="moving_avg", window=3, smoothing=1.0),
            "window": lambda: g.smooth(along="x", method="moving_avg", window=0),
            "order": lambda: g.smooth(along="x", method="savgol", window=3, polyorder=3),
            "text": lambda: g.smooth(along="pr", method="moving_avg", window=3),
            "uncertain": lambda: g.set_uncertainty({"v": 0.1}).smooth(along="x", method="moving_avg", window=3),
            "negative": lambda: g.smooth(along="x", method="spline", smoothing=-1.0),
        },
    )


@query(_refusals(stepwise="UncertaintyLineageError", once="none", impossible="CorrelationError", beyond="CorrelationError", unknown="VariableError", component="UncertaintyError"))
def refuse_uncertainty(spark, sf):
    g = shipments(spark, sf).set_uncertainty({"price": 1.0, "qty": 1.0, "disc": 0.1})
    impossible = {("price", "qty"): -0.9, ("price", "disc"): -0.9, ("qty", "disc"): -0.9}
    return _refused(
        spark,
        {
            "stepwise": lambda: g.compute("a = 3 * price").compute("r = a - 2 * price"),
            "once": lambda: g.compute("r = 3 * price - 2 * price"),
            "impossible": lambda: g.set_correlation(impossible),
            "beyond": lambda: g.set_correlation({("price", "qty"): 1.5}),
            "unknown": lambda: g.set_uncertainty({"nothing": 1.0}),
            "component": lambda: g.set_uncertainty({"price": 1.0}, component="other"),
        },
    )


@query(_refusals(name="VariableError", function="EquationError", call="EquationError", arity="EquationError", keyword="EquationError", syntax="EquationError", attribute="EquationError"))
def refuse_equations(spark, sf):
    g = shipments(spark, sf)
    return _refused(
        spark,
        {
            "name": lambda: g.compute("r = nothing + 1"),
            "function": lambda: g.compute("r = gamma(price)"),
            "call": lambda: g.compute("r = price.sum()"),
            "arity": lambda: g.compute("r = sqrt(price, qty)"),
            "keyword": lambda: g.compute("r = np.mean(a=price)"),
            "syntax": lambda: g.compute("r = price +"),
            "attribute": lambda: g.compute("r = price.real"),
        },
    )


@query(_refusals(column="DuplicateNameError", duplicate="PivotDuplicateError", expand="DataError", path="DataError", kind="DataError", dims="DataError", overlap="ConcatOverlapError", selection="SelectionError"))
def refuse_sources(spark, sf):
    t = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("double").alias("k"), F.col("n_regionkey").cast("double").alias("r"))
    g = load(t, dims=["k"])
    from . import concat

    return _refused(
        spark,
        {
            "column": lambda: load(t.select("k", F.col("r").alias("k"))),
            "duplicate": lambda: load(t.select("r", F.col("k").alias("v")), dims=["r"]).cells.count(),
            "expand": lambda: g.expand("k", [1.0]),
            "path": lambda: load("/nowhere/at/all.csv"),
            "kind": lambda: load(3),
            "dims": lambda: load(t, dims=["z"]),
            "overlap": lambda: concat([g, g], along="k"),
            "selection": lambda: g.select({"nothing": 1}),
        },
    )


@query(_refusals(matrix="RotationMatrixError", axis="AxisNotFoundError", group="VectorGroupError", angles="AxisError", point="AxisError", translation="AxisTranslationError"))
def refuse_geometry(spark, sf):
    g = vectors(spark, sf).declare_vector("force", ("FX", "FY", "FZ"))
    return _refused(
        spark,
        {
            "matrix": lambda: Axis("bent", rotation_matrix=((1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 1.0))),
            "axis": lambda: g.rotate("nowhere", vector_groups=["force"]),
            "group": lambda: g.rotate("wind", vector_groups=["none"]),
            "angles": lambda: Axis("both"),
            "point": lambda: g.translate_moments(to_point=(1, 2)),
            "translation": lambda: daily(spark, sf).interpolate({"v": [1.0]}, axisTranslation={"from": "t", "to": "v"}),
        },
    )


_FILES = {
    "section": "[other]\n",
    "meta": "[equations]\na = '1'\n",
    "cycle": "[meta]\n[equations]\na = 'b'\nb = 'a'\n",
    "order": "[meta]\n[equations]\na = 'b'\nb = 'price'\n",
    "constant": "[meta]\n[constants]\nc = inf\n[equations]\na = 'c'\n",
}


@query(_refusals(section="WorkflowFileError", meta="WorkflowFileError", cycle="WorkflowCycleError", order="WorkflowFileError", constant="WorkflowFileError", sorted="none", absent="ProcessorNotFoundError", name="RegistryError"))
def refuse_workflows(spark, sf):
    folder = Path(tempfile.mkdtemp(prefix="gridloom-"))
    for name, text in _FILES.items():
        (folder / f"{name}.toml").write_text(text)
    calls = {name: functools.partial(processor, folder / f"{name}.toml") for name in _FILES}
    return _refused(
        spark,
        {
            **calls,
            "sorted": lambda: processor(folder / "order.toml", auto_sort=True),
            "absent": lambda: processor("nobody"),
            "name": lambda: register_processor("", _Doubled),
        },
    )


@query(_refusals(promote="ModeError", mode="ModeError", memory="ExportError", combine="CombineError", stream="none"))
def refuse_modes(spark, sf):
    g = priorities(spark, sf)
    draft = g.demote()
    return _refused(
        spark,
        {
            "promote": lambda: g.promote(),
            "mode": lambda: load(_table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), mode="other"),
            "memory": lambda: g.manifest("/tmp/none.json"),
            "combine": lambda: g.combine(draft, op="sum"),
            "stream": lambda: draft.promote().select({"x": 1}),
        },
    )


# ---------------------------------------------------------------------- sources and sinks


def _scratch(spark: SparkSession) -> str:
    """A new folder that all machines see."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        return tempfile.mkdtemp(prefix="gridloom-")
    return f"{shared}/files-{uuid.uuid4().hex}"


def _csv_folder(spark: SparkSession, sf: str) -> str:
    """A CSV file for each region, of nation key, supplier balance by nation, written by Spark."""
    s, nations = _table(spark, sf, "supplier"), _table(spark, sf, "nation")
    t = s.join(nations, s["s_nationkey"] == nations["n_nationkey"]).groupBy("n_regionkey", F.col("s_nationkey").alias("nation")).agg(F.round(F.avg("s_acctbal"), 4).alias("bal"), F.count(F.lit(1)).alias("n"))
    root = _scratch(spark)
    for r in range(5):
        t.where(F.col("n_regionkey") == r).drop("n_regionkey").coalesce(1).write.option("header", True).csv(f"{root}/r{r}")
    return root


def _one_file(spark: SparkSession, folder: str) -> str:
    from .sources import files

    return f"{folder}/{next(x for x in files.names_in(spark, folder) if x.endswith('.csv'))}"


_NATIONS = "n AS (SELECT n_regionkey AS region, s_nationkey::DOUBLE AS nation, round(avg(s_acctbal), 4) AS bal, count(*)::DOUBLE AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)"


@query(f"WITH {_NATIONS} SELECT nation, round(bal, 6) AS bal, n FROM n WHERE region = 2")
def load_csv_file(spark, sf):
    return rows(load(_one_file(spark, f"{_csv_folder(spark, sf)}/r2"), dims=["nation"]))


@query(f"WITH {_NATIONS} SELECT nation, round(bal, 6) AS bal, n FROM n WHERE region = 3")
def load_csv_folder(spark, sf):
    return rows(load(f"{_csv_folder(spark, sf)}/r3", dims=["nation"], pattern="part-*.csv"))


@query(f"WITH {_NATIONS}, m AS (SELECT DISTINCT nation FROM n WHERE region IN (1, 4)) SELECT region::DOUBLE AS region, nation, round(bal, 6) AS bal, n FROM n WHERE region IN (1, 4)")
def load_csv_mapping(spark, sf):
    root = _csv_folder(spark, sf)
    g = load({(r, "*"): _one_file(spark, f"{root}/r{r}") for r in (1, 4)}, dims=["region", "nation"])
    return rows(g).where("bal is not null")


@query("SELECT x, pr, round(v, 6) AS v FROM f6".join((f"WITH {F6} ", "")))
def load_pandas_frame(spark, sf):
    flat = priorities(spark, sf).to_pandas()
    return rows(load(flat).pivot(["x", "pr"]))


@query(f"WITH {F6} SELECT x, round(v, 6) AS v FROM f6 WHERE pr = '1-URGENT'")
def load_numpy_array(spark, sf):
    one = priorities(spark, sf).at(pr="1-URGENT")
    arrays, dims = one.to_numpy(return_dims=True)
    return rows(load(np.column_stack([dims["x"], arrays["v"]]), names=["x", "v"]).pivot(["x"]))


@query("SELECT 'k' AS name, 'double' AS kind UNION ALL SELECT 's', 'string' UNION ALL SELECT 'v', 'double'")
def infer_types(spark, sf):
    folder = f"{_scratch(spark)}/typed"
    spark.createDataFrame([("1", "x1", "1e3"), ("2", "2b", ""), ("3", "3", "inf")], "k string, s string, v string").coalesce(1).write.option("header", True).option("emptyValue", "").csv(folder)
    g = load(folder, dims=["k", "s"])
    return spark.createDataFrame([(c, t) for c, t in g.cells.dtypes], "name string, kind string")


@query("SELECT 1 AS same, 1 AS differs, 64 AS digits")
def source_hash(spark, sf):
    root = _csv_folder(spark, sf)
    a, b, c = (load(f"{root}/r{r}", dims=["nation"]).provenance.source_hash for r in (0, 0, 1))
    return spark.createDataFrame([(int(a == b), int(a != c), len(a))], "same int, differs int, digits int")


@query(f"WITH {F6} SELECT x, pr, round(v, 6) AS v FROM f6")
def csv_round_trip(spark, sf):
    folder = tempfile.mkdtemp(prefix="gridloom-")
    path = priorities(spark, sf).to_csv(Path(folder) / "out.csv")
    lines = [x for x in path.read_text().splitlines() if not x.startswith("#")]
    made = spark.createDataFrame([tuple(x.split(",")) for x in lines[1:]], ", ".join(f"`{c}` string" for c in lines[0].split(",")))
    return made.select(F.col("x").cast("double"), "pr", F.round(F.col("v").cast("double"), 6).alias("v"))


@query(f"WITH {F6} SELECT 'out_x_' || x::INTEGER || '.csv' AS file, count(*) AS lines, round(sum(v), 4) AS v FROM f6 GROUP BY 1")
def csv_split_by(spark, sf):
    folder = tempfile.mkdtemp(prefix="gridloom-")
    found = []
    for path in priorities(spark, sf).to_csv(Path(folder) / "out.csv", split_by="x"):
        lines = [x.split(",") for x in path.read_text().splitlines() if not x.startswith("#")]
        found.append((path.name, len(lines) - 1, round(sum(float(x[lines[0].index("v")]) for x in lines[1:]), 4)))
    return spark.createDataFrame(found, "file string, lines long, v double")


@query(f"WITH {F6} SELECT x, pr, round(v, 6) AS v FROM f6")
def csv_distributed(spark, sf):
    folder = priorities(spark, sf).to_csv(f"{_scratch(spark)}/out", distributed=True, split_by="pr")
    return spark.read.option("header", True).schema("x double, v double, pr string").csv(folder).select("x", "pr", F.round("v", 6).alias("v"))


@query(f"WITH {F6} SELECT x, pr, round(v, 6) AS v FROM f6")
def json_distributed(spark, sf):
    folder = priorities(spark, sf).to_json(f"{_scratch(spark)}/out", distributed=True)
    return spark.read.schema("x double, pr string, v double").json(folder).select("x", "pr", F.round("v", 6).alias("v"))


@query(f"WITH {F6} SELECT x, pr, round(v, 6) AS v, round(v * 0.01, 6) AS u FROM f6")
def json_round_trip(spark, sf):
    folder = tempfile.mkdtemp(prefix="gridloom-")
    body = json.loads(priorities(spark, sf).set_uncertainty({"v": "1%"}).to_json(Path(folder) / "out.json").read_text())
    xs, prs = (body["dimensions"][d]["coords"] for d in ("x", "pr"))
    values, u = body["variables"]["v"]["values"], body["uncertainty"]["variables"]["v"]["combined"]
    made = [(x, p, round(values[i][j], 6), round(u[i][j], 6)) for i, x in enumerate(xs) for j, p in enumerate(prs)]
    return spark.createDataFrame(made, "x double, pr string, v double, u double")


@query(f"WITH {_NATIONS} SELECT region, count(*) AS swept FROM n WHERE region IN (1, 4) GROUP BY region")
def manifest_files(spark, sf):
    root = _csv_folder(spark, sf)
    g = load({(r, "*"): _one_file(spark, f"{root}/r{r}") for r in (1, 4)}, dims=["region", "nation"])
    made = json.loads(g.manifest(Path(tempfile.mkdtemp(prefix="gridloom-")) / "m.json").read_text())
    found = [(int(f["coordinates"]["region"]), load(f["file"], dims=["nation"]).cells.count()) for f in made["files"]]
    return spark.createDataFrame(found, "region int, swept long")


@query("WITH f2 AS (SELECT p_size AS size, p_brand AS brand FROM part GROUP BY 1, 2), c AS (SELECT (SELECT count(DISTINCT size) FROM f2) * (SELECT count(DISTINCT brand) FROM f2) AS total, (SELECT count(*) FROM f2) AS rows) SELECT 'retail' AS variable, total, total - rows AS missing, 0 AS infinite, round(rows / total, 6) AS coverage FROM c")
def diagnostics_log(spark, sf):
    path = Path(tempfile.mkdtemp(prefix="gridloom-")) / "d.json"
    parts(spark, sf).diagnostics(path)
    body = json.loads(path.read_text())
    found = [(v, body["total"], x["missing"], x["infinite"], round(x["coverage"], 6)) for v, x in body["variables"].items()]
    return spark.createDataFrame(found, "variable string, total long, missing long, infinite int, coverage double")


@query(_f1("SELECT yr, flag, round(avg(price / qty), 6) AS unit FROM f1 WHERE status = 'O' GROUP BY yr, flag"))
def pipeline_saved(spark, sf):
    g = shipments(spark, sf)
    steps = g.compute("unit = price / qty").at(status="O").average("mo").history.to_pipeline()
    return rows(load_pipeline(steps.save(Path(tempfile.mkdtemp(prefix="gridloom-")) / "p.json")).apply(g), "unit")


# ---------------------------------------------------------------------- grid, modes, extensions


@query(f"WITH {F6} SELECT x, pr, round(v, 6) AS v FROM f6")
def pivot_auto_detect(spark, sf):
    flat = priorities(spark, sf)
    made = load(flat.cells.select("x", F.dense_rank().over(Window.orderBy("pr")).cast("double").alias("p"), "v"))
    g = made.pivot(auto_detect=True, threshold=13)
    names = spark.createDataFrame([(float(i + 1), p) for i, p in enumerate(flat.dim("pr").coords)], "p double, pr string")
    return rows(g).join(names, "p").select("x", "pr", "v")


@query("SELECT 'draft' AS first_mode, 'production' AS second_mode, 2 AS steps")
def promote_demote(spark, sf):
    g = priorities(spark, sf)
    draft = g.demote()
    back = draft.promote()
    return spark.createDataFrame([(draft.mode, back.mode, len(back.history) - len(g.history))], "first_mode string, second_mode string, steps int")


@query("SELECT 'analyst' AS who, 1 AS same_state, 1 AS other_state")
def session_and_state(spark, sf):
    set_user("analyst")
    try:
        g = priorities(spark, sf)
        again, other = priorities(spark, sf), g.compute("w = 2 * v")
        return spark.createDataFrame([(g.provenance.user, int(g.state_hash == again.state_hash), int(g.state_hash != other.state_hash))], "who string, same_state int, other_state int")
    finally:
        set_user(None)


class _Doubled:
    name, version = "doubled", "1"

    def validate(self, grid):
        grid.var("v")

    def info(self):
        return "twice v"

    def __call__(self, grid, **kwargs):
        return grid.compute("w = 2 * v")


@query(f"WITH {F6} SELECT x, pr, round(2 * v, 6) AS w FROM f6")
def registered_processor(spark, sf):
    name = f"doubled_{uuid.uuid4().hex[:8]}"
    register_processor(name, _Doubled)
    try:
        return rows(processor(name)(priorities(spark, sf)), "w")
    finally:
        registry._processors.pop(name, None)


@query(f"WITH {F6} SELECT x, pr, round(v, 6) AS v FROM f6")
def drop_uncertainty_links(spark, sf):
    g = priorities(spark, sf).compute("w = v").set_uncertainty({"v": 0.1, "w": 0.1}).set_correlation({("v", "w"): 0.5}).drop_correlation()
    return rows(g, "v", u=False)


@query(_f1("SELECT yr, mo, flag, status, round(sqrt(pow(0.5 * price, 2) + pow(2 * 0.25, 2) + 2 * 0.5 * (0.5 * price) * (2 * 0.25)), 6) AS u_sys__r FROM f1"))
def unc_derivative_correlated(spark, sf):
    g = shipments(spark, sf).set_uncertainty({"qty": 0.5, "disc": 0.25}).set_correlation({("qty", "disc"): 0.5})
    return rows(g.compute("r = qty * price + 2 * disc"), "r", u=True).select("yr", "mo", "flag", "status", "u_sys__r").where("u_sys__r is not null")
