"""Registered queries of the grid over the driver's tables, with SQL that gives the same rows.

Values are rounded to six decimals on both sides, and a missing value is NULL.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Axis, Grid, concat, load
from .errors import EmptySelectionError
from .functions.units import convert
from .grid import col, tag, u_rand, u_sys
from .plans.workflow import processor
from .sources.archive import open_archive
from .sources.reports import missing_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, and its SQL if there is any."""

    def mark(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return mark


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, digits: int = 6) -> F.Column:
    return F.when(F.isnan(c), None).otherwise(F.round(c, digits) + F.lit(0.0))


def rows(grid: Grid, *names: str, u: bool = False, tags: bool = False) -> DataFrame:
    """Dimensions, variables, and their mirrors where asked for."""
    out = [col(d) for d in grid.dim_names]
    for v in names or grid.vars:
        s = grid.vars[v]
        out.append(_r(col(v)).alias(v))
        if u and s.sys:
            out.append(_r(col(u_sys(v))).alias(u_sys(v)))
        if u and s.rand:
            out.append(_r(col(u_rand(v))).alias(u_rand(v)))
        if tags:
            out.append(grid.tag_column(v).cast("int").alias(tag(v)))
    return grid.cells.select(*out)


# ---------------------------------------------------------------------- frames


def shipments(spark: SparkSession, sf: str) -> Grid:
    """Mean quantity, price, discount and tax by year, month, return flag and line status."""
    t = _table(spark, sf, "lineitem")
    df = t.groupBy(
        F.year("l_shipdate").cast("double").alias("yr"), F.month("l_shipdate").cast("double").alias("mo"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")
    ).agg(F.avg("l_quantity").alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"))
    return load(df, dims=["yr", "mo", "flag", "status"])


F1 = """f1 AS (
  SELECT year(l_shipdate)::DOUBLE AS yr, month(l_shipdate)::DOUBLE AS mo, l_returnflag AS flag, l_linestatus AS status,
         avg(l_quantity) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def parts(spark: SparkSession, sf: str) -> Grid:
    """Mean retail price by size and brand: a sparse grid."""
    t = _table(spark, sf, "part")
    df = t.groupBy(F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("retail"))
    return load(df, dims=["size", "brand"])


F2 = "f2 AS (SELECT p_size::DOUBLE AS size, p_brand AS brand, avg(p_retailprice) AS retail FROM part GROUP BY 1, 2)"


def daily(spark: SparkSession, sf: str) -> Grid:
    """Mean value and running count of events by day and type; days count from the first."""
    t = _table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    first = t.agg(F.min("d").alias("d0"))
    df = t.crossJoin(F.broadcast(first)).groupBy(F.datediff("d", "d0").cast("double").alias("t"), F.col("event_type").alias("type")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).cast("double").alias("c"))
    from pyspark.sql import Window

    running = F.sum("c").over(Window.partitionBy("type").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return load(df.select("t", "type", "v", running.alias("n")), dims=["t", "type"])


F3 = """f3 AS (
  SELECT t, type, v, sum(c) OVER (PARTITION BY type ORDER BY t) AS n FROM (
    SELECT date_diff('day', (SELECT min(ts)::DATE FROM events), ts::DATE)::DOUBLE AS t, event_type AS type, avg(value) AS v, count(*)::DOUBLE AS c
    FROM events GROUP BY 1, 2))"""
#: Stencil of a window of five days, sliding inward at the ends, and its moving fits.
STENCIL = """pts AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT t FROM f3)),
st AS (SELECT t AS ct, greatest(0, least(m, greatest(0, i - 2) + 5) - 5) AS lo, least(m, greatest(0, i - 2) + 5) AS hi FROM pts),
w AS (SELECT st.ct, f3.type, f3.t - st.ct AS z, f3.v, f3.n FROM st JOIN pts p ON p.i >= st.lo AND p.i < st.hi JOIN f3 ON f3.t = p.t)"""


def vectors(spark: SparkSession, sf: str) -> Grid:
    """Six components and two angles in degrees, by vector id."""
    e = _table(spark, sf, "embeddings")
    parts_ = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("FX", "FY", "FZ", "MX", "MY", "MZ"))]
    df = e.select(*parts_, F.col("label").cast("double").alias("alpha"), (F.col("vec_id") % 10).cast("double").alias("beta"), F.col("vec_id").cast("double").alias("id"))
    return load(df).set_metadata({"alpha": {"unit": "deg"}, "beta": {"unit": "deg"}})


F5 = """f5 AS (SELECT embedding[1]::DOUBLE AS FX, embedding[2]::DOUBLE AS FY, embedding[3]::DOUBLE AS FZ, embedding[4]::DOUBLE AS MX, embedding[5]::DOUBLE AS MY,
  embedding[6]::DOUBLE AS MZ, label::DOUBLE AS alpha, (vec_id % 10)::DOUBLE AS beta, vec_id::DOUBLE AS id FROM embeddings)"""


def _f1(select: str, *extra: str) -> str:
    return "WITH " + ", ".join([F1, *extra]) + " " + select


def _f2(select: str, *extra: str) -> str:
    return "WITH " + ", ".join([F2, *extra]) + " " + select


def _f3(select: str, *extra: str) -> str:
    return "WITH " + ", ".join([F3, *extra]) + " " + select


def _f5(select: str) -> str:
    return f"WITH {F5} {select}"


# ---------------------------------------------------------------------- load and reports


@query(_f1("SELECT yr, mo, flag, status, round(qty, 6) AS qty, round(price, 6) AS price, round(disc, 6) AS disc, round(tax, 6) AS tax FROM f1"))
def load_pivot_grid(spark, sf):
    return rows(shipments(spark, sf))


@query(
    """SELECT 'l_linenumber' AS name, count(DISTINCT l_linenumber) AS uniq, 'candidate' AS kind FROM lineitem
    UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity), 'ambiguous' FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax), 'candidate' FROM lineitem"""
)
def inspect_candidates(spark, sf):
    found = load(_table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_tax")).inspect()["columns"]
    return spark.createDataFrame([(k, x["unique"], x["kind"]) for k, x in found.items()], "name string, uniq long, kind string")


@query(_f2("SELECT (SELECT count(DISTINCT size) * count(DISTINCT brand) FROM f2) AS cells, (SELECT count(*) FROM f2) AS populated, 0::BIGINT AS infinite"))
def diagnostics_counts(spark, sf):
    g = parts(spark, sf)
    return missing_counts(g).select(F.lit(g.expected_cells()).cast("long").alias("cells"), F.col("p0").alias("populated"), F.col("i0").alias("infinite"))


@query(_f1("SELECT 'qty' AS name, round(min(qty), 6) AS lo, round(max(qty), 6) AS hi, round(avg(qty), 6) AS mean FROM f1 UNION ALL SELECT 'price', round(min(price), 6), round(max(price), 6), round(avg(price), 6) FROM f1"))
def summary_stats(spark, sf):
    found = shipments(spark, sf).summary().variables
    df = spark.createDataFrame([(v, *(found[v][k] for k in ("min", "max", "mean"))) for v in ("qty", "price")], "name string, lo double, hi double, mean double")
    return df.select("name", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "mean")])


# ---------------------------------------------------------------------- selection and shape


@query(_f1("SELECT yr, mo, flag, status, round(qty, 6) AS qty FROM f1 WHERE mo IN (1, 6) AND flag = 'A'"))
def select_dim_eq(spark, sf):
    return rows(shipments(spark, sf).select({"mo": [1, 6], "flag": "A"}), "qty")


@query(_f1("SELECT yr, mo, flag, status, round(qty, 6) AS qty FROM f1 WHERE mo >= 3 AND mo < 7"))
def select_dim_range(spark, sf):
    return rows(shipments(spark, sf).select({"mo >=": 3, "mo <": 7}), "qty")


@query(_f1("SELECT yr, mo, flag, status, round(qty, 6) AS qty FROM f1 WHERE status <> 'O'"))
def select_dim_ne(spark, sf):
    return rows(shipments(spark, sf).select({"status !=": "O"}), "qty")


@query(_f1("SELECT yr, status, round(price, 6) AS price FROM f1 WHERE mo = 4 AND flag = 'N'"))
def at_slice(spark, sf):
    return rows(shipments(spark, sf).at(mo=4, flag="N"), "price")


@query(_f1("SELECT yr, flag, status, round(price, 6) AS price FROM f1 WHERE mo = 4"))
def squeeze_dim(spark, sf):
    return rows(shipments(spark, sf).select({"mo": 4}).squeeze("mo"), "price")


@query(_f1("SELECT yr, mo, flag, status, round(qty, 6) AS qty, round(price, 6) AS price FROM f1 WHERE qty > 25.5 AND price < 52000"))
def select_mask_vars(spark, sf):
    g = shipments(spark, sf)
    try:
        g = g.select({"qty >": 25.5, "price <": 52000})
    except EmptySelectionError:  # no grid is left, and SQL gives no rows
        return rows(g, "qty", "price").where(F.lit(False))
    return rows(g, "qty", "price")


@query(_f1("SELECT yr, mo, flag, status, round(price, 6) AS price FROM f1 WHERE sqrt(pow(abs(price) * 0.05, 2) + 100.0 * 100.0) > 1900"))
def select_unc(spark, sf):
    g = shipments(spark, sf).set_uncertainty({"price": "5%"}).set_uncertainty({"price": 100.0}, component="random")
    return rows(g.select({"price >": 1900}, Frame="UncFrame"), "price")


@query(_f1("SELECT yr, mo, flag, status, round(1.5 * qty, 6) AS qty FROM f1 WHERE disc > 0.05"))
def select_tags(spark, sf):
    g = shipments(spark, sf).compute("qty = 1.5 * qty", where="disc > 0.05", fill=None).select({"qty": 1}, Frame="HistoryFrame")
    return rows(g, "qty").where("qty is not null")


@query(_f1("SELECT yr, mo, flag, status, k, round(tax, 6) AS tax FROM f1, (VALUES (10.0::DOUBLE), (5.0::DOUBLE)) AS x(k) WHERE flag = 'R'"))
def expand_dim(spark, sf):
    return rows(shipments(spark, sf).select({"flag": "R"}).expand("k", [10, 5]), "tax")


@query(_f1("SELECT yr, mo, flag, status, round(qty, 6) AS qty FROM f1 WHERE mo > 10 UNION ALL SELECT yr, mo, flag, status, round(qty, 6) FROM f1 WHERE mo <= 2"))
def concat_dim(spark, sf):
    g = shipments(spark, sf)
    return rows(concat([g.select({"mo >": 10}), g.select({"mo <=": 2})], along="mo"), "qty")


# ---------------------------------------------------------------------- combination


def _combined(spark, sf, op, **kwargs):
    g = shipments(spark, sf)
    for v, u in (("qty", "2%"), ("price", "1%")):
        g = g.set_uncertainty({v: u})
    g = g.set_uncertainty({"qty": 0.5}, component="random")
    made = rows(g.at(flag="A").combine(g.at(flag="R"), op=op, cross_correlation=0.3, **kwargs), "qty", "price", u=True).where("qty is not null")
    return made.withColumns({c: F.round(c, 2) for c in made.columns if c.endswith("price")})


def _combine_sql(value: str, pa: str, pb: str) -> str:
    """SQL of one rule; {a} and {b} are the operands."""
    out = []
    for v, s, r in (("qty", 0.02, 0.5), ("price", 0.01, None)):
        f = {"a": f"a.{v}", "b": f"b.{v}"}
        x, y = pa.format(**f), pb.format(**f)
        digits = 2 if v == "price" else 6
        out.append(f"round({value.format(**f)}, {digits}) AS {v}")
        sa, sb = f"(({x}) * a.{v} * {s})", f"(({y}) * b.{v} * {s})"
        out.append(f"round(sqrt(greatest({sa} * {sa} + {sb} * {sb} + 0.6 * {sa} * {sb}, 0)), {digits}) AS u_sys__{v}")
        if r is not None:
            ra, rb = f"(({x}) * {r})", f"(({y}) * {r})"
            out.append(f"round(sqrt(greatest({ra} * {ra} + {rb} * {rb} + 0.6 * {ra} * {rb}, 0)), 6) AS u_rand__{v}")
    return _f1(f"SELECT a.yr, a.mo, a.status, {', '.join(out)} FROM f1 a JOIN f1 b ON a.yr = b.yr AND a.mo = b.mo AND a.status = b.status AND a.flag = 'A' AND b.flag = 'R'")


@query(_combine_sql("{a} + {b}", "1", "1"))
def combine_sum(spark, sf):
    return _combined(spark, sf, "sum")


@query(_combine_sql("{a} - {b}", "1", "-1"))
def combine_diff(spark, sf):
    return _combined(spark, sf, "diff")


@query(_combine_sql("{a} * {b}", "{b}", "{a}"))
def combine_product(spark, sf):
    return _combined(spark, sf, "product")


@query(_combine_sql("{a} / {b}", "1 / {b}", "-{a} / ({b} * {b})"))
def combine_ratio(spark, sf):
    return _combined(spark, sf, "ratio")


@query(_combine_sql("({a} + {b}) / 2", "0.5", "0.5"))
def combine_mean(spark, sf):
    return _combined(spark, sf, "mean")


@query(_combine_sql("0.25 * {a} + 0.75 * {b}", "0.25", "0.75"))
def combine_weighted_mean(spark, sf):
    return _combined(spark, sf, "weighted_mean", weights=(1, 3))


# ---------------------------------------------------------------------- equations


@query(_f1("SELECT yr, mo, flag, status, round(price / qty, 6) AS unit, 1 AS tag__unit FROM f1"))
def compute_arith(spark, sf):
    return rows(shipments(spark, sf).compute("unit = price / qty"), "unit", tags=True)


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, round(sin(o_totalprice) * cos(o_totalprice / 7) + atan2(o_totalprice, 1000.0) - tan(o_totalprice / 1e6), 6) AS r FROM orders")
def compute_trig(spark, sf):
    g = load(_table(spark, sf, "orders").select(F.col("o_orderkey").cast("double"), "o_totalprice")).compute("r = sin(o_totalprice) * cos(o_totalprice / 7) + atan2(o_totalprice, 1000) - tan(o_totalprice / 1000000)")
    return rows(g, "o_orderkey", "r")


@query(
    """SELECT c_custkey::DOUBLE AS c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal) + log10(c_acctbal), 6) WHEN c_acctbal = 0 THEN '-inf'::DOUBLE END AS r,
    round(exp(c_acctbal / 5000), 6) AS e FROM customer"""
)
def compute_log(spark, sf):
    g = load(_table(spark, sf, "customer").select(F.col("c_custkey").cast("double"), "c_acctbal")).compute("r = log(c_acctbal) + log10(c_acctbal)").compute("e = exp(c_acctbal / 5000)")
    return rows(g, "c_custkey", "r", "e")


@query(_f1("SELECT yr, mo, flag, status, round(pow(qty, 1.5) + sqrt(price) - pow(disc, 2), 6) AS r FROM f1"))
def compute_pow(spark, sf):
    return rows(shipments(spark, sf).compute("r = qty**1.5 + sqrt(price) - disc**2"), "r")


@query(
    """SELECT c_custkey::DOUBLE AS c_custkey, CASE WHEN c_acctbal > 0 AND c_acctbal < 5000 THEN round(sqrt(c_acctbal), 6) ELSE -1 END AS r,
    CASE WHEN c_acctbal > 0 AND c_acctbal < 5000 THEN 1 ELSE 0 END AS tag__r FROM customer"""
)
def compute_where_fill(spark, sf):
    g = load(_table(spark, sf, "customer").select(F.col("c_custkey").cast("double"), "c_acctbal")).compute("r = sqrt(c_acctbal)", where="0 < c_acctbal < 5000", fill=-1)
    return rows(g, "c_custkey", "r", tags=True).drop("tag__c_custkey")


@query("SELECT c_custkey::DOUBLE AS c_custkey, round(CASE WHEN NOT (c_acctbal >= 0) THEN -c_acctbal ELSE c_acctbal END, 6) AS c_acctbal FROM customer")
def compute_where_keep(spark, sf):
    g = load(_table(spark, sf, "customer").select(F.col("c_custkey").cast("double"), "c_acctbal")).compute("c_acctbal = -c_acctbal", where="not c_acctbal >= 0", fill=None)
    return rows(g, "c_custkey", "c_acctbal")


@query("SELECT c_custkey::DOUBLE AS c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () + max(c_acctbal) OVER (), 6) AS z FROM customer")
def compute_np_reduction(spark, sf):
    g = load(_table(spark, sf, "customer").select(F.col("c_custkey").cast("double"), "c_acctbal"))
    return rows(g.compute("z = (c_acctbal - np.mean(c_acctbal)) / np.std(c_acctbal) + np.max(c_acctbal)"), "c_custkey", "z")


@query(
    _f1(
        """SELECT yr, mo, flag, status, round(price / qty, 6) AS unit,
        round(sqrt(pow(abs(price) * 0.01 / qty, 2) + pow(price * 0.5 / (qty * qty), 2)), 6) AS u_sys__unit, round(abs(price * 0.25 / (qty * qty)), 6) AS u_rand__unit FROM f1"""
    )
)
def compute_unc_independent(spark, sf):
    g = shipments(spark, sf).set_uncertainty({"price": "1%", "qty": 0.5}).set_uncertainty({"qty": 0.25}, component="random")
    return rows(g.compute("unit = price / qty"), "unit", u=True).where("unit is not null")


@query(
    _f1(
        """SELECT yr, mo, flag, status, round(price * exp(disc), 6) AS r,
        round(sqrt(pow(exp(disc) * price * 0.01, 2) + pow(price * exp(disc) * 0.002, 2) - 2 * 0.4 * exp(disc) * price * 0.01 * price * exp(disc) * 0.002), 6) AS u_sys__r FROM f1"""
    )
)
def compute_unc_correlated(spark, sf):
    g = shipments(spark, sf).set_uncertainty({"price": "1%", "disc": 0.002}).set_correlation({("price", "disc"): -0.4})
    return rows(g.compute("r = price * exp(disc)"), "r", u=True).where("r is not null")


@query(_f1("SELECT yr, mo, flag, status, round(price, 6) AS price, round(abs(price) * 0.05, 6) AS u_rand__price FROM f1"))
def unc_relative(spark, sf):
    return rows(shipments(spark, sf).set_uncertainty({"price": "5%"}, component="random"), "price", u=True)


# ---------------------------------------------------------------------- reductions


@query(_f1("SELECT yr, flag, status, round(avg(price / qty), 6) AS unit FROM f1 GROUP BY yr, flag, status"))
def average_one_dim(spark, sf):
    return rows(shipments(spark, sf).compute("unit = price / qty").average("mo"), "unit")


@query(_f1("SELECT flag, status, round(avg(qty), 6) AS qty, round(avg(price), 6) AS price FROM f1 GROUP BY flag, status"))
def average_two_dims(spark, sf):
    return rows(shipments(spark, sf).average(["yr", "mo"]), "qty", "price")


@query(
    _f1(
        """SELECT flag, status, round(avg(qty), 6) AS qty, round(abs(sum(qty * 0.02)) / count(*), 6) AS u_sys__qty, round(sqrt(sum(0.25::DOUBLE)) / count(*), 6) AS u_rand__qty
        FROM f1 GROUP BY flag, status"""
    )
)
def average_unc(spark, sf):
    g = shipments(spark, sf).set_uncertainty({"qty": "2%"}).set_uncertainty({"qty": 0.5}, component="random")
    return rows(g.average(["yr", "mo"]), "qty", u=True).where("qty is not null")


_TRAPEZOID = "w AS (SELECT mo, (coalesce(lead(mo) OVER o, mo) - coalesce(lag(mo) OVER o, mo)) / 2 AS w, count(*) OVER () AS m FROM (SELECT DISTINCT mo FROM f1) WINDOW o AS (ORDER BY mo))"


@query(_f1("SELECT yr, flag, status, CASE WHEN count(*) = max(m) THEN round(sum(price * w), 6) END AS price FROM f1 JOIN w USING (mo) GROUP BY yr, flag, status", _TRAPEZOID))
def integrate_trapz(spark, sf):
    return rows(shipments(spark, sf).integrate("price", over="mo"))


@query(
    _f2(
        """SELECT brand, round(sum(retail * w), 6) AS retail, CASE WHEN count(*) < (SELECT count(DISTINCT size) FROM f2) THEN 1 ELSE 0 END AS tag__retail
        FROM (SELECT *, (coalesce(lead(size) OVER o, size) - coalesce(lag(size) OVER o, size)) / 2 AS w FROM f2 WINDOW o AS (PARTITION BY brand ORDER BY size)) GROUP BY brand"""
    )
)
def integrate_skipna(spark, sf):
    return rows(parts(spark, sf).integrate("retail", over="size", skipna=True), tags=True)


@query(
    """WITH g AS (SELECT c_nationkey::DOUBLE AS r, ((c_custkey % 12) * 30)::DOUBLE AS theta, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2),
    wr AS (SELECT r, (coalesce(lead(r) OVER o, r) - coalesce(lag(r) OVER o, r)) / 2 AS w, count(*) OVER () AS m FROM (SELECT DISTINCT r FROM g) WINDOW o AS (ORDER BY r)),
    wt AS (SELECT theta, radians(coalesce(lead(theta) OVER o, theta) - coalesce(lag(theta) OVER o, theta)) / 2 AS w, count(*) OVER () AS m FROM (SELECT DISTINCT theta FROM g) WINDOW o AS (ORDER BY theta)),
    a AS (SELECT theta, CASE WHEN count(*) = max(m) THEN sum(v * r * w) END AS v FROM g JOIN wr USING (r) GROUP BY theta)
    SELECT CASE WHEN count(v) = max(m) THEN round(sum(v * w), 6) END AS v FROM a JOIN wt USING (theta)"""
)
def integrate_polar(spark, sf):
    t = _table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("double").alias("r"), ((F.col("c_custkey") % 12) * 30).cast("double").alias("theta")).agg(F.avg("c_acctbal").alias("v"))
    g = load(t, dims=["r", "theta"]).set_metadata({"theta": {"unit": "deg"}})
    return rows(g.integrate("v", over=["r", "theta"], coords="polar"))


@query(
    _f1(
        """SELECT yr, flag, status, CASE WHEN count(*) = max(m) THEN round(sum(price * w), 6) END AS price, round(abs(sum(price * 0.01 * w)), 6) AS u_sys__price,
        round(sqrt(sum(pow(price * 0.05 * w, 2))), 6) AS u_rand__price FROM f1 JOIN w USING (mo) GROUP BY yr, flag, status""",
        _TRAPEZOID,
    )
)
def integrate_unc(spark, sf):
    g = shipments(spark, sf).set_uncertainty({"price": "1%"}).set_uncertainty({"price": "5%"}, component="random")
    return rows(g.integrate("price", over="mo"), u=True)


# ---------------------------------------------------------------------- resampling and kernels

_TARGETS = "t AS (SELECT * FROM (VALUES (1.5::DOUBLE), (3.0::DOUBLE), (7.25::DOUBLE), (12.5::DOUBLE)) AS x(m)), k AS (SELECT m, least(greatest(floor(m), 1), 11)::DOUBLE AS lo FROM t)"


@query(
    _f1(
        """SELECT a.yr, k.m AS mo, a.flag, a.status,
        CASE WHEN k.m = k.lo THEN round(max(a.price) FILTER (WHERE a.mo = k.lo), 6) WHEN count(*) = 2 THEN round(sum(a.price * CASE WHEN a.mo = k.lo THEN 1 - (k.m - k.lo) ELSE k.m - k.lo END), 6) END AS price,
        CASE WHEN k.m = k.lo THEN 0 WHEN k.m BETWEEN 1 AND 12 THEN 1 ELSE -1 END AS tag__price
        FROM f1 a JOIN k ON a.mo IN (k.lo, k.lo + 1) GROUP BY a.yr, k.m, k.lo, a.flag, a.status HAVING k.m <> k.lo OR count(*) FILTER (WHERE a.mo = k.lo) > 0""",
        _TARGETS,
    )
)
def interpolate_linear(spark, sf):
    return rows(shipments(spark, sf).interpolate({"mo": [1.5, 3, 7.25, 12.5]}), "price", tags=True)


@query(
    _f1(
        """SELECT a.yr, k.m AS mo, a.flag, a.status,
        round(abs(sum(a.price * 0.01 * CASE WHEN a.mo = k.lo THEN 1 - (k.m - k.lo) ELSE k.m - k.lo END)), 6) AS u_sys__price,
        round(sqrt(sum(pow(a.price * 0.03 * CASE WHEN a.mo = k.lo THEN 1 - (k.m - k.lo) ELSE k.m - k.lo END, 2))), 6) AS u_rand__price
        FROM f1 a JOIN k ON a.mo IN (k.lo, k.lo + 1) WHERE k.m <> k.lo GROUP BY a.yr, k.m, k.lo, a.flag, a.status""",
        _TARGETS,
    )
)
def interpolate_unc(spark, sf):
    g = shipments(spark, sf).set_uncertainty({"price": "1%"}).set_uncertainty({"price": "3%"}, component="random")
    return rows(g.interpolate({"mo": [1.5, 7.25, 12.5]}), "price", u=True).drop("price")


@query(_f1("SELECT yr, m AS mo, flag, status, round(price, 6) AS price FROM f1 JOIN (VALUES (1.4::DOUBLE, 1), (2.5::DOUBLE, 2), (11.0::DOUBLE, 11), (14.0::DOUBLE, 12)) AS x(m, near) ON mo = near"))
def interpolate_nearest(spark, sf):
    return rows(shipments(spark, sf).interpolate({"mo": [1.4, 2.5, 11, 14]}, method="nearest"), "price")


@query(
    _f1(
        """SELECT yr, m AS mo, flag, status, CASE WHEN count(*) = 12 THEN round(regr_intercept(price, f1.mo) + regr_slope(price, f1.mo) * m, 2) END AS price
        FROM f1, (VALUES (2.0::DOUBLE), (6.5::DOUBLE), (13.0::DOUBLE)) AS x(m) GROUP BY yr, m, flag, status"""
    )
)
def interpolate_polyfit1(spark, sf):
    g = shipments(spark, sf).interpolate({"mo": [2, 6.5, 13]}, method="polyfit", deg=1, override=True)
    return rows(g, "price").withColumn("price", F.round("price", 2))


def _weights_sql(weights: np.ndarray, sources, targets) -> str:
    values = ", ".join(f"({s}::DOUBLE, {t}::DOUBLE, {float(weights[i, j])!r}::DOUBLE)" for i, t in enumerate(targets) for j, s in enumerate(sources) if weights[i, j] != 0)
    return f"w AS (SELECT * FROM (VALUES {values}) AS x(s, m, w))"


def _natural_spline(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Weights for the SQL side, column by column: the spline through each unit vector."""
    h = np.diff(x)
    out = np.zeros((len(t), len(x)))
    for j in range(len(x)):
        y = np.eye(len(x))[j]
        a, b = np.eye(len(x)), np.zeros(len(x))
        for i in range(1, len(x) - 1):
            a[i, i - 1 : i + 2] = h[i - 1] / 6, (h[i - 1] + h[i]) / 3, h[i] / 6
            b[i] = (y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1]
        m = np.linalg.solve(a, b)
        for k, v in enumerate(t):
            i = min(max(int(np.searchsorted(x, v, side="right")) - 1, 0), len(x) - 2)
            p, q = x[i + 1] - v, v - x[i]
            out[k, j] = (m[i] * p**3 + m[i + 1] * q**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * p + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * q
    return out


@query(
    _f1(
        "SELECT yr, m AS mo, flag, status, CASE WHEN count(*) = 12 THEN round(sum(price * w), 4) END AS price FROM f1 JOIN w ON s = mo GROUP BY yr, m, flag, status",
        _weights_sql(_natural_spline(np.arange(1.0, 13), np.array([1.5, 6.25, 11.75])), range(1, 13), (1.5, 6.25, 11.75)),
    )
)
def interpolate_cubic(spark, sf):
    return rows(shipments(spark, sf).interpolate({"mo": [1.5, 6.25, 11.75]}, method="cubic"), "price").withColumn("price", F.round("price", 4))


@query(
    _f3(
        """SELECT x.n, s.type, round(CASE WHEN x.n = s.n THEN s.v WHEN x.n = s.n1 THEN s.v1 ELSE s.v + (s.v1 - s.v) * (x.n - s.n) / (s.n1 - s.n) END, 6) AS v, round(CASE WHEN x.n = s.n THEN s.t WHEN x.n = s.n1 THEN s.t1 ELSE s.t + (s.t1 - s.t) * (x.n - s.n) / (s.n1 - s.n) END, 6) AS day
        FROM s, (VALUES (0.5::DOUBLE), (40.0::DOUBLE), (97.0::DOUBLE)) AS x(n) WHERE (x.n >= s.n AND x.n < s.n1) OR (s.f AND x.n < s.n) OR (s.l AND x.n >= s.n1)""",
        """s0 AS (SELECT type, t, v, n, lead(t) OVER o AS t1, lead(v) OVER o AS v1, lead(n) OVER o AS n1, lag(n) OVER o IS NULL AS f FROM f3 WINDOW o AS (PARTITION BY type ORDER BY n)),
        s AS (SELECT *, lead(n) OVER (PARTITION BY type ORDER BY n) IS NULL AS l FROM s0 WHERE n1 IS NOT NULL)""",
    )
)
def axis_translate_linear(spark, sf):
    g = daily(spark, sf)
    g = load(g.cells.withColumn("day", F.col("t")), dims=["t", "type"])
    return rows(g.interpolate({"n": [0.5, 40, 97]}, axisTranslation={"from": "t", "to": "n"}), "v", "day")


_GAPS = """d AS (SELECT s.size, b.brand, f2.retail FROM (SELECT DISTINCT size FROM f2) s CROSS JOIN (SELECT DISTINCT brand FROM f2) b LEFT JOIN f2 ON f2.size = s.size AND f2.brand = b.brand),
g AS (SELECT *, last_value(CASE WHEN retail IS NOT NULL THEN size END IGNORE NULLS) OVER p AS x0, last_value(retail IGNORE NULLS) OVER p AS y0,
  first_value(CASE WHEN retail IS NOT NULL THEN size END IGNORE NULLS) OVER q AS x1, first_value(retail IGNORE NULLS) OVER q AS y1 FROM d
  WINDOW p AS (PARTITION BY brand ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY brand ORDER BY size ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


@query(
    _f2(
        """SELECT size, brand, round(coalesce(retail, y0 + (y1 - y0) * (size - x0) / (x1 - x0)), 6) AS retail,
        round(CASE WHEN retail IS NOT NULL THEN retail * 0.01 ELSE sqrt(pow(y0 * 0.01 * (x1 - size) / (x1 - x0), 2) + pow(y1 * 0.01 * (size - x0) / (x1 - x0), 2)) END, 6) AS u_rand__retail,
        CASE WHEN retail IS NULL AND x0 IS NOT NULL AND x1 IS NOT NULL THEN 1 ELSE 0 END AS tag__retail FROM g""",
        _GAPS,
    )
)
def fill_linear(spark, sf):
    return rows(parts(spark, sf).set_uncertainty({"retail": "1%"}, component="random").fill("size"), u=True, tags=True)


@query(
    _f2(
        """SELECT size, brand, round(coalesce(retail, CASE WHEN x1 IS NULL OR (x0 IS NOT NULL AND size - x0 <= x1 - size) THEN y0 ELSE y1 END), 6) AS retail FROM g""",
        _GAPS,
    )
)
def fill_nearest(spark, sf):
    return rows(parts(spark, sf).fill("size", method="nearest"))


@query(_f3("SELECT ct AS t, type, round(avg(v), 6) AS v, 1 AS tag__v FROM w GROUP BY ct, type", STENCIL))
def smooth_moving_avg(spark, sf):
    return rows(daily(spark, sf).smooth(along="t", method="moving_avg", window=5), "v", tags=True)


@query(_f3("SELECT ct AS t, type, round(regr_intercept(v, z), 6) AS v FROM w GROUP BY ct, type", STENCIL))
def smooth_savgol_deg1(spark, sf):
    return rows(daily(spark, sf).smooth(along="t", method="savgol", window=5, polyorder=1), "v")


@query(_f3("SELECT ct AS t, type, round(regr_slope(v, z), 6) AS dv_dt, round(regr_slope(n, z), 6) AS dn_dt FROM w GROUP BY ct, type", STENCIL))
def diff_deg1(spark, sf):
    return rows(daily(spark, sf).diff(along="t", window=5, deg=1))


_SUMS = "m AS (SELECT ct, type, count(*)::DOUBLE AS s0, sum(z) AS s1, sum(z * z) AS s2, sum(z * z * z) AS s3, sum(z * z * z * z) AS s4, sum(v) AS y0, sum(v * z) AS y1, sum(v * z * z) AS y2 FROM w GROUP BY ct, type)"
_DET = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"


@query(_f3(f"SELECT ct AS t, type, round((s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / {_DET}, 6) AS dv_dt FROM m", STENCIL, _SUMS))
def diff_deg2(spark, sf):
    return rows(daily(spark, sf).diff(along="t", window=5, deg=2), "dv_dt")


@query(_f3("SELECT type, 't^0' AS t_coef, round(regr_intercept(v, t), 6) AS v FROM f3 GROUP BY type UNION ALL SELECT type, 't^1', round(regr_slope(v, t), 6) FROM f3 GROUP BY type"))
def fitmodel_deg1(spark, sf):
    return rows(daily(spark, sf).fitmodel(along="t", deg=1), "v")


_FIT2 = """w AS (SELECT 0 AS ct, type, t AS z, v FROM f3)"""


@query(
    _f3(
        f"""SELECT type, 't^0' AS t_coef, round((y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - y2 * s3) + s2 * (y1 * s3 - y2 * s2)) / {_DET}, 6) AS v FROM m
        UNION ALL SELECT type, 't^1', round((s0 * (y1 * s4 - y2 * s3) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / {_DET}, 6) FROM m
        UNION ALL SELECT type, 't^2', round((s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / {_DET}, 6) FROM m""",
        _FIT2,
        _SUMS,
    )
)
def fitmodel_deg2(spark, sf):
    return rows(daily(spark, sf).fitmodel(along="t", deg=2), "v")


@query(
    _f3(
        """SELECT type, x.t, round(regr_intercept(v, f3.t) + regr_slope(v, f3.t) * x.t, 6) AS v, CASE WHEN x.t <= max(f3.t) THEN 1 ELSE -1 END AS tag__v
        FROM f3, (VALUES (2.5::DOUBLE), (10.0::DOUBLE), (99.0::DOUBLE)) AS x(t) GROUP BY type, x.t"""
    )
)
def fitvalue(spark, sf):
    g = daily(spark, sf).fitmodel(along="t", deg=1).fitvalue(coef_dims=["t_coef"], at={"t": [2.5, 10, 99]})
    return rows(g, "v", tags=True)


# ---------------------------------------------------------------------- geometry

_C, _S = math.cos(0.3), math.sin(0.3)


@query(_f5(f"SELECT id, round({_C!r} * FX + {_S!r} * FY, 6) AS FX, round(-{_S!r} * FX + {_C!r} * FY, 6) AS FY, round(FZ, 6) AS FZ FROM f5"))
def rotate_constant(spark, sf):
    axis = Axis("tilted", rotation_matrix=((_C, _S, 0.0), (-_S, _C, 0.0), (0.0, 0.0, 1.0)))
    g = vectors(spark, sf).register_axis(axis).declare_vector("force", ("FX", "FY", "FZ")).rotate("tilted", vector_groups=["force"])
    return rows(g, "id", "FX", "FY", "FZ")


_WIND = """SELECT id, round(cos(b) * (cos(a) * FX + sin(a) * FZ) + sin(b) * FY, 6) AS FX, round(-sin(b) * (cos(a) * FX + sin(a) * FZ) + cos(b) * FY, 6) AS FY, round(-sin(a) * FX + cos(a) * FZ, 6) AS FZ,
  round(cos(b) * (cos(a) * MX + sin(a) * MZ) + sin(b) * MY, 6) AS MX, round(-sin(b) * (cos(a) * MX + sin(a) * MZ) + cos(b) * MY, 6) AS MY, round(-sin(a) * MX + cos(a) * MZ, 6) AS MZ
  FROM (SELECT *, radians(alpha) AS a, radians(beta) AS b FROM f5)"""


@query(_f5(_WIND))
def rotate_wind(spark, sf):
    return rows(vectors(spark, sf).rotate("wind"), "id", "FX", "FY", "FZ", "MX", "MY", "MZ")


@query(
    _f5(
        """SELECT id, round(sqrt(pow(cos(a) * 0.1, 2) + pow(sin(a) * 0.3, 2) + pow((-sin(a) * FX + cos(a) * FZ) * radians(0.5), 2)), 6) AS u_sys__FX, round(0.2::DOUBLE, 6) AS u_sys__FY,
        round(sqrt(pow(sin(a) * 0.1, 2) + pow(cos(a) * 0.3, 2) + pow((-cos(a) * FX - sin(a) * FZ) * radians(0.5), 2)), 6) AS u_sys__FZ FROM (SELECT *, radians(alpha) AS a FROM f5)"""
    )
)
def rotate_unc(spark, sf):
    g = vectors(spark, sf).declare_vector("force", ("FX", "FY", "FZ")).set_uncertainty({"FX": 0.1, "FY": 0.2, "FZ": 0.3, "alpha": 0.5})
    return rows(g.rotate("stability", vector_groups=["force"]), "id", "FX", "FY", "FZ", u=True).drop("FX", "FY", "FZ")


@query(
    _f5(
        """SELECT id, round(MX + (-2.0) * FZ - (-3.0) * FY, 6) AS MX, round(MY + (-3.0) * FX - (-1.0) * FZ, 6) AS MY, round(MZ + (-1.0) * FY - (-2.0) * FX, 6) AS MZ,
        round(sqrt(pow(2 * 0.1, 2) + pow(0.05, 2)), 6) AS u_sys__MX, round(0.1::DOUBLE, 6) AS u_sys__MY, round(0.0::DOUBLE, 6) AS u_sys__MZ FROM f5"""
    )
)
def translate_moments(spark, sf):
    g = vectors(spark, sf).set_uncertainty({"FZ": 0.1, "MX": 0.05}).translate_moments(to_point=(1, 2, 3))
    return rows(g, "id", "MX", "MY", "MZ", u=True)


# ---------------------------------------------------------------------- units, workflows, replay


@query("SELECT p_partkey, round(p_size * 0.0254 / 0.3048, 6) AS feet, round((p_size - 32.0) * 5.0 / 9.0, 6) AS degc FROM part")
def unit_convert(spark, sf):
    size = F.col("p_size").cast("double")
    return _table(spark, sf, "part").select("p_partkey", F.round(convert(size, "in", "ft"), 6).alias("feet"), F.round(convert(size, "F", "C"), 6).alias("degc"))


_WORKFLOW = """
[meta]
name = "margins"
version = "1"
[constants]
rate = 0.9
[uncertainties]
price = "2%"
[equations]
net = "price * (1 - disc) * rate"
unit = "net / qty"
[corrections]
unit = "unit * (1 + tax)"
"""


@query(
    _f1(
        """SELECT yr, mo, flag, status, round(price * (1 - disc) * 0.9, 6) AS net, round(price * (1 - disc) * 0.9 / qty * (1 + tax), 6) AS unit,
        round(price * 0.02 * (1 - disc) * 0.9, 6) AS u_sys__net, round(price * 0.02 * (1 - disc) * 0.9 / qty * (1 + tax), 6) AS u_sys__unit FROM f1"""
    )
)
def workflow_equations(spark, sf):
    with tempfile.NamedTemporaryFile("w", suffix=".toml") as f:
        f.write(_WORKFLOW)
        f.flush()
        run = processor(f.name)
    return rows(run(shipments(spark, sf)), "net", "unit", u=True)


@query(_f1("SELECT yr, flag, round(avg(price / qty), 6) AS unit FROM f1 WHERE status = 'F' AND mo >= 6 GROUP BY yr, flag"))
def pipeline_replay(spark, sf):
    g = shipments(spark, sf)
    steps = g.compute("unit = price / qty").at(status="F").select({"mo >=": 6}).average("mo").history.to_pipeline()
    return rows(steps.apply(g), "unit")


@query(_f1("SELECT yr, mo, flag, status, round(price / qty, 6) AS unit, round(qty, 6) AS qty FROM f1"))
def archive_round_trip(spark, sf):
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="gridloom-")
    path = f"{root}/archive-{np.random.default_rng().integers(1 << 60):x}"
    shipments(spark, sf).compute("unit = price / qty").save(path)
    return rows(open_archive(path), "unit", "qty")


@query(_f1("SELECT flag, status, round(avg(price / qty), 6) AS unit, round(sqrt(sum(pow(price / qty * sqrt(0.0001 + 0.0004), 2))) / count(*), 6) AS u_rand__unit FROM f1 GROUP BY flag, status"))
def flagship(spark, sf):
    """Unit price by return flag and status with its propagated random uncertainty."""
    g = shipments(spark, sf).set_uncertainty({"price": "1%", "qty": "2%"}, component="random")
    return rows(g.compute("unit = price / qty").average(["yr", "mo"]), "unit", u=True).where("unit is not null")


from . import more_queries  # noqa: E402, F401  registers its own
