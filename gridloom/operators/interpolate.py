"""Resampling along dimensions, and exchanging a dimension for a monotonic variable."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AxisTranslationError, DegreeError, DimensionError, GridError, VariableError
from ..functions import numeric as n
from ..grid import Dim, Grid, as_coordinates, col, no_default, tag, u_rand, u_sys
from .linear import apply_weights, cubic_weights, linear_weights, nearest_weights, pandas_cells, polynomial_weights

METHODS = ("linear", "cubic", "nearest", "polyfit")


def check_degree(deg: object, points: int, what: str) -> int:
    if isinstance(deg, bool) or not isinstance(deg, int | np.integer) or deg < 0:
        raise DegreeError(what, f"degree {deg!r} is not a whole number of 0 or more", "Pass an int")
    if deg >= points:
        raise DegreeError(what, f"degree {deg} needs more than {points} points", f"Use at most {points - 1}")
    return int(deg)


def weights_for(method: str, x: np.ndarray, t: np.ndarray, deg: int | None) -> np.ndarray:
    """Weights on sources in their given order; kernels work on sorted ones."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    w = {"linear": linear_weights, "cubic": cubic_weights, "nearest": nearest_weights}[method](s, t) if method != "polyfit" else polynomial_weights(s, t, deg)
    out = np.zeros_like(w)
    out[:, order] = w
    return out


def _check(grid: Grid, name: str, method: str, deg: object) -> int | None:
    points = len(grid.dim(name, numeric=True))
    if method not in METHODS:
        raise GridError(str(method), "unknown interpolation method", "Use one of " + ", ".join(METHODS))
    if method == "polyfit":
        if deg is no_default:
            raise DegreeError(name, "polyfit needs deg", "Pass deg=")
        return check_degree(deg, points, name)
    if deg is not no_default:
        raise DegreeError(name, f"deg is for polyfit, not {method}", "Leave it out")
    if method in ("linear", "cubic") and points < 2:
        raise DimensionError(name, f"{method} needs two points", "Use nearest")
    return None


def resample(grid: Grid, name: str, targets: object, method: str, deg: object, override: bool) -> Grid:
    """One dimension's targets as a weight matrix over its coordinates."""
    d = grid.dim(name, numeric=True)
    deg = _check(grid, name, method, deg)
    t = as_coordinates(targets, name)
    if any(isinstance(x, str) for x in t):
        raise DimensionError(name, "targets are strings", "Pass numbers")
    x, at = np.array(d.coords, dtype=float), np.array(t)
    weights = weights_for(method, x, at, deg)
    tags: list[int | None] = [1 if x.min() <= v <= x.max() else -1 for v in t]
    if not override:  # existing points stay as they are
        for i, v in enumerate(t):
            hit = np.flatnonzero(x == v)
            if len(hit):
                weights[i] = 0.0
                weights[i, hit[0]] = 1.0
                tags[i] = None
    out = apply_weights(grid, name, Dim(name, t, d.unit, d.description), weights, tags)
    return replace(out, dense=grid.dense, interpolated=grid.interpolated | {name})


def interpolate(grid: Grid, mapping: Mapping[str, object] | None, method: str, deg: object, override: bool, translation: Mapping[str, str] | None) -> Grid:
    if translation is not None:
        return _translate(grid, mapping, method, deg, translation)
    if not mapping:
        raise DimensionError("interpolate", "no target", "Pass {dimension: coordinates}")
    for x in mapping:
        _check(grid, x, method, deg)
    for x, targets in mapping.items():
        grid = resample(grid, x, targets, method, deg, override)
    return grid


def _translate(grid: Grid, mapping: Mapping[str, object] | None, method: str, deg: object, translation: Mapping[str, str]) -> Grid:
    """Replace a dimension by a variable that is strictly monotonic along it in every line.

    Linear translation is a join of targets with each line's segments; the other methods need
    a line's whole weight matrix and run once per line.
    """
    if set(translation) != {"from", "to"}:
        raise GridError(str(dict(translation)), "axisTranslation needs 'from' and 'to'", "Pass {'from': dimension, 'to': variable}")
    name, to = translation["from"], translation["to"]
    d = grid.dim(name, numeric=True)
    spec = grid.var(to)
    if to in grid.dim_names:
        raise AxisTranslationError(to, "is a dimension", "Name a variable")
    number = _check(grid, name, method, deg)
    rest = [x for x in grid.dim_names if x != name]
    line = (Window.partitionBy(*map(col, rest)) if rest else Window.partitionBy(F.lit(0))).orderBy(grid.ordinal(name))
    step = F.signum(col(to) - F.lag(col(to)).over(line))
    steps = grid.cells.select(*map(col, rest), step.alias("s"), (~n.finite(col(to))).alias("bad"), F.lit(1).alias("one"))
    per_line_rows = (steps.groupBy(*map(col, rest)) if rest else steps.groupBy()).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.max("bad").alias("bad"), F.count("one").alias("points"))
    row = per_line_rows.agg(F.max(F.col("bad") | (F.coalesce(F.col("lo"), F.lit(1)) * F.coalesce(F.col("hi"), F.lit(1)) <= 0) | (F.col("points") < len(d))).alias("wrong")).first()
    if row["wrong"] or row["wrong"] is None:
        raise AxisTranslationError(to, f"is not finite and strictly monotonic along {name} in every line", "Fill or select before, or choose another variable")
    if mapping and to in mapping:
        targets = as_coordinates(mapping[to], to)
    elif mapping:
        raise DimensionError(", ".join(mapping), f"targets must be given for {to}", f"Pass {{'{to}': values}} or nothing")
    else:
        first = grid.cells
        for x in rest:
            first = first.where(col(x) == F.lit(grid.dim(x).coords[0]))
        targets = tuple(r[0] + 0.0 for r in first.orderBy(grid.ordinal(name)).select(col(to)).collect())
    others = [v for v in grid.vars if v != to]
    vars_ = {v: replace(grid.vars[v], tagged=True) for v in others}
    dims = tuple(Dim(to, targets, spec.unit, spec.description) if x.name == name else x for x in grid.dimensions)
    store = {k: r for k, r in grid.correlation.items() if to not in k}
    out = replace(grid, dimensions=dims, vars=vars_, correlation=store, dense=True, roots={k: v for k, v in grid.roots.items() if k != to}, interpolated=(grid.interpolated - {name}) | {to}, axes=grid.axes.without({to}))
    notes = [f"axis_uncertainty of {to}=dropped"] * spec.uncertain + ["axis_correlation=dropped"] * (len(store) < len(grid.correlation))
    out = replace(out, note="; ".join(notes))
    if method == "linear":
        return replace(out, cells=_segments(grid, out, name, to, others, rest))
    fields = [T.StructField(x, grid.cells.schema[x].dataType) for x in rest] + [T.StructField(to, T.DoubleType())]
    wanted = out.columns()
    fields += [T.StructField(c, T.ByteType() if c.startswith("tag__") else T.DoubleType()) for c in wanted]
    t = np.array(targets)
    order = {c: i for i, c in enumerate(d.coords)}
    flags = {v: (grid.vars[v].sys, grid.vars[v].rand, grid.vars[v].tagged) for v in others}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf[name].map(order).to_numpy(), kind="stable")]
        x = pdf[to].to_numpy()
        w = weights_for(method, x, t, number)
        inside = (t >= x.min()) & (t <= x.max())
        same = [np.flatnonzero(x == v) for v in t]
        for i, hit in enumerate(same):
            if len(hit):
                w[i] = 0.0
                w[i, hit[0]] = 1.0
        made = pd.DataFrame({to: t})
        for c in rest:
            made[c] = pdf[c].iloc[0]
        for v, (sys, rand, tagged) in flags.items():
            y = pdf[v].to_numpy()
            bad = ~np.isfinite(y)
            made[v] = np.where((w[:, bad] != 0).any(axis=1), np.nan, w @ np.where(bad, 0.0, y))
            if sys:
                made[u_sys(v)] = np.abs(w @ pdf[u_sys(v)].to_numpy())
            if rand:
                made[u_rand(v)] = np.sqrt((w**2) @ pdf[u_rand(v)].to_numpy() ** 2)
            own = pdf[tag(v)].to_numpy() if tagged else np.zeros(len(x), dtype=int)
            made[tag(v)] = [int(own[hit[0]]) if len(hit) else (1 if ok else -1) for hit, ok in zip(same, inside, strict=True)]
        return made[[f.name for f in fields]]

    grouped = grid.cells.groupBy(*map(col, rest)) if rest else grid.cells.groupBy(F.lit("line"))
    return replace(out, cells=pandas_cells(grouped, run, fields).select(*map(col, out.dim_names), *map(col, wanted)))


def _segments(grid: Grid, out: Grid, name: str, to: str, others: list[str], rest: list[str]):
    """Linear translation: targets stand among each line's segments and take the last that begins before them, or the first."""
    line = (Window.partitionBy(*map(col, rest)) if rest else Window.partitionBy(F.lit(0))).orderBy("__x")
    carried = grid.columns(others)
    cells = grid.cells.select(*map(col, rest), col(to).alias("__x"), *map(col, carried))
    ends = {f"__n_{c}": F.lead(col(c)).over(line) for c in ["__x", *carried]}
    cells = cells.withColumns(ends).where(col("__n___x").isNotNull())
    parts = ["__x", *carried, *ends]
    segments = cells.select(*map(col, rest), col("__x").alias("__at"), F.lit(0).alias("__asks"), F.struct(*map(col, parts)).alias("__segment"))
    lines = cells.select(*map(col, rest)).distinct() if rest else grid.spark.range(1).select()
    asked = lines.select(*map(col, rest), F.explode(F.array(*[n.lit(x) for x in out.dim(to).coords])).alias("__at"))
    asked = asked.select(*map(col, rest), "__at", F.lit(1).alias("__asks"), F.lit(None).cast(segments.schema["__segment"].dataType).alias("__segment"))
    order = (Window.partitionBy(*map(col, rest)) if rest else Window.partitionBy(F.lit(0))).orderBy("__at", "__asks")
    before = F.last("__segment", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__segment", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    met = segments.unionByName(asked).withColumn("__met", F.coalesce(before, after)).where("__asks = 1")
    met = met.select(*map(col, rest), col("__at").alias(to), *[col("__met")[c].alias(c) for c in parts])
    t = col(to)
    hi = (t - col("__x")) / (col("__n___x") - col("__x"))
    lo = n.lit(1) - hi
    columns = [*map(col, rest), t]
    for v in others:
        s = grid.vars[v]
        pair = lambda c, f: f(lo * col(c), hi * col(f"__n_{c}"))  # noqa: B023, E731
        a, b = col(v), col(f"__n_{v}")
        mixed = F.when(n.finite(a) & n.finite(b), a * lo + b * hi).otherwise(n.nan())
        columns.append(F.when(t == col("__x"), a).when(t == col("__n___x"), b).otherwise(mixed).alias(v))
        if s.sys:
            columns.append(pair(u_sys(v), lambda p, q: F.abs(p + q)).alias(u_sys(v)))
        if s.rand:
            columns.append(pair(u_rand(v), lambda p, q: F.sqrt(p * p + q * q)).alias(u_rand(v)))
        own, after = (col(tag(v)), col(f"__n_{tag(v)}")) if s.tagged else (F.lit(0).cast("byte"),) * 2
        outside = (t < col("__x")) | (t > col("__n___x"))
        columns.append(F.when(t == col("__x"), own).when(t == col("__n___x"), after).otherwise(F.when(outside, F.lit(-1)).otherwise(F.lit(1))).cast("byte").alias(tag(v)))
    made = met.select(*columns)
    return made.select(*map(col, out.dim_names), *map(col, out.columns()))
