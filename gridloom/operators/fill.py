"""Filling gaps along a dimension."""

from __future__ import annotations

import warnings
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import DegreeError, GridError
from ..functions import numeric as n
from ..grid import Grid, col, tag, u_rand, u_sys
from .compute import require_certain
from .interpolate import check_degree
from .kernels import _check_window, _fit_at_centre, _scale, polynomial
from .linear import per_line, small


def fill(grid: Grid, along: str, args: tuple, method: str, deg: int | None, window: int | None, global_fit: bool) -> Grid:
    """Replace NaN between finite points; infinite values are neither filled nor used."""
    if args:
        warnings.warn("pass method= by name", FutureWarning, stacklevel=4)
        method = args[0]
    d = grid.dim(along, numeric=True)
    if method not in ("linear", "nearest", "polyfit"):
        raise GridError(str(method), "unknown filling method", "Use 'linear', 'nearest' or 'polyfit'")
    if method != "polyfit" and (deg is not None or window is not None or global_fit):
        raise DegreeError(along, f"deg, window and global_fit are for polyfit, not {method}", "Leave them out")
    if method == "polyfit":
        return _polyfit(grid, along, deg, window, global_fit)
    dense = grid.densified([along])
    rest = [x for x in grid.dim_names if x != along]
    line = Window.partitionBy(*map(col, rest)) if rest else Window.partitionBy(F.lit(0))
    ascending = list(d.coords) == sorted(d.coords)
    if method == "nearest" and not ascending:
        return _nearest_unsorted(dense, along)
    line = line.orderBy(grid.ordinal(along))
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    x = col(along)
    looked, made = {}, {}
    for i, (v, s) in enumerate(grid.vars.items()):
        parts = [x.alias("x"), col(v).alias("y"), *[col(u_sys(v)).alias("s")] * s.sys, *[col(u_rand(v)).alias("r")] * s.rand]
        support = F.when(n.finite(col(v)), F.struct(*parts))
        looked[f"__p{i}"] = F.last(support, ignorenulls=True).over(before)
        looked[f"__n{i}"] = F.first(support, ignorenulls=True).over(after)
        p, q = col(f"__p{i}"), col(f"__n{i}")
        if method == "linear":
            found = p.isNotNull() & q.isNotNull()
            hi = (x - p["x"]) / (q["x"] - p["x"])
            lo = n.lit(1) - hi
            mix = lambda f, join: join(lo * p[f], hi * q[f])  # noqa: B023, E731
            value = mix("y", lambda a, b: a + b)
            sys, rand = mix("s", lambda a, b: F.abs(a + b)) if s.sys else None, mix("r", lambda a, b: F.sqrt(a * a + b * b)) if s.rand else None
        else:
            found = p.isNotNull() | q.isNotNull()
            left = q.isNull() | (p.isNotNull() & (x - p["x"] <= q["x"] - x))
            pick = lambda f: F.when(left, p[f]).otherwise(q[f])  # noqa: B023, E731
            value, sys, rand = pick("y"), F.abs(pick("s")) if s.sys else None, F.abs(pick("r")) if s.rand else None
        gap = F.isnan(col(v)) & found
        made[v] = F.when(gap, value).otherwise(col(v))
        if s.sys:
            made[u_sys(v)] = F.when(gap, sys).otherwise(col(u_sys(v)))
        if s.rand:
            made[u_rand(v)] = F.when(gap, rand).otherwise(col(u_rand(v)))
        made[tag(v)] = F.when(gap, F.lit(1).cast("byte")).otherwise(grid.tag_column(v))
    return _with_tags(dense, dense.cells.withColumns(looked).withColumns(made))


def _with_tags(grid: Grid, cells) -> Grid:
    out = replace(grid, vars={v: replace(s, tagged=True) for v, s in grid.vars.items()})
    return replace(out, cells=cells.select(*map(col, out.dim_names), *map(col, out.columns())))


def _with_slots(grid: Grid) -> Grid:
    """Tag columns for the kernels to write to."""
    return _with_tags(grid, grid.cells.withColumns({tag(v): grid.tag_column(v) for v in grid.vars}))


def _nearest_unsorted(grid: Grid, along: str) -> Grid:
    """Coordinates out of order: nearest by distance over the whole line, ties to the lower position."""
    slots = _with_slots(grid)
    parts = {v: [c for c, has in ((v, True), (u_sys(v), s.sys), (u_rand(v), s.rand)) if has] for v, s in grid.vars.items()}

    def kernel(x: np.ndarray, pdf: pd.DataFrame) -> dict:
        out = {}
        for v, columns in parts.items():
            y = pdf[v].to_numpy(dtype=float)
            have = np.flatnonzero(np.isfinite(y))
            gaps = np.flatnonzero(np.isnan(y)) if len(have) else np.empty(0, dtype=int)
            near = have[np.abs(x[gaps][:, None] - x[have][None, :]).argmin(axis=1)] if len(gaps) else gaps
            for c in columns:
                new = pdf[c].to_numpy(dtype=float).copy()
                new[gaps] = new[near]
                out[c] = new
            marks = pdf[tag(v)].to_numpy().copy()
            marks[gaps] = 1
            out[tag(v)] = marks
        return out

    return per_line(slots, along, list(grid.vars), kernel)


def _polyfit(grid: Grid, along: str, deg: int | None, window: int | None, global_fit: bool) -> Grid:
    """Each gap takes the value of a polynomial through the finite points around it, or all of them."""
    require_certain(grid, "fill(method='polyfit')")
    if deg is None or (window is None) == (not global_fit):
        raise DegreeError(along, "polyfit needs deg and either window or global_fit=True", "Pass deg=, and window= or global_fit=True")
    points = len(grid.dim(along))
    width = points if global_fit else _check_window(window, points, along)
    deg = check_degree(deg, width, along)
    slots = _with_slots(grid.densified([along]))
    names = list(grid.vars)
    if deg <= 2 and not global_fit:
        return _fitted_gaps(slots, along, deg, width)

    def kernel(x: np.ndarray, pdf: pd.DataFrame) -> dict:
        out = {}
        for v in names:
            y = pdf[v].to_numpy(dtype=float)
            new, marks = y.copy(), pdf[tag(v)].to_numpy().copy()
            for i in np.flatnonzero(np.isnan(y)):
                lo = 0 if global_fit else max(0, i - width // 2)
                hi = len(x) if global_fit else min(len(x), lo + width)
                p = polynomial(x[lo:hi] - x[i], y[lo:hi], deg)
                if p is not None:
                    new[i], marks[i] = p[0], 1
            out[v], out[tag(v)] = new, marks
        return out

    return per_line(slots, along, names, kernel)


def _fitted_gaps(grid: Grid, along: str, deg: int, width: int) -> Grid:
    """Closed fits over the sums of the window around each point; those of gaps replace them."""
    x = grid.dim(along).coords
    spans = [(max(0, i - width // 2), min(len(x), max(0, i - width // 2) + width)) for i in range(len(x))]
    pairs = [(float(x[j]), float(x[i])) for i, (lo, hi) in enumerate(spans) for j in range(lo, hi)]
    table = small(grid.spark.createDataFrame(pairs, "__j double, __i double"), len(pairs))
    rest = [d for d in grid.dim_names if d != along]
    joined = grid.cells.join(table, col(along) == col("__j")).withColumn("__z", (col(along) - col("__i")) / n.lit(_scale(grid, along)))
    here = col(along) == col("__i")
    aggregates = []
    for i, v in enumerate(grid.vars):
        aggregates += [F.max(F.when(here, col(v))).alias(f"__v{i}"), _fit_at_centre(col("__z"), col(v), deg)[0].alias(f"__f{i}"), F.max(F.when(here, col(tag(v)))).alias(f"__t{i}")]
    made = joined.groupBy(*map(col, rest), "__i").agg(*aggregates).withColumnRenamed("__i", along)
    columns = [*map(col, grid.dim_names)]
    for i, v in enumerate(grid.vars):
        gap = F.isnan(col(f"__v{i}")) & ~F.isnan(col(f"__f{i}"))
        columns += [F.when(gap, col(f"__f{i}")).otherwise(col(f"__v{i}")).alias(v), F.when(gap, F.lit(1)).otherwise(col(f"__t{i}")).cast("byte").alias(tag(v))]
    return _with_tags(grid, made.select(*columns))
