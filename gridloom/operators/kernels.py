"""Moving kernels along a dimension: smoothing and derivatives.

A window is centred on its point and slides inward at the ends, so it always holds as many
points as it can. Which points serve which centre is a small table made on the driver; up to
degree 2 the fits are closed formulas over the sums of a window, above that one task call per
line does them.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DegreeError, GridError
from ..functions import numeric as n
from ..grid import Grid, Var, col, no_default, tag
from .compute import require_certain
from .interpolate import check_degree
from .linear import per_line, small, smoothing_spline


def window_bounds(i: int, points: int, window: int) -> tuple[int, int]:
    half = (window - 1) // 2
    lo = max(0, i - half)
    hi = min(points, lo + window)
    return max(0, hi - window), hi


def _check_window(window: object, points: int, what: str) -> int:
    if isinstance(window, bool) or not isinstance(window, int | np.integer) or window < 1:
        raise DegreeError(what, f"window {window!r} is not a whole number above 0", "Pass an int")
    return int(window)


def stencil_table(grid: Grid, name: str, window: int) -> DataFrame:
    """(source coordinate, centre coordinate, centred) rows of all windows."""
    x = grid.dim(name).coords
    rows = []
    for i, c in enumerate(x):
        lo, hi = window_bounds(i, len(x), window)
        centred = i - lo == (window - 1) // 2 and hi - lo == window
        rows += [(float(x[j]), float(c), centred) for j in range(lo, hi)]
    schema = T.StructType([T.StructField("__j", T.DoubleType()), T.StructField("__i", T.DoubleType()), T.StructField("__centred", T.BooleanType())])
    return grid.spark.createDataFrame(rows, schema)


def _fit_at_centre(z: Column, y: Column, deg: int) -> tuple[Column, Column]:
    """Value and slope at z = 0 of the least-squares polynomial of degree 0, 1 or 2."""
    ok = n.finite(y)
    s = lambda c: F.sum(F.when(ok, c))
    count = F.sum(F.when(ok, n.lit(1)))
    if deg == 0:
        return n.or_nan(s(y) / count), F.when(count > 0, n.lit(0)).otherwise(n.nan())
    enough = F.coalesce(count, n.lit(0)) > deg
    if deg == 1:
        s1, s2, t0, t1 = s(z), s(z * z), s(y), s(z * y)
        det = count * s2 - s1 * s1
        return n.or_nan(F.when(enough, (t0 * s2 - s1 * t1) / det)), n.or_nan(F.when(enough, (count * t1 - s1 * t0) / det))
    s1, s2, s3, s4 = s(z), s(z * z), s(z * z * z), s(z * z * z * z)
    t0, t1, t2 = s(y), s(z * y), s(z * z * y)
    # Cramer's rule on the normal equations.
    det = count * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    d0 = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    d1 = count * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)
    return n.or_nan(F.when(enough, d0 / det)), n.or_nan(F.when(enough, d1 / det))


def _windowed(grid: Grid, name: str, window: int, scale: float, aggregates) -> DataFrame:
    """Aggregates over each window; z is the distance to the centre in units of ``scale``."""
    rest = [d for d in grid.dim_names if d != name]
    stencils = small(stencil_table(grid, name, window), len(grid.dim(name)) * window)
    joined = grid.cells.join(stencils, col(name) == col("__j"))
    joined = joined.withColumn("__z", (col(name) - col("__i")) / n.lit(scale))
    made = joined.groupBy(*map(col, rest), "__i").agg(*aggregates(col("__z"), col(name) == col("__i")), F.first("__centred").alias("__centred"))
    return made.withColumnRenamed("__i", name)


def _scale(grid: Grid, name: str) -> float:
    """A typical step, so that sums of powers stay near 1."""
    x = np.sort(np.array(grid.dim(name).coords, dtype=float))
    return float(np.median(np.diff(x))) if len(x) > 1 else 1.0


def polynomial(x: np.ndarray, y: np.ndarray, deg: int) -> np.ndarray | None:
    """Ascending coefficients about 0 from the finite points, or None with too few."""
    ok = np.isfinite(y)
    if ok.sum() <= deg:
        return None
    return np.polynomial.polynomial.polyfit(x[ok], y[ok], deg)


def smooth(grid: Grid, along: str, method: str, window: object, polyorder: object, smoothing: object) -> Grid:
    """Replace every value by its smooth; missing values stay missing."""
    grid.dim(along, numeric=True)
    require_certain(grid, "smooth")
    given = {"window": window, "polyorder": polyorder, "smoothing": smoothing}
    takes = {"savgol": ("window", "polyorder"), "moving_avg": ("window",), "spline": ("smoothing",)}
    if method not in takes:
        raise GridError(str(method), "unknown smoothing method", "Use one of " + ", ".join(takes))
    for k, x in given.items():
        if (x is not no_default) != (k in takes[method]):
            raise GridError(k, f"{'is not used by' if x is not no_default else 'is needed by'} {method}", f"{method} takes " + ", ".join(takes[method]))
    points = len(grid.dim(along))
    vars_ = {v: replace(s, tagged=True, absent_tag=s.absent_tag) for v, s in grid.vars.items()}

    def tagged(v: str, value: Column) -> Column:
        own = grid.tag_column(v)
        return F.when(own < 0, own).when(n.finite(value), F.lit(1).cast("byte")).otherwise(own).cast("byte")

    if method == "spline":
        if isinstance(smoothing, bool) or not isinstance(smoothing, int | float) or not np.isfinite(smoothing) or smoothing < 0:
            raise GridError("smoothing", f"{smoothing!r} is not a finite number of 0 or more", "Pass a float")
        names, s = list(grid.vars), float(smoothing)

        def kernel(x: np.ndarray, pdf: pd.DataFrame) -> dict:
            order = np.argsort(x, kind="stable")
            out = {}
            for v in names:
                y = pdf[v].to_numpy(dtype=float).copy()
                have = order[np.isfinite(y[order])]
                if len(have):
                    y[have] = smoothing_spline(x[have], y[have], s)
                out[v] = y
            return out

        made = per_line(grid, along, names, kernel).cells
    else:
        width = _check_window(window, points, along)
        deg = 0 if method == "moving_avg" else check_degree(polyorder, width, along)
        if deg <= 2:
            def aggregates(z: Column, centre: Column) -> list[Column]:
                out = []
                for v, s in grid.vars.items():
                    here = F.max(F.when(centre, col(v)))
                    out.append(F.when(n.finite(here), _fit_at_centre(z, col(v), deg)[0]).otherwise(here).alias(v))
                    if s.tagged:
                        out.append(F.max(F.when(centre, col(tag(v)))).alias(tag(v)))
                out.append(F.max(F.when(centre, F.lit(1))).alias("__row"))
                return out

            made = _windowed(grid, along, width, _scale(grid, along), aggregates).where("__row = 1").drop("__row", "__centred")
        else:
            names = list(grid.vars)

            def kernel(x: np.ndarray, pdf: pd.DataFrame) -> dict:
                out = {}
                for v in names:
                    y = pdf[v].to_numpy(dtype=float)
                    new = y.copy()
                    for i in np.flatnonzero(np.isfinite(y)):
                        lo, hi = window_bounds(int(i), len(x), width)
                        p = polynomial(x[lo:hi] - x[i], y[lo:hi], deg)
                        new[i] = np.nan if p is None else p[0]
                    out[v] = new
                return out

            made = per_line(grid, along, names, kernel).cells
    cells = made.select(*map(col, grid.dim_names), *[c for v in grid.vars for c in (col(v), tagged(v, col(v)).alias(tag(v)))])
    return replace(grid, cells=cells, vars=vars_)


def diff(grid: Grid, along: str, window: int, deg: int, nan_edges: bool) -> Grid:
    """Slopes of moving polynomial fits, as variables d<name>_d<dimension>."""
    d = grid.dim(along, numeric=True)
    require_certain(grid, "diff")
    width = _check_window(window, len(d), along)
    deg = check_degree(deg, min(width, len(d)), along)
    dense = grid.densified([along])
    names = {v: f"d{v}_d{along}" for v in grid.vars}
    for new in names.values():
        if new in grid.dim_names:
            raise GridError(new, "is the name of a dimension", "Rename the dimension")
    scale = _scale(grid, along)
    source = replace(dense, cells=dense.cells)

    def aggregates(z: Column, centre: Column) -> list[Column]:
        out = []
        for v, s in grid.vars.items():
            if deg <= 2:
                out.append((_fit_at_centre(z, col(v), deg)[1] / n.lit(scale)).alias(names[v]))
            else:
                out.append(F.max(F.when(centre, col(f"__slope_{v}"))).alias(names[v]))
            if s.tagged:
                out.append(n.worst_tag(col(tag(v))).alias(tag(names[v])))
        return out

    if deg > 2:
        slopes = {v: f"__slope_{v}" for v in grid.vars}
        with_slots = replace(dense, cells=dense.cells.withColumns({c: n.nan() for c in slopes.values()}))

        def kernel(x: np.ndarray, pdf: pd.DataFrame) -> dict:
            out = {}
            for v, c in slopes.items():
                y = pdf[v].to_numpy(dtype=float)
                new = np.full(len(x), np.nan)
                for i in range(len(x)):
                    lo, hi = window_bounds(i, len(x), width)
                    p = polynomial(x[lo:hi] - x[i], y[lo:hi], deg)
                    if p is not None:
                        new[i] = p[1]
                out[c] = new
            return out

        source = per_line(with_slots, along, list(grid.vars), kernel, tuple(slopes.values()))
    cells = _windowed(source, along, width, scale, aggregates)
    if nan_edges:
        cells = cells.withColumns({x: F.when(col("__centred"), col(x)).otherwise(n.nan()) for x in names.values()})
    vars_ = {
        names[v]: Var(unit=f"{s.unit}/{d.unit}" if s.unit and d.unit else None, tagged=s.tagged) for v, s in grid.vars.items()
    }
    note = "correlation=dropped" if grid.correlation else ""
    out = replace(grid, vars=vars_, note=note, correlation={}, axes=grid.axes.without(set(grid.vars)), roots={}, dense=dense.dense)
    return replace(out, cells=cells.select(*map(col, out.dim_names), *map(col, out.columns())))


