"""Sparse linear operators along one dimension: a broadcast weight table and one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as n
from ..grid import Dim, Grid, col, tag, u_rand, u_sys


def linear_weights(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Hat functions: each point's is the broken line of 1 there and 0 elsewhere, its end pieces extended."""
    inside = np.clip(t, x[0], x[-1])
    hats = np.column_stack([np.interp(inside, x, unit) for unit in np.eye(len(x))])
    slope = np.array([-1.0, 1.0])
    hats[:, :2] += np.minimum(t - x[0], 0.0)[:, None] * slope / (x[1] - x[0])
    hats[:, -2:] += np.maximum(t - x[-1], 0.0)[:, None] * slope / (x[-1] - x[-2])
    return hats


def nearest_weights(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    w = np.zeros((len(t), len(x)))
    w[np.arange(len(t)), np.abs(t[:, None] - x[None, :]).argmin(axis=1)] = 1.0
    return w


def polynomial_weights(x: np.ndarray, t: np.ndarray, deg: int) -> np.ndarray:
    return np.vander(t, deg + 1) @ np.linalg.pinv(np.vander(x, deg + 1))


def tridiagonal(below: np.ndarray, main: np.ndarray, above: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a tridiagonal system for all right-hand columns, by elimination."""
    main, right = main.copy(), right.copy()
    for i in range(1, len(main)):
        ratio = below[i - 1] / main[i - 1]
        main[i] -= ratio * above[i - 1]
        right[i] -= ratio * right[i - 1]
    for i in range(len(main) - 1, -1, -1):
        if i + 1 < len(main):
            right[i] -= above[i] * right[i + 1]
        right[i] /= main[i]
    return right


def cubic_weights(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Natural cubic spline in Hermite form: cubics that join in value and slope.

    The slopes are those for which the curvature is continuous inside and zero at the ends,
    which is one tridiagonal system; end cubics are extended.
    """
    if len(x) < 3:
        return linear_weights(x, t)
    steepness = 1.0 / np.diff(x)
    rises = np.diff(np.eye(len(x)), axis=0) * (3.0 * steepness**2)[:, None]
    none = np.zeros((1, len(x)))
    around = np.concatenate([[0.0], steepness, [0.0]])
    slopes = tridiagonal(steepness, 2.0 * (around[:-1] + around[1:]), steepness, np.concatenate([rises, none]) + np.concatenate([none, rises]))
    piece = np.searchsorted(x[1:-1], t, side="right")
    at = ((t - x[piece]) * steepness[piece])[:, None]
    width = 1.0 / steepness[piece][:, None]
    unit = np.eye(len(x))
    ease = at * at * (3.0 - 2.0 * at)
    return unit[piece] + ease * (unit[piece + 1] - unit[piece]) + width * at * (1.0 - at) * ((1.0 - at) * slopes[piece] - at * slopes[piece + 1])


def smoothing_spline(x: np.ndarray, y: np.ndarray, s: float) -> np.ndarray:
    """The values at x of the curve with least (y - f)^2 summed plus s times its squared curvature integrated.

    Its curvatures at the inner points solve a system of five diagonals, whose right-hand side
    is the change of slope from point to point; it is eliminated and solved line by line, so
    the work grows with the number of points.
    """
    if s == 0 or len(x) < 3:
        return y.copy()
    h = np.diff(x)
    left, right = 1.0 / h[:-1], 1.0 / h[1:]
    centre = -(left + right)
    inner = len(x) - 2
    main = (h[:-1] + h[1:]) / 3.0 + s * (left**2 + centre**2 + right**2)
    near = h[1:-1] / 6.0 + s * (centre[:-1] * left[1:] + right[:-1] * centre[1:])
    far = s * right[:-2] * left[2:]
    # Factors L D L' of the symmetric system, two places below the diagonal.
    d, one, two = np.zeros(inner), np.zeros(inner), np.zeros(inner)
    curvature = np.diff(np.diff(y) / h)
    for i in range(inner):
        if i > 1:
            two[i] = far[i - 2] / d[i - 2]
        if i:
            one[i] = (near[i - 1] - (two[i] * d[i - 2] * one[i - 1] if i > 1 else 0.0)) / d[i - 1]
        d[i] = main[i] - (one[i] ** 2 * d[i - 1] if i else 0.0) - (two[i] ** 2 * d[i - 2] if i > 1 else 0.0)
        curvature[i] -= (one[i] * curvature[i - 1] if i else 0.0) + (two[i] * curvature[i - 2] if i > 1 else 0.0)
    curvature /= d
    for i in range(inner - 2, -1, -1):
        curvature[i] -= one[i + 1] * curvature[i + 1] + (two[i + 2] * curvature[i + 2] if i + 2 < inner else 0.0)
    out = y.astype(float).copy()
    out[:-2] -= s * left * curvature
    out[1:-1] -= s * centre * curvature
    out[2:] -= s * right * curvature
    return out


#: Rows of a table made on the driver up to which it is broadcast (about 20 MB); a longer one is merged.
BROADCAST_ROWS = 400_000


def small(table: DataFrame, rows: int) -> DataFrame:
    """The table hinted by its known number of rows."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge")


def apply_weights(grid: Grid, name: str, target: Dim, weights: np.ndarray, target_tags: Sequence[int | None], variables: Sequence[str] | None = None, tiny: float = 0.0) -> Grid:
    """New cells along ``name``: each target is a weighted sum of the sources with weight.

    A target whose sources are not all finite is NaN. ``target_tags`` gives each target's tag;
    None keeps the sources' own. The table holds what is not zero, and the aggregate is
    partial before its shuffle.
    """
    source = grid.dim(name)
    variables = list(grid.vars) if variables is None else list(variables)
    entries = [(source.coords[j], target.coords[i], float(weights[i, j]), None if target_tags[i] is None else int(target_tags[i])) for i, j in zip(*np.nonzero(np.abs(weights) > tiny), strict=True)]
    needed = {t: 0 for t in target.coords}
    for _, t, _, _ in entries:
        needed[t] += 1
    of = lambda c: T.StringType() if isinstance(c, str) else T.DoubleType()
    schema = T.StructType(
        [T.StructField("__s", of(source.coords[0])), T.StructField("__t", of(target.coords[0])), T.StructField("__w", T.DoubleType()), T.StructField("__tag", T.IntegerType()), T.StructField("__n", T.IntegerType())]
    )
    table = grid.spark.createDataFrame([(s, t, w, g, needed[t]) for s, t, w, g in entries], schema)
    joined = grid.cells.join(small(table, len(entries)), col(name) == col("__s"))
    rest = [d for d in grid.dim_names if d != name]
    aggregates: list[Column] = []
    out_vars = {}
    w = col("__w")
    for v in variables:
        s = grid.vars[v]
        whole = F.count(F.when(n.finite(col(v)), F.lit(1))) == F.first("__n")
        one = F.first("__n") == 1  # a copied point may be infinite
        copied = F.when(F.count(F.lit(1)) == 1, F.first(col(v) * w))
        aggregates.append(F.when(whole, n.total(col(v) * w)).when(one & F.first(w == 1), copied).otherwise(n.nan()).alias(v))
        if s.sys:
            aggregates.append(F.abs(n.total(col(u_sys(v)) * w)).alias(u_sys(v)))
        if s.rand:
            aggregates.append(n.root_sum_squares(col(u_rand(v)) * w).alias(u_rand(v)))
        aggregates.append(F.coalesce(F.first("__tag").cast("byte"), n.worst_tag(grid.tag_column(v))).alias(tag(v)))
        out_vars[v] = replace(s, tagged=True)
    cells = joined.groupBy(*map(col, rest), "__t").agg(*aggregates).withColumnRenamed("__t", target.name)
    dims = tuple(target if d.name == name else d for d in grid.dimensions)
    out = replace(grid, dimensions=dims, vars=out_vars)
    return replace(out, cells=cells.select(*map(col, out.dim_names), *map(col, out.columns())))


def pandas_cells(grouped, run, fields: Sequence[T.StructField]):
    """applyInPandas whose NaN, which come back as NULL, are NaN again."""
    made = grouped.applyInPandas(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))
    return made.select(*[n.or_nan(col(f.name)).alias(f.name) if f.dataType == T.DoubleType() else col(f.name) for f in fields])


def per_line(grid: Grid, name: str, variables: Sequence[str], kernel, extra: Sequence[str] = ()) -> Grid:
    """Kernels that no aggregate expresses: one task call per line, whose length the driver knows.

    ``kernel(x, {column: values})`` gets the dense line in grid order and gives new columns.
    """
    import pandas as pd

    dense = grid.densified([name])
    coords = list(grid.dim(name).coords)
    rest = [d for d in grid.dim_names if d != name]
    position = {c: i for i, c in enumerate(coords)}
    x = np.array(coords, dtype=float)
    fields = [f for f in dense.cells.schema.fields if f.name in [*grid.dim_names, *grid.columns(), *extra]]
    order = [f.name for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(pdf[name].map(position).to_numpy(), kind="stable")].reset_index(drop=True)
        for c, values in kernel(x, pdf).items():
            pdf[c] = values
        return pdf[order]

    cells = dense.cells.select(*map(col, order))
    grouped = cells.groupBy(*map(col, rest)) if rest else cells.groupBy(F.lit("line"))
    return replace(dense, cells=pandas_cells(grouped, run, fields))
