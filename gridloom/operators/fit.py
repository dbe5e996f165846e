"""Polynomial models along a dimension and their evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionError, GridError
from ..functions import numeric as n
from ..grid import Dim, Grid, as_coordinates, col, tag
from .compute import require_certain
from .interpolate import check_degree
from .kernels import polynomial
from .linear import apply_weights, pandas_cells


def _closed_form(x: Column, y: Column, deg: int, shift: float, scale: float) -> list[Column]:
    """Ascending coefficients of a fit of degree 0 to 2, from sums over the finite points.

    Sums use (x - shift) / scale; the coefficients are those in x.
    """
    ok = n.finite(y)
    z = (x - n.lit(shift)) / n.lit(scale)
    s = lambda c: F.sum(F.when(ok, c))
    count = F.sum(F.when(ok, n.lit(1)))
    enough = F.coalesce(count, n.lit(0)) > deg
    if deg == 0:
        return [n.or_nan(F.when(enough, s(y) / count))]
    s1, s2, t0, t1 = s(z), s(z * z), s(y), s(z * y)
    if deg == 1:
        det = count * s2 - s1 * s1
        b0, b1 = (t0 * s2 - s1 * t1) / det, (count * t1 - s1 * t0) / det
        c1 = b1 / n.lit(scale)
        return [n.or_nan(F.when(enough, c)) for c in (b0 - c1 * n.lit(shift), c1)]
    s3, s4, t2 = s(z * z * z), s(z * z * z * z), s(z * z * y)
    det = count * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    b0 = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det
    b1 = (count * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det
    b2 = (count * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det
    c2 = b2 / n.lit(scale * scale)
    c1 = b1 / n.lit(scale) - n.lit(2.0 * shift) * c2
    c0 = b0 - b1 * n.lit(shift / scale) + c2 * n.lit(shift * shift)
    return [n.or_nan(F.when(enough, c)) for c in (c0, c1, c2)]


def fitmodel(grid: Grid, along: str, deg: int) -> Grid:
    """Least-squares coefficients of every line, along <dimension>_coef."""
    d = grid.dim(along, numeric=True)
    require_certain(grid, "fitmodel")
    deg = check_degree(deg, len(d), along)
    name = f"{along}_coef"
    if name in grid.dim_names or name in grid.vars:
        raise GridError(name, "the name is taken", "Rename it before fitting")
    labels = tuple(f"{along}^{k}" for k in range(deg + 1))
    x = np.array(d.coords, dtype=float)
    rest = [c for c in grid.dim_names if c != along]
    if deg <= 2:
        shift, scale = float(x.mean()), float(x.std()) or 1.0
        aggregates = []
        for i, (v, s) in enumerate(grid.vars.items()):
            aggregates += [c.alias(f"__{i}_{k}") for k, c in enumerate(_closed_form(col(along), col(v), deg, shift, scale))]
            if s.tagged:
                aggregates.append(n.worst_tag(col(tag(v))).alias(f"__tag_{i}"))
        wide = (grid.cells.groupBy(*map(col, rest)) if rest else grid.cells.groupBy()).agg(*aggregates)
        row = lambda k: F.struct(
            F.lit(labels[k]).alias(name), *[c for i, (v, s) in enumerate(grid.vars.items()) for c in (col(f"__{i}_{k}").alias(v), *[col(f"__tag_{i}").alias(tag(v))] * s.tagged)]
        )
        cells = wide.select(*map(col, rest), F.explode(F.array(*[row(k) for k in range(deg + 1)])).alias("__c")).select(*map(col, rest), "__c.*")
    else:
        names = {v: s.tagged for v, s in grid.vars.items()}
        fields = [grid.cells.schema[c] for c in rest] + [T.StructField(name, T.StringType())]
        fields += [f for v, t in names.items() for f in (T.StructField(v, T.DoubleType()), *[T.StructField(tag(v), T.ByteType())] * t)]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            made = pd.DataFrame({name: labels})
            for c in rest:
                made[c] = pdf[c].iloc[0]
            at = pdf[along].to_numpy(dtype=float)
            for v, tagged in names.items():
                p = polynomial(at, pdf[v].to_numpy(dtype=float), deg)
                made[v] = np.full(deg + 1, np.nan) if p is None else p
                if tagged:
                    t = pdf[tag(v)].to_numpy()
                    made[tag(v)] = -1 if (t < 0).any() else int((t > 0).any())
            return made[[f.name for f in fields]]

        cells = pandas_cells(grid.cells.groupBy(*map(col, rest)) if rest else grid.cells.groupBy(F.lit("line")), run, fields)
    dims = tuple(Dim(name, labels, None, f"polynomial coefficients, fitted range {along}=[{float(x.min())!r}, {float(x.max())!r}]") if c.name == along else c for c in grid.dimensions)
    vars_ = {v: replace(s, unit=None, fitted=((name, along, float(x.min()), float(x.max())),) + tuple(s.fitted or ())) for v, s in grid.vars.items()}
    note = "correlation=dropped" if grid.correlation else ""
    out = replace(grid, dimensions=dims, vars=vars_, note=note, correlation={}, axes=grid.axes.without(set(grid.vars)), roots={}, dense=grid.dense or not rest)
    return replace(out, cells=cells.select(*map(col, out.dim_names), *map(col, out.columns())))


def fitvalue(grid: Grid, coef_dims: Sequence[str], at: Mapping[str, object]) -> Grid:
    """Evaluate fitted models; points outside the fitted range are extrapolated."""
    names = [coef_dims] if isinstance(coef_dims, str) else list(coef_dims)
    require_certain(grid, "fitvalue")
    ranges = {f[0]: f for s in grid.vars.values() for f in s.fitted or ()}
    unused = [k for k in at if f"{k}_coef" not in names]
    if unused or not names:
        raise DimensionError(", ".join(unused) or "fitvalue", "is not a fitted dimension asked for", "Name '<dimension>_coef' in coef_dims for every key of at")
    out = grid
    for name in names:
        d = out.dim(name)
        if name not in ranges:
            raise DimensionError(name, "holds no coefficients of fitmodel", "Call fitmodel first")
        _, of, lo, hi = ranges[name]
        if of not in at:
            raise DimensionError(of, "has no points to evaluate at", f"Pass at={{'{of}': values}}")
        t = as_coordinates(at[of], of)
        weights = np.array([[float(x) ** k for k in range(len(d))] for x in t])
        before = {v: s.tagged for v, s in out.vars.items()}
        made = apply_weights(out, name, Dim(of, t), weights, [None] * len(t))
        # Every coefficient counts, also where its weight is 0; and the worst of model and range stays.
        place = F.when((col(of) < n.lit(lo)) | (col(of) > n.lit(hi)), F.lit(-1)).otherwise(F.lit(1)).cast("byte")
        marks = {tag(v): n.worst_of(col(tag(v)), place) if before[v] else place for v in made.vars}
        vars_ = {v: replace(s, fitted=tuple(f for f in s.fitted or () if f[0] != name) or None) for v, s in made.vars.items()}
        note = "correlation=dropped" if grid.correlation else ""
        out = replace(made, cells=made.cells.withColumns(marks), vars=vars_, note=note, correlation={}, axes=made.axes.without(set(made.vars)), dense=out.dense)
    return out
