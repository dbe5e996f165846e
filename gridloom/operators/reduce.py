"""Reductions along dimensions: averages and integrals, with their uncertainty and tags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DimensionError, UncertaintyLineageError
from ..functions import numeric as n
from ..functions.units import coefficients
from ..grid import Grid, Var, col, tag, u_rand, u_sys
from .reshape import collapsed


def guard_reduction(grid: Grid, names: Sequence[str], variables: Sequence[str]) -> None:
    """Interpolated points share their neighbours' random errors, so these do not average out."""
    mixed = [d for d in names if d in grid.interpolated]
    having = [v for v in variables if grid.vars[v].rand]
    if mixed and having:
        raise UncertaintyLineageError(", ".join(having), f"random uncertainty along {', '.join(mixed)}, whose points are interpolated", "Reduce before interpolating, or assign only systematic uncertainty")


def _names(along: str | Sequence[str]) -> list[str]:
    names = [along] if isinstance(along, str) else list(along)
    if not names or len(set(names)) != len(names):
        raise DimensionError(str(along), "name each dimension once", "Pass a name or a list of names")
    return names


def _grouped(grid: Grid, names: Sequence[str], aggregates: list[Column]) -> tuple[Grid, DataFrame]:
    """One row per remaining cell."""
    dims = tuple(d for d in grid.dimensions if d.name not in names)
    rest = [d.name for d in dims]
    cells = grid.cells.groupBy(*map(col, rest)).agg(*aggregates) if rest else grid.cells.agg(*aggregates)
    out = replace(grid, dimensions=dims, interpolated=grid.interpolated - set(names))
    return (out if dims else collapsed(out)), cells


def average(grid: Grid, along: str | Sequence[str]) -> Grid:
    """Joint mean over the cells that have a value; an infinite value is one."""
    names = _names(along)
    for x in names:
        grid.dim(x)
    guard_reduction(grid, names, list(grid.vars))
    aggregates = []
    for v, s in grid.vars.items():
        has = ~F.isnan(col(v))
        count = F.sum(F.when(has, n.lit(1)))
        aggregates.append(n.or_nan(F.sum(F.when(has, col(v))) / count).alias(v))
        if s.sys:
            aggregates.append(F.coalesce(F.abs(F.sum(F.when(has, col(u_sys(v))))) / count, n.lit(0)).alias(u_sys(v)))
        if s.rand:
            aggregates.append(F.coalesce(n.root_sum_squares(col(u_rand(v)), has) / count, n.lit(0)).alias(u_rand(v)))
        if s.tagged:
            aggregates.append(n.worst_tag(col(tag(v)), has).alias(tag(v)))
    out, cells = _grouped(grid, names, aggregates)
    dense = grid.dense or not out.dim_names
    if grid.uncertain and not dense:
        # A line without any value has uncertainty 0, so such lines get a row where u is carried.
        cells, dense = _every_line(out, cells, grid), True
    return replace(out, cells=cells, dense=dense, vars={v: replace(s, absent_tag=0) for v, s in grid.vars.items()})


def _every_line(out: Grid, cells: DataFrame, grid: Grid) -> DataFrame:
    """A row for every cell of the result: what the aggregate has, or else no value without uncertainty."""
    frame = None
    for x in out.dim_names:
        table = F.broadcast(out.coordinate_table(x).drop("__ordinal"))
        frame = table if frame is None else frame.crossJoin(table)
    columns = [*map(col, out.dim_names)]
    for v, s in grid.vars.items():
        columns.append(n.or_nan(col(v)).alias(v))
        columns += [F.coalesce(col(c), n.lit(0)).alias(c) for c, has in ((u_sys(v), s.sys), (u_rand(v), s.rand)) if has]
        if s.tagged:
            columns.append(F.coalesce(col(tag(v)), F.lit(0).cast("byte")).alias(tag(v)))
    return frame.join(cells, out.dim_names, "left").select(*columns)


def trapezoid(x: Sequence[float]) -> np.ndarray:
    """Weights of the trapezoidal rule over points in the given order; a single point weighs 0."""
    w = np.zeros(len(x))
    if len(x) > 1:
        half = np.diff(np.asarray(x, dtype=float)) / 2.0
        w[:-1] += half
        w[1:] += half
    return w


def weight_table(grid: Grid, name: str, weights: Sequence[float]) -> DataFrame:
    """(coordinate, weight) rows; one per coordinate of the dimension, so small by construction."""
    schema = T.StructType([T.StructField(name, T.DoubleType()), T.StructField("__w", T.DoubleType())])
    return grid.spark.createDataFrame([(float(c), float(w)) for c, w in zip(grid.dim(name).coords, weights, strict=True)], schema)


def _integrate_one(grid: Grid, v: str, name: str, radius: bool, to_radians: bool, skipna: bool) -> Grid:
    """The integral of one variable along one dimension."""
    s = grid.vars[v]
    x = np.array(grid.dim(name).coords) * (np.pi / 180.0 if to_radians else 1.0)
    cells = grid.cells
    if radius:
        cells = cells.withColumns({v: col(v) * col(name), **{c: col(c) * F.abs(col(name)) for c, has in ((u_sys(v), s.sys), (u_rand(v), s.rand)) if has}})
    fine = n.finite(col(v))
    rest = [d.name for d in grid.dimensions if d.name != name]
    if skipna:
        # Weights over the populated points of each line, from their neighbours.
        place = col(name) * n.lit(np.pi / 180.0) if to_radians else col(name)
        line = Window.partitionBy(*map(col, rest)) if rest else Window.partitionBy(F.lit(0))
        line = line.orderBy(grid.ordinal(name))
        before, after = F.lag(place).over(line), F.lead(place).over(line)
        cells = cells.where(fine).withColumn("__w", (F.coalesce(after, place) - F.coalesce(before, place)) / n.lit(2))
        used = col("__w") != 0
        value = n.total(col(v) * col("__w"))
        value = F.when(F.count(F.lit(1)) > 0, value).otherwise(n.nan())
    else:
        cells = cells.join(F.broadcast(weight_table(grid, name, trapezoid(x))), name)
        used = col("__w") != 0
        whole = F.sum(F.when(fine, F.lit(1)).otherwise(F.lit(0))) == F.lit(len(x))
        value = F.when(whole, n.total(col(v) * col("__w"), used)).otherwise(n.nan())
    aggregates = [value.alias(v), F.count(F.when(fine, F.lit(1))).alias("__points")]
    if s.sys:
        aggregates.append(F.abs(n.total(col(u_sys(v)) * col("__w"), used)).alias(u_sys(v)))
    if s.rand:
        aggregates.append(n.root_sum_squares(col(u_rand(v)) * col("__w"), used).alias(u_rand(v)))
    if skipna:
        worst = n.worst_tag(grid.tag_column(v), used)
        aggregates.append(F.when(worst < 0, worst).when(F.count(F.lit(1)) < F.lit(len(x)), F.lit(1).cast("byte")).otherwise(worst).alias(tag(v)))
    elif s.tagged:
        aggregates.append(n.worst_tag(col(tag(v)), used).alias(tag(v)))
    out, made = _grouped(replace(grid, cells=cells), [name], aggregates)
    spec = replace(s, tagged=s.tagged or skipna, absent_tag=1 if skipna else 0)
    made = made.drop("__points")
    return replace(out, cells=made, vars={v: spec}, dense=grid.dense and not skipna or not out.dim_names)


def integrate(grid: Grid, var: str, over: str | Sequence[str], coords: str | None, skipna: bool) -> Grid:
    """Trapezoidal integral along one dimension after another; only the variable stays."""
    spec = grid.var(var)
    names = _names(over)
    for x in names:
        grid.dim(x, numeric=True)
    if coords not in (None, "cartesian", "polar"):
        raise DimensionError(str(coords), "unknown coordinate system", "Use 'cartesian' or 'polar'")
    degrees: dict[str, bool] = {}
    if coords == "polar":
        if len(names) != 2:
            raise DimensionError(", ".join(names), "polar integration needs [radius, angle]", "Pass both, the radius first")
        unit = grid.dim(names[1]).unit
        if unit is not None and unit not in ("rad", "deg"):
            raise DimensionError(names[1], f"its unit {unit} is no angle", "Use 'rad' or 'deg'")
        degrees[names[1]] = unit == "deg" and coefficients("deg", "rad")[0] != 1
    guard_reduction(grid, names, [var])
    out = replace(grid, vars={var: spec}, cells=grid.cells.select(*map(col, grid.dim_names), *map(col, grid.columns([var]))), correlation={}, axes=grid.axes.without(set(grid.vars) - {var}).without({var}))
    note = "correlation=dropped" if grid.correlation else ""
    if skipna:
        found = out.cells.agg(F.count(F.when(n.finite(col(var)), F.lit(1)))).first()[0]
        note += ("; " if note else "") + f"populated={found}/{grid.expected_cells()}"
    for i, x in enumerate(names):
        out = _integrate_one(out, var, x, coords == "polar" and i == 0, degrees.get(x, False), skipna)
    result = Var(None, spec.description, spec.long_name, **{k: getattr(out.vars[var], k) for k in ("sys", "rand", "tagged", "absent_tag")})
    return replace(out, vars={var: replace(result, unit=spec.unit)}, roots={var: grid.roots[var]} if var in grid.roots else {}, note=note)
