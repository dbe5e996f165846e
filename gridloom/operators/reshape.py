"""Key declaration, unit dimensions, new dimensions and concatenation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import CombineError, ConcatOverlapError, DataError, DimensionError, PivotDuplicateError, UncertaintyError, VariableError
from ..functions import numeric as n
from ..grid import DATAPOINT, Dim, Grid, as_coordinates, col, tag, u_rand, u_sys


def declare_dims(grid: Grid, names: Sequence[str], string_ok: bool = True) -> Grid:
    """Columns become dimensions: one job finds coordinates, bad keys and repeated cells.

    Cells stay where they are; a missing combination is a missing row.
    """
    kinds = dict(grid.cells.dtypes)
    keys = [col(x) for x in names]
    bad = [F.max((k.isNull() | F.isnan(k) if kinds[x] == "double" else k.isNull()).cast("int")).alias(f"b{i}") for i, (x, k) in enumerate(zip(names, keys, strict=True))]
    signed = [F.max(((k == 0) & (F.pow(k, F.lit(-1.0)) < 0)).cast("int")).alias(f"z{i}") for i, (x, k) in enumerate(zip(names, keys, strict=True)) if kinds[x] == "double"]
    # Rows are first folded by their whole key; what is gathered is the coordinates of each dimension.
    folded = grid.cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    found = folded.agg(
        F.max(F.struct("__rows", *keys)).alias("most"), F.sum("__rows").alias("rows"), F.count(F.lit(1)).alias("cells"), *bad, *signed, *[F.collect_set(k).alias(f"c{i}") for i, k in enumerate(keys)]
    ).first()
    if not found["rows"]:
        raise DataError(", ".join(names), "there are no rows to make a grid of", "Load a table with rows")
    for i, x in enumerate(names):
        if found[f"b{i}"]:
            raise DataError(x, "some rows have no coordinate (NaN or null)", "Drop those rows before pivoting")
    if found["most"][0] > 1:
        at = ", ".join(f"{x}={v!r}" for x, v in zip(names, found["most"][1:], strict=True))
        raise PivotDuplicateError(at, f"{found['most'][0]} rows have these coordinates", "Add the dimension that tells them apart, such as a repeat number")
    dims = tuple(Dim(x, tuple(sorted({v + 0.0 if isinstance(v, float) else v for v in found[f"c{i}"]})), grid.vars[x].unit if x in grid.vars else None, grid.vars[x].description if x in grid.vars else None) for i, x in enumerate(names))
    keep = [v for v in grid.vars if v not in names]
    full = 1
    for d in dims:
        full *= len(d)
    out = replace(
        grid, dimensions=dims, vars=grid.only(keep), correlation=grid.restricted_correlation(keep), axes=grid.axes.without(set(names)),
        roots={k: v for k, v in grid.roots.items() if k in keep}, dense=found["cells"] == full,
    )
    cells = grid.cells
    for i, x in enumerate(names):
        if kinds[x] == "double" and found[f"z{i}"]:  # -0.0 and 0.0 are one coordinate
            cells = cells.withColumn(x, col(x) + n.lit(0.0))
    return replace(out, cells=cells.select(*map(col, names), *map(col, out.columns())))


def pivot(grid: Grid, dims: Sequence[str] | None, auto_detect: bool, threshold: int) -> Grid:
    """Datapoints to a grid; ``auto_detect`` adds columns with few, repeated finite values."""
    if not grid.is_datapoint:
        raise DimensionError(", ".join(grid.dim_names), "the data is a grid already", "pivot works on datapoints")
    names = [dims] if isinstance(dims, str) else list(dims or [])
    for x in names:
        grid.var(x)
    if len(set(names)) != len(names):
        raise DataError(", ".join(names), "a dimension is named twice", "Name each once")
    if auto_detect:
        rest = [v for v in grid.vars if v not in names]
        if rest:
            ok = {v: F.when(n.finite(col(v)), col(v)) for v in rest}
            row = grid.cells.agg(*[f(ok[v]).alias(f"{p}{i}") for i, v in enumerate(rest) for p, f in (("u", F.count_distinct), ("n", F.count))]).first()
            names += [v for i, v in enumerate(rest) if row[f"u{i}"] <= threshold and row[f"u{i}"] < row[f"n{i}"]]
    if not names:
        raise DataError("pivot", "no dimension is named or detected", "Pass dims=[...]")
    if len(names) == len(grid.vars):
        raise VariableError(", ".join(names), "would leave no variable", "Keep at least one column as a variable")
    return declare_dims(grid, names)


def collapsed(grid: Grid) -> Grid:
    """No dimension left: one datapoint."""
    return replace(grid, dimensions=(Dim(DATAPOINT, None),), dense=True)


def without_dims(grid: Grid, names: Sequence[str]) -> Grid:
    """Drop dimensions whose cells no longer differ along them."""
    dims = tuple(d for d in grid.dimensions if d.name not in names)
    out = replace(grid, dimensions=dims, cells=grid.cells.drop(*names))
    return out if dims else collapsed(out)


def squeeze(grid: Grid, along: str | None) -> Grid:
    names = [d.name for d in grid.dimensions if d.coords is not None and len(d) == 1] if along is None else [along]
    if along is not None and len(grid.dim(along)) != 1:
        raise DimensionError(along, f"has {len(grid.dim(along))} coordinates", "Only dimensions of one coordinate can be squeezed")
    if not names:
        raise DataError("squeeze", "no dimension has a single coordinate", "Select one coordinate before, or use at()")
    return without_dims(grid, names)


def expand(grid: Grid, dim_name: str, values: object, axis: int | None) -> Grid:
    """Repeat every cell along a new dimension; the join is with its coordinates only."""
    coords = as_coordinates(values, dim_name)
    if dim_name in grid.vars or dim_name in [d.name for d in grid.dimensions]:
        raise DataError(dim_name, "the name is taken", "Choose another name for the new dimension")
    kept = [] if grid.is_datapoint else list(grid.dimensions)
    if grid.is_datapoint and grid.cells.limit(2).count() > 1:
        raise DimensionError(DATAPOINT, "raw datapoints cannot be expanded", "Pivot them first")
    where = len(kept) if axis is None else axis
    if not -len(kept) - 1 <= where <= len(kept):
        raise DimensionError(dim_name, f"axis {axis} is out of range", f"Use 0 to {len(kept)}")
    where = where if where >= 0 else where + len(kept) + 1
    dims = (*kept[:where], Dim(dim_name, coords), *kept[where:])
    out = replace(grid, dimensions=dims)
    return replace(out, cells=grid.cells.crossJoin(F.broadcast(out.coordinate_table(dim_name).drop("__ordinal"))))


def concat(frames: Sequence[Grid], *, along: str, history: bool = False, comment: str | None = None) -> Grid:
    """Append grids along a dimension that none of them shares coordinates of."""
    frames = list(frames)
    if not frames:
        raise CombineError("concat", "needs a grid", "Pass a list of grids")
    first = frames[0]
    base = first.dim(along)
    seen: list = list(base.coords)
    for other in frames[1:]:
        mine = other.dim(along)
        if other.mode != first.mode:
            raise CombineError("mode", f"{first.mode} and {other.mode}", "Promote or demote one of the grids")
        if [d.name for d in other.dimensions] != [d.name for d in first.dimensions]:
            raise CombineError("dimensions", f"{first.dim_names} and {other.dim_names}", "Grids need the same dimensions in the same order")
        for a, b in zip(first.dimensions, other.dimensions, strict=True):
            if a.unit != b.unit:
                raise CombineError(a.name, f"units {a.unit} and {b.unit}", "Convert one of them")
            if a.name != along and a.coords != b.coords:
                raise CombineError(a.name, "coordinates differ", "Interpolate or select to common coordinates")
        if set(other.vars) != set(first.vars):
            raise CombineError("variables", f"{sorted(first.vars)} and {sorted(other.vars)}", "Grids need the same variables")
        for v, s in first.vars.items():
            o = other.vars[v]
            if (o.sys, o.rand) != (s.sys, s.rand):
                raise UncertaintyError(v, "uncertainty components differ", "Assign the same components in each grid")
            if o.unit != s.unit:
                raise CombineError(v, f"units {s.unit} and {o.unit}", "Convert one of them")
        if dict(other.correlation) != dict(first.correlation):
            raise UncertaintyError("correlations", "differ between the grids", "Declare the same in each, or drop them before")
        if other.axes.current() != first.axes.current():
            raise CombineError("vector groups", "are in different axes", "Rotate one of the grids")
        if base.numeric != mine.numeric:
            raise CombineError(along, "numbers and strings", "Use one kind of coordinate")
        shared = set(seen) & set(mine.coords)
        if shared:
            raise ConcatOverlapError(along, f"{sorted(shared)[:5]} occur in more than one grid", "Select disjoint coordinates before")
        seen += mine.coords
    tagged = {v for f in frames for v, s in f.vars.items() if s.tagged}
    vars_ = {v: replace(s, tagged=v in tagged, absent_tag=s.absent_tag if all(f.vars[v].absent_tag == s.absent_tag for f in frames) else 0) for v, s in first.vars.items()}
    dims = tuple(replace(d, coords=tuple(seen)) if d.name == along else d for d in first.dimensions)
    out = replace(first, dimensions=dims, vars=vars_, dense=all(f.dense for f in frames), interpolated=frozenset().union(*(f.interpolated for f in frames)), transferred=frozenset().union(*(f.transferred for f in frames)))
    cells = None
    for f in frames:
        if any(f.vars[v].absent_tag != vars_[v].absent_tag for v in vars_):
            f = f.densified()
        part = f.cells.select(*map(col, f.dim_names), *[c for v, s in vars_.items() for c in (col(v), *[col(u_sys(v))] * s.sys, *[col(u_rand(v))] * s.rand, *[f.tag_column(v).alias(tag(v))] * s.tagged)])
        cells = part if cells is None else cells.unionByName(part)
    out = replace(out, cells=cells, roots={v: frozenset().union(*(f.roots.get(v, frozenset()) for f in frames)) for v in vars_ if any(v in f.roots for f in frames)})
    return replace(out, note=f"{len(frames)} grids")._record("concat", {"along": along}, False, history, comment)
