"""Selection by coordinates, values, uncertainties and tags."""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DataError, DimensionError, EmptySelectionError, NonNumericDimensionError, SelectionError, UncertaintyError
from ..functions import numeric as n
from ..grid import Dim, Grid, col, u_rand, u_sys
from .reshape import without_dims

_KEY = re.compile(r"^(.*?)\s*(>=|<=|!=|=|>|<)?\s*$")
_OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "!=": operator.ne}


def _wanted(value: object) -> list:
    if isinstance(value, str):
        return [value]
    return [x if isinstance(x, str) else float(x) for x in np.atleast_1d(np.asarray(value)).tolist()]


def coordinates_that(d: Dim, op: str, value: object) -> list:
    """Coordinates of a dimension that satisfy one filter, in grid order."""
    wanted = _wanted(value)
    if any(isinstance(w, str) == d.numeric for w in wanted):
        raise SelectionError(d.name, f"{value!r} is not of the kind of its coordinates", "Pass " + ("numbers" if d.numeric else "strings"))
    if op == "=":
        absent = [w for w in wanted if w not in d.coords]
        if absent:
            raise SelectionError(d.name, f"has no coordinate {absent}", f"Coordinates are {list(d.coords)[:10]}")
        return [c for c in d.coords if c in wanted]
    if op == "!=":
        return [c for c in d.coords if c not in wanted]
    if len(wanted) != 1:
        raise SelectionError(d.name, f"{op} takes one value", "Pass a number")
    if not d.numeric:
        raise NonNumericDimensionError(d.name, f"{op} on strings", "Use = or !=")
    return [c for c in d.coords if _OPS[op](c, wanted[0])]


def _quantity(grid: Grid, name: str, frame: str) -> Column:
    if frame == "HistoryFrame":
        return F.coalesce(grid.tag_column(name), F.lit(grid.vars[name].absent_tag)).cast("double")
    if frame == "UncFrame":
        s = grid.vars[name]
        if not s.uncertain:
            raise UncertaintyError(name, "has no uncertainty", "Assign one with set_uncertainty")
        return F.sqrt(reduce(operator.add, [col(c) * col(c) for c, has in ((u_sys(name), s.sys), (u_rand(name), s.rand)) if has]))
    return col(name)


def select(grid: Grid, filters: Mapping[str, object], frame: str) -> Grid:
    """Keep coordinates; blank cells that fail a condition and drop what is blank throughout."""
    if frame not in ("VarFrame", "UncFrame", "HistoryFrame"):
        raise DataError(str(frame), "unknown frame", "Use 'VarFrame', 'UncFrame' or 'HistoryFrame'")
    if not filters:
        raise SelectionError("select", "no filter", "Pass {'name >': value, ...}")
    keep: dict[str, list] = {}
    conditions: list[tuple[Column, str]] = []
    for key, value in filters.items():
        name, op = _KEY.match(key).groups()
        op = op or "="
        if frame == "VarFrame" and name in grid.dim_names:
            d = grid.dim(name)
            fits = set(coordinates_that(d, op, value))
            keep[name] = [c for c in keep.get(name, d.coords) if c in fits]
            if not keep[name]:
                raise SelectionError(name, f"no coordinate satisfies {op} {value!r}", f"Coordinates are {list(d.coords)[:10]}")
        elif name in grid.vars:
            q = _quantity(grid, name, frame)
            wanted = _wanted(value)
            if any(isinstance(w, str) for w in wanted) or (op not in ("=", "!=") and len(wanted) != 1):
                raise SelectionError(name, f"{op} {value!r}", "Compare a variable with a number")
            tests = [n.compare(op, q, n.lit(w)) for w in wanted]
            conditions.append((reduce(operator.and_ if op == "!=" else operator.or_, tests), op))
        else:
            raise SelectionError(name, "is neither a variable" + (" nor a dimension" if frame == "VarFrame" else ""), "Names are: " + ", ".join([*(grid.dim_names if frame == "VarFrame" else []), *grid.vars]))
    cells = grid.cells
    for name, coords in keep.items():
        if len(coords) < len(grid.dim(name)):
            cells = cells.where(col(name).isin(coords))
    dims = tuple(replace(d, coords=tuple(keep[d.name])) if d.name in keep else d for d in grid.dimensions)
    out = replace(grid, cells=cells, dimensions=dims)
    if not conditions:
        return replace(out, note="masked=0")
    if any(op == "!=" for _, op in conditions) or frame == "HistoryFrame":
        out = out.densified()  # a missing cell can satisfy these
    match = reduce(operator.and_, [c for c, _ in conditions])
    live = out.cells.where(match)
    if grid.is_datapoint:
        total, left = out.cells.agg(F.count(F.lit(1)), F.count(F.when(match, 1))).first()
        if not left:
            raise EmptySelectionError(", ".join(filters), "no datapoint satisfies the condition", "Relax it")
        return replace(out, cells=live, note=f"masked={total - left}")
    names = out.dim_names
    found = live.agg(F.count(F.lit(1)).alias("cells"), *[F.collect_set(col(x)).alias(x) for x in names]).first()
    if not found["cells"]:
        raise EmptySelectionError(", ".join(filters), "every cell is masked", "Relax the condition")
    dims = tuple(replace(d, coords=tuple(c for c in d.coords if c in set(found[d.name]))) for d in out.dimensions)
    masked = out.expected_cells() - found["cells"]
    if any(s.tagged for s in out.vars.values()):  # masked cells keep their tags, and so their rows
        cells = out.cells
        for d in dims:
            cells = cells.where(col(d.name).isin(list(d.coords)))
        blank = [c for v, s in out.vars.items() for c, has in ((v, True), (u_sys(v), s.sys), (u_rand(v), s.rand)) if has]
        hit = F.coalesce(match, F.lit(False))
        cells = cells.select(*[F.when(hit, col(c)).otherwise(n.nan()).alias(c) if c in blank else col(c) for c in cells.columns])
        return replace(out, dimensions=dims, cells=cells, note=f"masked={masked}")
    return replace(out, dimensions=dims, cells=live, dense=out.dense and not masked, note=f"masked={masked}")


def at(grid: Grid, coords: Mapping[str, object]) -> Grid:
    """One coordinate of each named dimension, which then goes."""
    if not coords:
        raise SelectionError("at", "no coordinate", "Pass dimension=coordinate")
    cells = grid.cells
    for name, value in coords.items():
        d = grid.dim(name)
        wanted = _wanted(value)
        if len(wanted) != 1:
            raise DimensionError(name, "at takes one coordinate", "Use select for several")
        cells = cells.where(col(name) == F.lit(coordinates_that(d, "=", value)[0]))
    return without_dims(replace(grid, cells=cells), list(coords))
