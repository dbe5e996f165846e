"""Two grids of the same shape, cell by cell."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CombineError
from ..functions import numeric as n
from ..grid import Grid, Var, col, tag, u_rand, u_sys
from .uncertainty import propagate

OPS = ("sum", "diff", "product", "ratio", "mean", "weighted_mean")


def _rule(op: str, a: Column, b: Column, weights: tuple[float, float]) -> tuple[Column, Column, Column]:
    """Result and partial derivatives."""
    one = n.lit(1)
    if op == "sum":
        return a + b, one, one
    if op == "diff":
        return a - b, one, n.lit(-1)
    if op == "product":
        return a * b, b, a
    if op == "ratio":
        return n.divide(a, b), n.divide(one, b), n.divide(-a, b * b)
    wa, wb = (0.5, 0.5) if op == "mean" else (w / sum(weights) for w in weights)
    return n.lit(wa) * a + n.lit(wb) * b, n.lit(wa), n.lit(wb)


def combine(grid: Grid, other: Grid, op: str, weights: tuple[float, float] | None, cross_correlation: float) -> Grid:
    """All variables of two aligned grids; a cell that one side lacks is missing."""
    if op not in OPS:
        raise CombineError(str(op), "unknown operation", "Use one of " + ", ".join(OPS))
    if (weights is not None) != (op == "weighted_mean"):
        raise CombineError("weights", f"{'are not used by' if weights is not None else 'are needed by'} {op}", "Pass weights=(a, b) with weighted_mean only")
    if weights is not None and (len(weights) != 2 or not all(isinstance(w, int | float) and math.isfinite(w) and w >= 0 for w in weights) or sum(weights) <= 0):
        raise CombineError("weights", f"{weights!r}", "Pass two finite numbers of 0 or more that are not both 0")
    if not (isinstance(cross_correlation, int | float) and abs(cross_correlation) <= 1):
        raise CombineError("cross_correlation", f"{cross_correlation!r}", "Pass a number from -1 to 1")
    if grid.mode != other.mode:
        raise CombineError("mode", f"{grid.mode} and {other.mode}", "Promote or demote one of the grids")
    if [d.name for d in grid.dimensions] != [d.name for d in other.dimensions]:
        raise CombineError("dimensions", f"{grid.dim_names} and {other.dim_names}", "Grids need the same dimensions in the same order")
    for a, b in zip(grid.dimensions, other.dimensions, strict=True):
        if a.coords != b.coords:
            raise CombineError(a.name, "coordinates differ", "Interpolate or select to common coordinates")
        if a.unit != b.unit:
            raise CombineError(a.name, f"units {a.unit} and {b.unit}", "Convert one of them")
    if set(grid.vars) != set(other.vars):
        raise CombineError("variables", f"{sorted(grid.vars)} and {sorted(other.vars)}", "Grids need the same variables")
    for v, s in grid.vars.items():
        if op not in ("product", "ratio") and s.unit != other.vars[v].unit:
            raise CombineError(v, f"units {s.unit} and {other.vars[v].unit}", "Convert one of them")
    names = grid.dim_names
    if not names and (grid.cells.limit(2).count() != 1 or other.cells.limit(2).count() != 1):
        raise CombineError("datapoints", "raw points have no key to align by", "Pivot both tables first")
    mirrored = {c: f"__r_{c}" for c in other.columns()}
    right = other.cells.select(*map(col, names), *[col(c).alias(r) for c, r in mirrored.items()])
    # A cell that only one side has is missing in the result, as its operand is NaN; it keeps a
    # row only where tags have to be compared.
    marked = any(s.tagged or other.vars[v].tagged for v, s in grid.vars.items())
    joined = grid.cells.crossJoin(F.broadcast(right)) if not names else grid.cells.join(right, names, "full_outer" if marked else "inner")
    columns, vars_ = [*map(col, names)], {}
    for v, s in grid.vars.items():
        o = other.vars[v]
        a, b = n.or_nan(col(v)), n.or_nan(col(mirrored[v]))
        value, pa, pb = _rule(op, a, b, weights or (1.0, 1.0))
        columns.append(value.alias(v))
        flags = {}
        for flag, name in (("sys", u_sys), ("rand", u_rand)):
            mine, theirs = getattr(s, flag), getattr(o, flag)
            terms = [(p, n.or_nan(col(c)), k) for has, p, c, k in ((mine, pa, name(v), "a"), (theirs, pb, mirrored.get(name(v)), "b")) if has]
            if terms:
                columns.append(propagate(terms, {("a", "b"): float(cross_correlation)}, v).alias(name(v)))
                flags[flag] = True
        if s.tagged or o.tagged:
            left = F.coalesce(col(tag(v)), F.lit(s.absent_tag)) if s.tagged else F.lit(0)
            other_tag = F.coalesce(col(mirrored[tag(v)]), F.lit(o.absent_tag)) if o.tagged else F.lit(0)
            columns.append(n.worst_of(left.cast("byte"), other_tag.cast("byte")).alias(tag(v)))
            flags["tagged"] = True
            worst = {s.absent_tag, o.absent_tag}
            flags["absent_tag"] = -1 if -1 in worst else 1 if 1 in worst else 0
        unit = s.unit if op not in ("product", "ratio") else None
        vars_[v] = Var(unit, s.description, s.long_name, **flags)
    roots = {v: grid.roots.get(v, frozenset()) | other.roots.get(v, frozenset()) for v in vars_ if vars_[v].uncertain}
    out = replace(
        grid, vars=vars_, correlation={}, roots=roots, dense=grid.dense and other.dense,
        interpolated=grid.interpolated | other.interpolated, transferred=grid.transferred | other.transferred,
    )
    return replace(out, cells=joined.select(*columns).select(*map(col, names), *map(col, out.columns())))
