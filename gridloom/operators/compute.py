"""New variables from equations, compiled to columns with their propagated uncertainty."""

from __future__ import annotations

import math
import re
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import DataError, EquationError, UncertaintyError, UncertaintyLineageError
from ..functions import numeric as n
from ..functions.expressions import REDUCTIONS, condition, derivative, emit, parse, reductions, references, value_at_missing
from ..grid import Grid, Var, col, tag, u_rand, u_sys
from .uncertainty import correlated, propagate

_EQUATION = re.compile(r"^\s*([^\W\d]\w*)\s*=(?!=)\s*(.+?)\s*$", re.S)


def split_equation(equation: str) -> tuple[str, str]:
    m = _EQUATION.match(equation)
    if not m:
        raise EquationError(equation, "is not of the form NAME = expression", "Write for example 'CL = FZ / (q * S)'")
    return m[1], m[2]


def check_lineage(grid: Grid, target: str, text: str, carriers: list[str]) -> None:
    """Refuse operands that come from one measurement and are not declared correlated."""
    for i, a in enumerate(carriers):
        for b in carriers[:i]:
            shared = grid.roots.get(a, frozenset()) & grid.roots.get(b, frozenset())
            if shared and not correlated(grid.correlation, a, b):
                origin = ", ".join(sorted(x.split("#")[0] for x in shared))
                raise UncertaintyLineageError(
                    f"{target} = {text}", f"{b} and {a} both come from {origin} and would be taken as independent",
                    "Write one expression of the measured variables, or declare their correlation",
                )


def whole_grid_values(grid: Grid, trees: list) -> tuple[dict, object]:
    """One row with all reductions of the expressions, and the columns that read it."""
    env = {v: col(v) for v in grid.vars}
    total = grid.expected_cells()
    aggregates, columns = [], {}
    for i, w in enumerate(dict.fromkeys(trees)):
        if reductions(w.arg):
            raise EquationError(f"np.{w.name}", "a reduction of a reduction", "Compute the inner one first")
        value = emit(w.arg, env)
        known = F.when(~F.isnan(value), value)
        found = n.or_nan(REDUCTIONS[w.name](known))
        if w.name == "nansum":
            found = F.coalesce(F.sum(known), n.lit(0))
        elif not w.name.startswith("nan"):  # one missing cell is enough
            everything = F.lit(total) if total is not None else F.count(F.lit(1))
            found = F.when(F.count(known) < everything, n.nan()).otherwise(found)
        aggregates.append(found.alias(f"__whole_{i}"))
        columns[w] = col(f"__whole_{i}")
    return columns, grid.cells.agg(*aggregates)


def compute(grid: Grid, equation: str, debug: bool, where: str | None, fill: float | None, method: str) -> Grid:
    if method == "mcm":
        raise UncertaintyError("mcm", "Monte Carlo propagation is not available", "Use 'symbolic'")
    if method != "symbolic":
        raise DataError(str(method), "unknown propagation method", "Use 'symbolic'")
    target, text = split_equation(equation)
    if target in grid.dim_names:
        raise EquationError(target, "is a dimension", "Choose another name for the result")
    if fill is None and target not in grid.vars:
        fill = n.NAN  # there are no old values to keep
    tree = parse(text, set(grid.vars))
    used = [v for v in grid.vars if v in references(tree)]
    carriers = [v for v in used if grid.vars[v].uncertain]
    wholes = reductions(tree)
    if carriers and any(references(w) & set(carriers) for w in wholes):
        raise EquationError(text, "a reduction over the grid of a variable with uncertainty", "Use average(), which carries it")
    partials = {v: derivative(tree, v) for v in carriers}
    check_lineage(grid, target, text, carriers)

    masked_value = n.NAN if fill is None else float(fill)
    fills_missing = not math.isnan(value_at_missing(tree)) or (where is not None and not math.isnan(masked_value)) or (where is not None and "!=" in where)
    work = grid.densified() if fills_missing else grid
    columns, row = whole_grid_values(grid, wholes) if wholes else ({}, None)
    cells = work.cells.crossJoin(F.broadcast(row)) if wholes else work.cells
    env = {v: col(v) for v in grid.vars}
    hit = None
    if where is not None:
        hit, _ = condition(where, env)
        if not wholes:  # what is masked cannot raise or poison
            env = {v: F.when(hit, c).otherwise(n.nan()) for v, c in env.items()}
    new = {target: emit(tree, env, columns)}
    old = grid.vars.get(target)
    spec = Var(tagged=True, absent_tag=1 if where is None else (old.absent_tag if fill is None and old else 0))
    for flag, name in (("sys", u_sys), ("rand", u_rand)):
        having = [v for v in carriers if getattr(grid.vars[v], flag)]
        if having:
            terms = [(emit(partials[v], env, columns), col(name(v)) if hit is None else F.when(hit, col(name(v))).otherwise(n.nan()), v) for v in having]
            new[name(target)] = propagate(terms, grid.correlation, target)
            spec = replace(spec, **{flag: True})
    new[tag(target)] = F.lit(1).cast("byte")
    if hit is not None:
        hit = F.coalesce(hit, F.lit(False))
        keep = fill is None
        if keep:  # a component that only the old values have stays with them
            for flag, name in (("sys", u_sys), ("rand", u_rand)):
                if getattr(old, flag) and not getattr(spec, flag):
                    new[name(target)] = n.nan()
                    spec = replace(spec, **{flag: True})
        kept_tag = grid.tag_column(target) if keep else F.lit(0).cast("byte")
        for c, expression in list(new.items()):
            if c == tag(target):
                rest = kept_tag
            elif keep:
                rest = col(c) if c in grid.cells.columns else n.lit(0)
            else:
                rest = n.lit(masked_value) if c == target else n.nan()
            new[c] = F.when(hit, expression).otherwise(rest)
    vars_ = {**grid.vars, target: spec}
    roots = {k: v for k, v in grid.roots.items() if k != target}
    if spec.uncertain:
        roots[target] = frozenset().union(*(grid.roots.get(v, frozenset()) for v in carriers), grid.roots.get(target, frozenset()) if fill is None and hit is not None else frozenset())
    store = {k: r for k, r in grid.correlation.items() if target not in k}
    dropped = "correlation=dropped" if len(store) < len(grid.correlation) else ""
    out = replace(work, vars=vars_, roots=roots, correlation=store, transferred=grid.transferred - {target}, note=dropped)
    rest = [col(c) for c in [*out.dim_names, *out.columns([v for v in vars_ if v != target])]]
    made = cells.select(*rest, *[new[c].alias(c) for c in out.columns([target])])
    out = replace(out, cells=made.select(*map(col, out.dim_names), *map(col, out.columns())))
    if debug:
        _report(grid, out, target, text, used, partials)
    return out


def _report(grid: Grid, out: Grid, target: str, text: str, used: list[str], partials: dict) -> None:
    """Print operands, partial derivatives and result at the first cell."""
    order = [out.ordinal(d) for d in out.dim_names]
    row = (out.cells.orderBy(*order) if order else out.cells).limit(1).first()
    print(f"compute debug: {target} = {text}")
    print(f"  tokens: {', '.join(used) or 'none'}")
    if row is None:
        print("  no cell has a value")
        return
    for d in out.dim_names:
        print(f"  at {d} = {row[d]}")
    if partials and not any(reductions(p) for p in partials.values()):
        known = {v: n.lit(row[v]) for v in used}
        at = grid.spark.range(1).select(*[emit(p, known).alias(v) for v, p in partials.items()]).first()
        for v in partials:
            print(f"  partial by {v} = {at[v]}")
    for v in [*used, *[target] * (target not in used)]:
        s = out.vars[v]
        parts = [f"u_{k} = {row[c]}" for k, c, has in (("sys", u_sys(v), s.sys), ("rand", u_rand(v), s.rand)) if has]
        print(f"  {v} = {row[v]}" + (", " + ", ".join(parts) if parts else ""))


def require_certain(grid: Grid, operation: str, names: list[str] | None = None) -> None:
    """Some operations have no agreed rule for uncertainty and refuse it."""
    having = [v for v in (grid.uncertain if names is None else names) if grid.vars[v].uncertain]
    if having:
        raise UncertaintyError(", ".join(having), f"{operation} does not carry uncertainty", "Apply it before set_uncertainty, or to other variables")
