"""Assigned uncertainty, declared correlation, metadata, and first-order propagation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import CorrelationError, CorrelationKeyError, DataError, UncertaintyError
from ..functions import numeric as n
from ..grid import Grid, col, u_rand, u_sys

COMPONENTS = {"systematic": ("sys", u_sys), "random": ("rand", u_rand)}


def set_uncertainty(grid: Grid, spec: Mapping[str, float | str], component: str) -> Grid:
    """An absolute number, or '5%' of the magnitude of each value."""
    if component not in COMPONENTS:
        raise UncertaintyError(str(component), "unknown component", "Use 'systematic' or 'random'")
    flag, name = COMPONENTS[component]
    vars_, columns, roots = dict(grid.vars), {}, dict(grid.roots)
    for v, given in spec.items():
        grid.var(v)
        try:
            relative = isinstance(given, str)
            if relative and not given.strip().endswith("%"):
                raise ValueError(given)
            x = float(given.strip()[:-1]) / 100.0 if relative else float(given)
        except (TypeError, ValueError) as error:
            raise UncertaintyError(v, f"{given!r} is neither a number nor a percentage", "Pass 0.1 or '5%'") from error
        if not math.isfinite(x) or x < 0:
            raise UncertaintyError(v, f"{given!r} is negative or not finite", "Pass a finite number of 0 or more")
        columns[name(v)] = F.abs(col(v)) * n.lit(x) if relative else n.lit(x)
        vars_[v] = replace(vars_[v], **{flag: True})
        roots[v] = frozenset((f"{v}#{len(grid.history)}",))
    source = grid if all(isinstance(x, str) for x in spec.values()) else grid.densified()  # an absolute one holds at missing cells, too
    cells = source.cells.withColumns(columns)
    out = replace(source, cells=cells, vars=vars_, roots=roots)
    return replace(out, cells=cells.select(*map(col, out.dim_names), *map(col, out.columns())))


def set_metadata(grid: Grid, spec: Mapping[str, Mapping[str, str | None]]) -> Grid:
    dims, vars_ = list(grid.dimensions), dict(grid.vars)
    for name, fields in spec.items():
        at = next((i for i, d in enumerate(dims) if d.name == name), None)
        allowed = ("unit", "description") if at is not None else ("unit", "description", "long_name")
        wrong = [f for f in fields if f not in allowed] + [f for f, x in fields.items() if x is not None and not isinstance(x, str)]
        if wrong:
            raise DataError(name, f"{wrong} cannot be set", f"Set strings or None for {allowed}")
        if at is not None:
            dims[at] = replace(dims[at], **fields)
        else:
            vars_[name] = replace(grid.var(name), **fields)
    return replace(grid, dimensions=tuple(dims), vars=vars_)


def correlated(store: Mapping[tuple[str, str], float], a: str, b: str) -> float:
    return store.get((min(a, b), max(a, b)), 0.0)


def set_correlation(grid: Grid, spec: Mapping[tuple[str, str], float]) -> Grid:
    """Merge coefficients; the matrix of all of them must be a correlation matrix."""
    store = dict(grid.correlation)
    items = spec.items() if isinstance(spec, Mapping) else [((a, b), r) for a, b, r in spec]
    for pair, r in items:
        a, b = sorted(pair)
        grid.var(a), grid.var(b)
        if a == b:
            raise CorrelationKeyError(a, "is correlated with itself by definition", "Name two variables")
        if not (isinstance(r, int | float) and math.isfinite(r) and abs(r) <= 1):
            raise CorrelationError(f"{a}, {b}", f"{r!r} is not a coefficient", "Use a number from -1 to 1")
        if (a, b) in store and store[a, b] != r:
            raise CorrelationError(f"{a}, {b}", f"declared as {store[a, b]} and {r}", "Drop the first with drop_correlation")
        store[a, b] = float(r)
    names = sorted({x for p in store for x in p})
    m = np.array([[1.0 if a == b else correlated(store, a, b) for b in names] for a in names])
    if names:
        values = np.linalg.eigvalsh(m)
        if values[0] < -10 * len(names) * np.finfo(float).eps * max(1.0, np.abs(values).max()):
            raise CorrelationError(", ".join(names), f"no such correlation matrix: its smallest eigenvalue is {values[0]:.3g}", "Check the coefficients")
    return replace(grid, correlation=store)


def drop_correlation(grid: Grid, names: Sequence[str] | None) -> Grid:
    if names is None:
        return replace(grid, correlation={})
    for x in names:
        grid.var(x)
    return replace(grid, correlation={k: r for k, r in grid.correlation.items() if not set(k) & set(names)})


def clamped_root(variance: Column, scale: Column, terms: int, what: str) -> Column:
    """Root of a variance: rounding below zero is zero, more than that is refused."""
    tolerance = n.lit(terms * np.finfo(float).eps) * F.abs(scale)
    wrong = F.raise_error(F.lit(f"{what}: the propagated variance is negative. Check the declared correlations.")).cast("double")
    return F.when(variance < -tolerance, wrong).when(variance < 0, n.lit(0)).otherwise(F.sqrt(variance))


def propagate(partials: Sequence[tuple[Column, Column, str]], store: Mapping[tuple[str, str], float], what: str) -> Column:
    """u of a result from (partial derivative, u of the operand, operand name)."""
    terms = [p * u for p, u, _ in partials]
    variance = scale = None
    for t in terms:
        variance = t * t if variance is None else variance + t * t
    scale, mixed = variance, False
    for i in range(len(terms)):
        for j in range(i):
            r = correlated(store, partials[i][2], partials[j][2])
            if r:
                cross = n.lit(2.0 * r) * terms[i] * terms[j]
                variance, scale, mixed = variance + cross, scale + F.abs(cross), True
    if len(terms) == 1:
        return F.abs(terms[0])
    return clamped_root(variance, scale, len(terms) ** 2 + 1, what) if mixed else F.sqrt(variance)
