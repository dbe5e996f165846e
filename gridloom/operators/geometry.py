"""Axes, vector groups, rotation between axes, and transfer of moments."""

from __future__ import annotations

import math
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AxisError, AxisNotFoundError, RotationMatrixError, UncertaintyLineageError, VectorGroupError
from ..functions import numeric as n
from ..grid import Grid, col, u_rand, u_sys
from .uncertainty import clamped_root, correlated

BUILT_IN = ("body", "stability", "wind")
#: Triplets that form a vector group without a declaration.
KNOWN_GROUPS = {"force": ("FX", "FY", "FZ"), "moment": ("MX", "MY", "MZ")}


@dataclass(frozen=True)
class Axis:
    """A named frame: a constant matrix from body, or a convention of flow angles."""

    name: str
    rotation_matrix: tuple[tuple[float, ...], ...] | None = None
    angles_from: tuple[str, ...] | None = None
    convention: str | None = None
    parent: str | None = None
    description: str | None = None

    def __post_init__(self) -> None:
        if self.parent is not None:
            raise AxisError(self.name, "parent axes are not supported", "Give the matrix from body")
        if (self.rotation_matrix is None) == (self.angles_from is None):
            raise AxisError(self.name, "needs a matrix or angles, not both", "Pass rotation_matrix= or angles_from= with convention=")
        if self.rotation_matrix is not None:
            m = np.asarray(self.rotation_matrix, dtype=float)
            if m.shape != (3, 3) or not np.isfinite(m).all():
                raise RotationMatrixError(self.name, "the matrix is not 3 by 3", "Pass three rows of three numbers")
            if np.abs(m @ m.T - np.eye(3)).max() > 1e-9:
                raise RotationMatrixError(self.name, "the matrix is not orthogonal", "Normalise its rows")
            if np.linalg.det(m) < 0:
                raise RotationMatrixError(self.name, "the matrix is a reflection", "Use a right-handed frame")
            object.__setattr__(self, "rotation_matrix", tuple(map(tuple, m.tolist())))
        else:
            angles = (self.angles_from,) if isinstance(self.angles_from, str) else tuple(self.angles_from)
            wanted = {"stability": 1, "wind": 2}.get(self.convention)
            if wanted is None:
                raise AxisError(self.name, f"unknown convention {self.convention!r}", "Use 'stability' (alpha) or 'wind' (alpha, beta)")
            if len(angles) != wanted:
                raise AxisError(self.name, f"{self.convention} takes {wanted} angles", "Name them in order: alpha, then beta")
            object.__setattr__(self, "angles_from", angles)


@dataclass(frozen=True)
class Group:
    components: tuple[str, str, str]
    axis: str = "body"
    declared: bool = True


@dataclass(frozen=True)
class Axes:
    """Registered axes and the groups of variables that are vectors."""

    registered: Mapping[str, Axis] = field(default_factory=dict)
    groups: Mapping[str, Group] = field(default_factory=dict)

    def register(self, axis: Axis) -> Axes:
        if axis.name in BUILT_IN or axis.name in self.registered:
            raise AxisError(axis.name, "the name is taken", "Choose another name")
        return replace(self, registered={**self.registered, axis.name: axis})

    def axis(self, name: str) -> Axis | None:
        """None is body, whose matrix is the identity."""
        if name == "body":
            return None
        if name == "stability":
            return Axis("stability", angles_from=("alpha",), convention="stability")
        if name == "wind":
            return Axis("wind", angles_from=("alpha", "beta"), convention="wind")
        if name not in self.registered:
            raise AxisNotFoundError(name, "unknown axis", "Axes are: " + ", ".join([*BUILT_IN, *self.registered]))
        return self.registered[name]

    def declare(self, name: str, components: tuple, axis: str, variables: Collection[str]) -> Axes:
        self.axis(axis)
        if name in self.groups:
            raise VectorGroupError(name, "the group exists", "Choose another name")
        if len(components) != 3 or len(set(components)) != 3:
            raise VectorGroupError(name, f"{components} are not three variables", "Name three different ones")
        absent = [c for c in components if c not in variables]
        if absent:
            raise VectorGroupError(name, f"{absent} are no variables", "Variables are: " + ", ".join(variables))
        taken = {c for g in self.groups.values() for c in g.components} & set(components)
        if taken:
            raise VectorGroupError(name, f"{sorted(taken)} belong to another group", "A variable is in one group")
        return replace(self, groups={**self.groups, name: Group(components, axis)})

    def without(self, names: Collection[str]) -> Axes:
        """Groups that lose a component are no vectors any more."""
        return replace(self, groups={k: g for k, g in self.groups.items() if not set(g.components) & set(names)})

    def all_groups(self, variables: Collection[str]) -> dict[str, Group]:
        out = dict(self.groups)
        taken = {c for g in out.values() for c in g.components}
        for name, triple in KNOWN_GROUPS.items():
            if name not in out and all(c in variables for c in triple) and not taken & set(triple):
                out[name] = Group(triple, "body", False)
        return out

    @property
    def vector_groups(self) -> dict[str, tuple[str, str, str]]:
        return {k: g.components for k, g in self.groups.items()}

    def group_axis(self, name: str) -> str:
        if name not in self.groups:
            raise VectorGroupError(name, "unknown vector group", "Groups are: " + (", ".join(self.groups) or "none"))
        return self.groups[name].axis

    def current(self) -> dict:
        return {k: (g.components, g.axis) for k, g in self.groups.items()}


def axes_to_plain(axes: Axes) -> dict:
    return {
        "axes": [{"name": a.name, "rotation_matrix": a.rotation_matrix, "angles_from": a.angles_from, "convention": a.convention, "description": a.description} for a in axes.registered.values()],
        "groups": {k: {"components": list(g.components), "axis": g.axis, "declared": g.declared} for k, g in axes.groups.items()},
    }


def axes_from_plain(plain: dict) -> Axes:
    made = [Axis(**{**a, "rotation_matrix": a["rotation_matrix"], "angles_from": tuple(a["angles_from"]) if a["angles_from"] else None}) for a in plain["axes"]]
    return Axes({a.name: a for a in made}, {k: Group(tuple(g["components"]), g["axis"], g["declared"]) for k, g in plain["groups"].items()})


# ---------------------------------------------------------------------- matrices of columns

Matrix = list[list[Column | float]]


def _times(a, b):
    """Product of two numbers or columns; zeros and ones cost nothing."""
    for x, y in ((a, b), (b, a)):
        if isinstance(x, float) and x in (0.0, 1.0):
            return 0.0 if x == 0.0 else y
    return (n.lit(a) if isinstance(a, float) and not isinstance(b, float) else a) * (n.lit(b) if isinstance(b, float) and not isinstance(a, float) else b)


def _plus(a, b):
    if isinstance(a, float) and a == 0.0:
        return b
    if isinstance(b, float) and b == 0.0:
        return a
    return (n.lit(a) if isinstance(a, float) and not isinstance(b, float) else a) + (n.lit(b) if isinstance(b, float) and not isinstance(a, float) else b)


def _sum(items):
    out = 0.0
    for x in items:
        out = _plus(out, x)
    return out


def _product(a: Matrix, b: Matrix) -> Matrix:
    return [[_sum(_times(a[i][k], b[k][j]) for k in range(3)) for j in range(len(b[0]))] for i in range(3)]


def _transposed(a: Matrix) -> Matrix:
    return [list(r) for r in zip(*a, strict=True)]


def _column(x) -> Column:
    return n.lit(x) if isinstance(x, float) else x


def _about_y(c, s) -> Matrix:
    return [[c, 0.0, s], [0.0, 1.0, 0.0], [_times(-1.0, s), 0.0, c]]


def _about_z(c, s) -> Matrix:
    return [[c, s, 0.0], [_times(-1.0, s), c, 0.0], [0.0, 0.0, 1.0]]


_IDENTITY: Matrix = [[float(i == j) for j in range(3)] for i in range(3)]
_Y_SLOPE = lambda c, s: [[_times(-1.0, s), 0.0, c], [0.0, 0.0, 0.0], [_times(-1.0, c), 0.0, _times(-1.0, s)]]
_Z_SLOPE = lambda c, s: [[_times(-1.0, s), c, 0.0], [_times(-1.0, c), _times(-1.0, s), 0.0], [0.0, 0.0, 0.0]]


def _angle(grid: Grid, name: str) -> Column:
    """An angle of each cell in radians; its unit must be known."""
    if name in grid.dim_names:
        unit = grid.dim(name, numeric=True).unit
    elif name in grid.vars:
        unit = grid.vars[name].unit
    else:
        raise AxisError(name, "is neither a dimension nor a variable", "The axis is defined by this angle")
    if unit not in ("deg", "rad"):
        raise AxisError(name, f"its unit is {unit!r}", "Set it to 'deg' or 'rad' with set_metadata")
    return col(name) * n.lit(math.pi / 180.0) if unit == "deg" else col(name)


def _matrix(grid: Grid, axis: Axis | None) -> tuple[Matrix, dict[str, Matrix]]:
    """Matrix from body to an axis, and its derivatives by each angle."""
    if axis is None:
        return _IDENTITY, {}
    if axis.rotation_matrix is not None:
        return [list(r) for r in axis.rotation_matrix], {}
    alpha = _angle(grid, axis.angles_from[0])
    ca, sa = F.cos(alpha), F.sin(alpha)
    if axis.convention == "stability":
        return _about_y(ca, sa), {axis.angles_from[0]: _Y_SLOPE(ca, sa)}
    beta = _angle(grid, axis.angles_from[1])
    cb, sb = F.cos(beta), F.sin(beta)
    return _product(_about_z(cb, sb), _about_y(ca, sa)), {
        axis.angles_from[0]: _product(_about_z(cb, sb), _Y_SLOPE(ca, sa)),
        axis.angles_from[1]: _product(_Z_SLOPE(cb, sb), _about_y(ca, sa)),
    }


def _covariance(grid: Grid, names: Sequence[str], flag: str, name_of) -> Matrix:
    """Covariance of some variables within a cell, from their u and declared correlations."""
    u = [col(name_of(v)) if getattr(grid.vars[v], flag) else 0.0 for v in names]
    size = len(names)
    return [[_times(_times(u[i], u[j]), 1.0 if i == j else float(correlated(grid.correlation, names[i], names[j]))) for j in range(size)] for i in range(size)]


def _transformed(jacobian: list[list], covariance: Matrix) -> Matrix:
    inner = range(len(covariance))
    left = [[_sum(_times(row[k], covariance[k][j]) for k in inner) for j in inner] for row in jacobian]
    return [[_sum(_times(row[k], other[k]) for k in inner) for other in jacobian] for row in left]


def rotate(grid: Grid, target_axis: str, vector_groups: Sequence[str] | None) -> Grid:
    """Components of vector groups in another axis: one projection, no shuffle."""
    target = grid.axes.axis(target_axis)
    groups = grid.axes.all_groups(grid.vars)
    if vector_groups is not None:
        absent = [g for g in vector_groups if g not in groups]
        if absent:
            raise VectorGroupError(", ".join(absent), "unknown vector group", "Groups are: " + (", ".join(groups) or "none"))
        groups = {k: groups[k] for k in vector_groups}
    if not groups:
        raise VectorGroupError("rotate", "there is no vector group", "Declare one with declare_vector, or name variables FX, FY, FZ")
    todo = {k: g for k, g in groups.items() if g.axis != target_axis}
    to, to_slopes = _matrix(grid, target)
    new: dict[str, Column] = {}
    store, vars_, notes = dict(grid.correlation), dict(grid.vars), []
    checks: list[tuple[str, str, str, Column, Column]] = []
    for key, g in todo.items():
        at, at_slopes = _matrix(grid, grid.axes.axis(g.axis))
        r = _product(to, _transposed(at))
        v = [[col(c)] for c in g.components]
        turned = _product(r, v)
        angles = [a for a in dict.fromkeys([*to_slopes, *at_slopes])]
        angle_vars = [a for a in angles if a in grid.vars and grid.vars[a].uncertain]
        if set(g.components) & set(angles):
            raise AxisError(key, "a component is an angle of the axis", "Choose another group or axis")
        carriers = [c for c in g.components if grid.vars[c].uncertain]
        for a, b in grid.correlation:
            inside, outside = ({a, b} & set(g.components)), ({a, b} - set(g.components))
            if (inside and outside and (carriers or grid.vars[outside.copy().pop()].uncertain)) or ({a, b} & set(angle_vars)):
                raise AxisError(f"{a}, {b}", f"a declared correlation crosses group {key} or an angle", "Drop it with drop_correlation before rotating")
        for c, row in zip(g.components, turned, strict=True):
            new[c] = _column(row[0])
        if not carriers and not angle_vars:
            continue
        pairs: dict[tuple[int, int], list[tuple[Column, Column]]] = {}
        for flag, name_of in (("sys", u_sys), ("rand", u_rand)):
            having = any(getattr(grid.vars[c], flag) for c in g.components)
            having_angles = [a for a in angle_vars if getattr(grid.vars[a], flag)]
            if not having and not having_angles:
                continue
            cov = _transformed(r, _covariance(grid, g.components, flag, name_of))
            for a in having_angles:
                slope = [[0.0] * 3 for _ in range(3)]
                if a in to_slopes:
                    slope = _product(to_slopes[a], _transposed(at))
                if a in at_slopes:
                    extra = _product(to, _transposed(at_slopes[a]))
                    slope = [[_plus(slope[i][j], extra[i][j]) for j in range(3)] for i in range(3)]
                unit = vars_[a].unit
                u = col(name_of(a)) * n.lit(math.pi / 180.0) if unit == "deg" else col(name_of(a))
                moved = [row[0] for row in _product(slope, v)]
                cov = [[_plus(cov[i][j], _times(_times(moved[i], moved[j]), u * u)) for j in range(3)] for i in range(3)]
            trace = _column(_sum(cov[i][i] for i in range(3)))
            for i, c in enumerate(g.components):
                new[name_of(c)] = clamped_root(_column(cov[i][i]), trace, 12, c)
                vars_[c] = replace(vars_[c], **{flag: True})
            for i in range(3):
                for j in range(i):
                    vi, vj, cij = _column(cov[i][i]), _column(cov[j][j]), _column(cov[i][j])
                    real = (vi > n.lit(1e-24) * trace) & (vj > n.lit(1e-24) * trace)
                    pairs.setdefault((j, i), []).append((F.when(real, cij / F.sqrt(vi * vj)), real))
        for (j, i), found in pairs.items():
            a, b = sorted((g.components[j], g.components[i]))
            for rho, _ in found:
                checks.append((key, a, b, F.min(rho), F.max(rho)))
    if checks:  # one job decides which correlations are the same in all cells
        row = grid.cells.agg(*[c.alias(f"{w}{i}") for i, x in enumerate(checks) for w, c in (("lo", x[3]), ("hi", x[4]))]).first()
        seen: dict[tuple[str, str], list] = {}
        for i, (_, a, b, _, _) in enumerate(checks):
            seen.setdefault((a, b), []).append((row[f"lo{i}"], row[f"hi{i}"]))
        for (a, b), spans in seen.items():
            spans = [s for s in spans if s[0] is not None and not math.isnan(s[0])]
            lo, hi = (min(s[0] for s in spans), max(s[1] for s in spans)) if spans else (0.0, 0.0)
            uniform = hi - lo <= 1e-12 + 1e-9 * max(abs(lo), abs(hi))
            declared = (a, b) in grid.correlation
            store.pop((a, b), None)
            if uniform and abs(lo) > 1e-12:
                store[a, b] = max(-1.0, min(1.0, float(lo)))
            elif not uniform and declared:
                raise AxisError(f"{a}, {b}", "the rotated correlation differs between cells or components, so no coefficient states it", "Drop the declared correlation before rotating")
            elif not uniform:
                notes.append(f"correlation_not_stored {a}, {b}")
    registry = grid.axes
    for key, g in todo.items():
        registry = replace(registry, groups={**registry.groups, key: replace(g, axis=target_axis)})
    roots = dict(grid.roots)
    for g in todo.values():  # the components now share each other's origins
        own = frozenset().union(*(grid.roots.get(c, frozenset()) for c in g.components))
        for c in g.components:
            if vars_[c].uncertain:
                roots[c] = own
    notes.insert(0, "groups=" + ", ".join(todo))
    out = replace(grid, vars=vars_, axes=registry, correlation=store, roots=roots, note="; ".join(notes))
    cells = grid.cells.withColumns(new) if new else grid.cells
    return replace(out, cells=cells.select(*map(col, out.dim_names), *map(col, out.columns())))


def _point(value: object, what: str) -> list[float]:
    try:
        p = [float(x) for x in value]
    except (TypeError, ValueError) as error:
        raise AxisError(what, f"{value!r} is no point", "Pass three numbers") from error
    if len(p) != 3 or not all(map(math.isfinite, p)):
        raise AxisError(what, f"{value!r} is no point", "Pass three finite numbers")
    return p


def translate_moments(grid: Grid, to_point: object, from_point: object, axis: str | None, force: str | None, moment: str | None) -> Grid:
    """M' = M + r x F with r from the new point to the old one."""
    groups = grid.axes.all_groups(grid.vars)

    def pick(name: str | None, what: str) -> tuple[str, Group]:
        if name is None:
            known = KNOWN_GROUPS[what]
            found = [(k, g) for k, g in groups.items() if k == what or g.components == known]
            if not found:
                raise VectorGroupError(what, f"no group of {', '.join(known)}", f"Pass {what}= with the name of a declared group")
            return found[0]
        if name not in groups:
            raise VectorGroupError(name, "unknown vector group", "Groups are: " + (", ".join(groups) or "none"))
        return name, groups[name]

    force_name, f = pick(force, "force")
    moment_name, m = pick(moment, "moment")
    if force_name == moment_name:
        raise VectorGroupError(force_name, "is both force and moment", "Name two groups")
    if f.axis != m.axis:
        raise VectorGroupError(f"{force_name}, {moment_name}", f"are in axes {f.axis} and {m.axis}", "Rotate both to one axis")
    if axis is not None and axis != f.axis:
        raise VectorGroupError(axis, f"the groups are in {f.axis}", "State their axis or rotate them")
    to, at = _point(to_point, "to_point"), _point(from_point if from_point is not None else (0.0, 0.0, 0.0), "from_point")
    r1, r2, r3 = (a - b for a, b in zip(at, to, strict=True))
    s = [[0.0, -r3, r2], [r3, 0.0, -r1], [-r2, r1, 0.0]]
    names = [*f.components, *m.components]
    having = [v for v in names if grid.vars[v].uncertain]
    if having and set(m.components) & grid.transferred:
        raise UncertaintyLineageError(", ".join(m.components), "were transferred before, so moments and forces share errors that are not stored", "Transfer once, from the original to the final point")
    new: dict[str, Column] = {}
    vars_ = dict(grid.vars)
    for row, c in zip(s, m.components, strict=True):
        new[c] = _column(_plus(col(c), _sum(_times(w, col(x)) for w, x in zip(row, f.components, strict=True))))
    jacobian = [[*row, *(float(i == j) for j in range(3))] for i, row in enumerate(s)]
    for flag, name_of in (("sys", u_sys), ("rand", u_rand)):
        if any(getattr(grid.vars[v], flag) for v in names):
            cov = _transformed(jacobian, _covariance(grid, names, flag, name_of))
            trace = _column(_sum(cov[i][i] for i in range(3)))
            for i, c in enumerate(m.components):
                new[name_of(c)] = clamped_root(_column(cov[i][i]), trace, 40, c)
                vars_[c] = replace(vars_[c], **{flag: True})
    store = {k: r for k, r in grid.correlation.items() if not set(k) & set(m.components)}
    roots = dict(grid.roots)
    both = frozenset().union(*(grid.roots.get(v, frozenset()) for v in names))
    for c in m.components:
        if vars_[c].uncertain:
            roots[c] = both
    notes = [f"axis={f.axis!r}"] * (axis is None) + ["correlation=dropped"] * (len(store) < len(grid.correlation))
    out = replace(grid, vars=vars_, correlation=store, roots=roots, note="; ".join(notes), transferred=grid.transferred | set(m.components) if having else grid.transferred)
    return replace(out, cells=grid.cells.withColumns(new).select(*map(col, out.dim_names), *map(col, out.columns())))
