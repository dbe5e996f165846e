"""The grid: one wide DataFrame with a row per cell, and what the driver knows about it.

A cell without a row is missing: its values and uncertainties are NaN. Dimension coordinates
are kept, in order, on the driver, but for the ``datapoint`` dimension of raw tables, which
has one row per point and no coordinates. Values travel with mirror columns: ``u_sys__x`` and
``u_rand__x`` for the two components of standard uncertainty, ``tag__x`` for the origin of a
value (0 original, 1 interpolated or computed, -1 extrapolated).
"""

from __future__ import annotations

import functools
import inspect
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DataError, DimensionError, DimensionNotFoundError, DuplicateNameError, NonNumericDimensionError, VariableError
from .functions import numeric as n
from .plans.history import History, Provenance, Step

DATAPOINT = "datapoint"


class _NoDefault:
    """Tells an argument that was not given from None."""

    def __repr__(self) -> str:
        return "no_default"


no_default = _NoDefault()


@dataclass(frozen=True)
class Dim:
    """A named axis with its coordinates in grid order; None for raw datapoints."""

    name: str
    coords: tuple | None
    unit: str | None = None
    description: str | None = None

    @property
    def numeric(self) -> bool:
        return self.coords is None or all(isinstance(x, int | float) for x in self.coords)

    @property
    def is_numeric(self) -> bool:
        return self.numeric

    def __len__(self) -> int:
        return len(self.coords or ())


class Correlations(dict):
    """Declared coefficients by sorted pair; ``get(a, b)`` takes the names in any order."""

    @property
    def pairs(self) -> dict:
        return dict(self)

    def get(self, key, default=None):
        if isinstance(key, str):
            return super().get((min(key, default), max(key, default)))
        return super().get(key, default)


@dataclass(frozen=True)
class Tags:
    """Origin tags of the tagged variables, as arrays of the grid's shape."""

    tags: Mapping


@dataclass(frozen=True)
class Uncertainty:
    """Both components of standard uncertainty, as arrays of the grid's shape."""

    systematic: Mapping
    random: Mapping

    def combined(self, name: str):
        parts = [m[name] for m in (self.systematic, self.random) if name in m]
        return sum(x * x for x in parts) ** 0.5


@dataclass(frozen=True)
class Var:
    """What is known of a variable besides its column."""

    unit: str | None = None
    description: str | None = None
    long_name: str | None = None
    sys: bool = False
    rand: bool = False
    tagged: bool = False
    absent_tag: int = 0  # the tag of cells without a row
    fitted: tuple | None = None  # ranges of fitted dimensions, by coefficient dimension
    of: Any = field(default=None, init=False, compare=False, repr=False)  # (grid, name)

    @property
    def values(self):
        """The cells as an array of the grid's shape; this runs the plan."""
        from .sources.export import _arrays

        grid, name = self.of
        out = _arrays(grid, [name])[name]
        out.setflags(write=False)
        return out

    @property
    def uncertain(self) -> bool:
        return self.sys or self.rand


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def u_sys(name: str) -> str:
    return f"u_sys__{name}"


def u_rand(name: str) -> str:
    return f"u_rand__{name}"


def tag(name: str) -> str:
    return f"tag__{name}"


def operation(method: Callable | None = None, *, replayable: bool = True):
    """A method that derives a grid: its call is written to the history of the result."""
    if method is None:
        return functools.partial(operation, replayable=replayable)
    signature = inspect.signature(method)

    @functools.wraps(method)
    def run(self: Grid, *args: Any, history: bool = False, comment: str | None = None, **kwargs: Any) -> Grid:
        bound = signature.bind(self, *args, **kwargs)
        result = method(self, *args, **kwargs)
        call: dict[str, Any] = {}
        for name, value in bound.arguments.items():
            if name == "self":
                continue
            kind = signature.parameters[name].kind
            if kind is inspect.Parameter.VAR_KEYWORD:
                call |= value
            elif kind is inspect.Parameter.VAR_POSITIONAL:
                call |= {"args": value} if value else {}
            else:
                call[name] = value
        return result._record(method.__name__, call, replayable, history, comment)

    run.replayable = replayable
    return run


@dataclass(frozen=True, eq=False)
class Grid:
    """An immutable labelled grid over a lazily evaluated DataFrame."""

    cells: DataFrame
    dimensions: tuple[Dim, ...]
    vars: Mapping[str, Var]
    provenance: Provenance
    history: History = field(default_factory=History)
    correlation: Mapping[tuple[str, str], float] = field(default_factory=dict)
    axes: Any = None
    mode: str = "production"
    coords: str = "cartesian"
    dense: bool = False  # every cell is known to have a row
    roots: Mapping[str, frozenset[str]] = field(default_factory=dict)  # origins of each uncertain variable
    interpolated: frozenset[str] = frozenset()  # dimensions whose points are mixtures of measured ones
    transferred: frozenset[str] = frozenset()  # moments that were moved with their uncertainty
    note: str = ""  # what the operation adds to its history entry

    def __post_init__(self) -> None:
        names = [d.name for d in self.dimensions] + list(self.vars)
        if len(set(names)) != len(names):
            raise DuplicateNameError(", ".join(sorted({x for x in names if names.count(x) > 1})), "named twice among dimensions and variables", "Rename one of them before loading")
        if self.axes is None:
            from .operators.geometry import Axes

            object.__setattr__(self, "axes", Axes())
        bound = {}
        for name, spec in self.vars.items():
            bound[name] = replace(spec)
            object.__setattr__(bound[name], "of", (self, name))
        object.__setattr__(self, "vars", bound)
        object.__setattr__(self, "correlation", Correlations(self.correlation))

    # ------------------------------------------------------------------ structure

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    @property
    def dims(self) -> dict[str, Dim]:
        """Dimensions by name, in grid order."""
        return {d.name: d for d in self.dimensions}

    @property
    def tags(self) -> Tags | None:
        """Origin tags, or None where every value is original; this runs the plan."""
        from .sources.export import _arrays

        names = [v for v, s in self.vars.items() if s.tagged]
        if not names:
            return None
        found = _arrays(self, [tag(v) for v in names])
        return Tags({v: found[tag(v)].astype("int8") for v in names})

    @property
    def uncertainty(self) -> Uncertainty | None:
        """Both components, or None where no variable has any; this runs the plan."""
        from .sources.export import _arrays

        sys = [v for v, s in self.vars.items() if s.sys]
        rand = [v for v, s in self.vars.items() if s.rand]
        if not sys and not rand:
            return None
        found = _arrays(self, [*map(u_sys, sys), *map(u_rand, rand)])
        return Uncertainty({v: found[u_sys(v)] for v in sys}, {v: found[u_rand(v)] for v in rand})

    @property
    def is_datapoint(self) -> bool:
        return len(self.dimensions) == 1 and self.dimensions[0].coords is None

    @property
    def dim_names(self) -> list[str]:
        return [d.name for d in self.dimensions if d.coords is not None]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.cells.count() if d.coords is None else len(d) for d in self.dimensions)

    @property
    def uncertain(self) -> list[str]:
        return [v for v, s in self.vars.items() if s.uncertain]

    def dim(self, name: str, numeric: bool = False) -> Dim:
        for d in self.dimensions:
            if d.name == name and d.coords is not None:
                if numeric and not d.numeric:
                    raise NonNumericDimensionError(name, "its coordinates are strings", "Choose a numeric dimension: " + (", ".join(x.name for x in self.dimensions if x.coords is not None and x.numeric) or "there is none"))
                return d
        raise DimensionNotFoundError(name, "is not a dimension with coordinates", "Dimensions are: " + (", ".join(self.dim_names) or "none; pivot the datapoints first"))

    def var(self, name: str) -> Var:
        if name not in self.vars:
            raise VariableError(name, "is not a variable", "Variables are: " + ", ".join(self.vars))
        return self.vars[name]

    def columns(self, names: Sequence[str] | None = None) -> list[str]:
        """Variable columns with their mirrors."""
        out = []
        for v in self.vars if names is None else names:
            s = self.vars[v]
            out += [v, *[u_sys(v)] * s.sys, *[u_rand(v)] * s.rand, *[tag(v)] * s.tagged]
        return out

    def tag_column(self, name: str) -> Column:
        return col(tag(name)) if self.vars[name].tagged else F.lit(0).cast("byte")

    def expected_cells(self) -> int | None:
        """Cells of the full grid; None for datapoints, which have no missing cells."""
        return None if self.is_datapoint else math.prod(len(d) for d in self.dimensions)

    def coordinate_table(self, name: str) -> DataFrame:
        """(coordinate, ordinal) rows of a dimension, in grid order; its size is the dimension's."""
        d = self.dim(name)
        kind = T.DoubleType() if d.numeric else T.StringType()
        schema = T.StructType([T.StructField(name, kind), T.StructField("__ordinal", T.IntegerType())])
        return self.spark.createDataFrame([(float(x) if d.numeric else x, i) for i, x in enumerate(d.coords)], schema)

    def ordinal(self, name: str) -> Column:
        """Position of a cell along a dimension, as an expression over its coordinates."""
        d = self.dim(name)
        if d.numeric and list(d.coords) == sorted(d.coords):
            return col(name)  # orders as the ordinal does
        return F.array_position(F.array(*[F.lit(float(x) if d.numeric else x) for x in d.coords]), col(name))

    def densified(self, along: Sequence[str] | None = None) -> Grid:
        """Every cell gets a row, or every cell of the lines along some dimensions that have any."""
        if self.dense or self.is_datapoint:
            return self
        names = self.dim_names
        along = names if along is None else [x for x in names if x in along]
        rest = [x for x in names if x not in along]
        frame = self.cells.select(*map(col, rest)).distinct() if rest else None
        for x in along:
            table = F.broadcast(self.coordinate_table(x).drop("__ordinal"))
            frame = table if frame is None else frame.crossJoin(table)
        joined = frame.join(self.cells, names, "left")
        fill = [*map(col, names)]
        for v, s in self.vars.items():
            fill.append(n.or_nan(col(v)).alias(v))
            fill += [n.or_nan(col(c)).alias(c) for c, has in ((u_sys(v), s.sys), (u_rand(v), s.rand)) if has]
            if s.tagged:
                fill.append(F.coalesce(col(tag(v)), F.lit(s.absent_tag).cast("byte")).alias(tag(v)))
        return replace(self, cells=joined.select(*fill), dense=not rest)

    def restricted_correlation(self, keep: Sequence[str]) -> dict[tuple[str, str], float]:
        return {k: r for k, r in self.correlation.items() if k[0] in keep and k[1] in keep}

    def only(self, names: Sequence[str]) -> dict[str, Var]:
        return {v: self.vars[v] for v in names}

    # ------------------------------------------------------------------ history

    def _record(self, call: str, kwargs: dict, replayable: bool, history: bool, comment: str | None) -> Grid:
        text = f"{call}({', '.join(f'{k}={_plain(v)!r}' for k, v in kwargs.items())})" + (f" [{self.note}]" if self.note else "")
        if self.mode == "draft" and not history:
            return replace(self, note="")
        step = Step(call, {k: _plain(v) for k, v in kwargs.items()}, comment) if replayable else None
        return replace(self, history=self.history.append(text, comment, step, self.mode), note="")

    @property
    def state_hash(self) -> str:
        """Digest of contents, metadata and history; runs one aggregate over the cells."""
        from .plans.hashing import state_hash

        return state_hash(self)

    def promote(self, mode: str = "production", *, comment: str | None = None) -> Grid:
        return self._switch(mode, "promote", "production", comment)

    def demote(self, mode: str = "draft", *, comment: str | None = None) -> Grid:
        return self._switch(mode, "demote", "draft", comment)

    def _switch(self, mode: str, call: str, wanted: str, comment: str | None) -> Grid:
        from .errors import ModeError

        if mode != wanted or self.mode == mode:
            raise ModeError(mode, f"{call} from {self.mode}", f"{call} leads from the other mode to {wanted}")
        return replace(replace(self, mode=mode)._record(call, {"mode": mode}, False, True, comment), provenance=replace(self.provenance, mode=mode))

    # ------------------------------------------------------------------ operations

    @operation(replayable=False)
    def pivot(self, dims: Sequence[str] | None = None, *, auto_detect: bool = False, threshold: int = 20) -> Grid:
        from .operators.reshape import pivot

        return pivot(self, dims, auto_detect, threshold)

    @operation
    def select(self, filters: Mapping[str, object], Frame: str = "VarFrame") -> Grid:  # noqa: N803
        from .operators.select import select

        return select(self, filters, Frame)

    @operation
    def at(self, **coords: object) -> Grid:
        from .operators.select import at

        return at(self, coords)

    @operation
    def squeeze(self, along: str | None = None) -> Grid:
        from .operators.reshape import squeeze

        return squeeze(self, along)

    @operation
    def expand(self, dim_name: str, values: object, *, axis: int | None = None) -> Grid:
        from .operators.reshape import expand

        return expand(self, dim_name, values, axis)

    @operation
    def compute(self, equation: str, *, debug: bool = False, where: str | None = None, fill: float | None = math.nan, method: str = "symbolic") -> Grid:
        from .operators.compute import compute

        return compute(self, equation, debug, where, fill, method)

    @operation
    def average(self, along: str | list[str]) -> Grid:
        from .operators.reduce import average

        return average(self, along)

    @operation
    def integrate(self, var: str, *, over: str | list[str], coords: str | None = None, skipna: bool = False) -> Grid:
        from .operators.reduce import integrate

        return integrate(self, var, over, coords, skipna)

    @operation
    def interpolate(
        self,
        mapping: Mapping[str, object] | None = None,
        *,
        method: str = "linear",
        deg: int | _NoDefault = no_default,
        override: bool = False,
        axisTranslation: Mapping[str, str] | None = None,  # noqa: N803
    ) -> Grid:
        from .operators.interpolate import interpolate

        return interpolate(self, mapping, method, deg, override, axisTranslation)

    @operation
    def smooth(
        self, *, along: str, method: str, window: int | _NoDefault = no_default, polyorder: int | _NoDefault = no_default, smoothing: float | _NoDefault = no_default
    ) -> Grid:
        from .operators.kernels import smooth

        return smooth(self, along, method, window, polyorder, smoothing)

    @operation
    def diff(self, *, along: str, window: int = 5, deg: int = 2, nan_edges: bool = False) -> Grid:
        from .operators.kernels import diff

        return diff(self, along, window, deg, nan_edges)

    @property
    def d(self) -> _Differentiator:
        return _Differentiator(self)

    @operation
    def fitmodel(self, *, along: str, deg: int) -> Grid:
        from .operators.fit import fitmodel

        return fitmodel(self, along, deg)

    @operation
    def fitvalue(self, *, coef_dims: list[str], at: Mapping[str, object]) -> Grid:
        from .operators.fit import fitvalue

        return fitvalue(self, coef_dims, at)

    @operation
    def fill(self, along: str, *args: str, method: str = "linear", deg: int | None = None, window: int | None = None, global_fit: bool = False) -> Grid:
        from .operators.fill import fill

        return fill(self, along, args, method, deg, window, global_fit)

    @operation
    def register_axis(self, axis: Any) -> Grid:
        return replace(self, axes=self.axes.register(axis))

    @operation
    def declare_vector(self, name: str, components: Sequence[str], *, axis: str = "body") -> Grid:
        return replace(self, axes=self.axes.declare(name, tuple(components), axis, self.vars))

    @operation
    def rotate(self, target_axis: str, *, vector_groups: Sequence[str] | None = None) -> Grid:
        from .operators.geometry import rotate

        return rotate(self, target_axis, vector_groups)

    @operation
    def translate_moments(
        self, *, to_point: Sequence[float], from_point: Sequence[float] | None = None, axis: str | None = None, force: str | None = None, moment: str | None = None
    ) -> Grid:
        from .operators.geometry import translate_moments

        return translate_moments(self, to_point, from_point, axis, force, moment)

    @operation
    def set_uncertainty(self, spec: Mapping[str, float | str], *, component: str = "systematic") -> Grid:
        from .operators.uncertainty import set_uncertainty

        return set_uncertainty(self, spec, component)

    @operation
    def set_metadata(self, spec: Mapping[str, Mapping[str, str | None]]) -> Grid:
        from .operators.uncertainty import set_metadata

        return set_metadata(self, spec)

    @operation
    def set_correlation(self, spec: Mapping[tuple[str, str], float]) -> Grid:
        from .operators.uncertainty import set_correlation

        return set_correlation(self, spec)

    @operation
    def drop_correlation(self, names: Sequence[str] | None = None) -> Grid:
        from .operators.uncertainty import drop_correlation

        return drop_correlation(self, names)

    @operation(replayable=False)
    def combine(self, other: Grid, *, op: str, weights: tuple[float, float] | None = None, cross_correlation: float = 0.0) -> Grid:
        from .operators.combine import combine

        return combine(self, other, op, weights, cross_correlation)

    # ------------------------------------------------------------------ reports and sinks

    def inspect(self, threshold: int = 20) -> dict:
        from .sources.reports import inspect_grid

        return inspect_grid(self, threshold)

    def summary(self):
        from .sources.reports import summary

        return summary(self)

    def diagnostics(self, log=None):
        from .sources.reports import diagnostics

        return diagnostics(self, log)

    def to_csv(self, path, *, split_by: str | None = None, allow_draft: bool = False, distributed: bool = False):
        from .sources.export import to_csv

        return to_csv(self, path, split_by, allow_draft, distributed)

    def to_json(self, path, *, allow_draft: bool = False, distributed: bool = False):
        from .sources.export import to_json

        return to_json(self, path, allow_draft, distributed)

    def to_pandas(self, *, allow_draft: bool = False):
        from .sources.export import to_pandas

        return to_pandas(self, allow_draft)

    def to_numpy(self, *, return_dims: bool = False, copy: bool = False, allow_draft: bool = False):
        from .sources.export import to_numpy

        return to_numpy(self, return_dims, copy, allow_draft)

    def to_parquet(self, path: str, *, allow_draft: bool = False) -> str:
        from .sources.export import to_parquet

        return to_parquet(self, path, allow_draft)

    def save(self, path, *, allow_draft: bool = False):
        from .sources.archive import save

        return save(self, path, allow_draft)

    def manifest(self, path):
        from .sources.reports import manifest

        return manifest(self, path)

    def __getattr__(self, name: str):
        from .plans.registry import accessor

        return accessor(self, name)


class _Differentiator:
    """``grid.d[dim]``: the derivative with default window and degree."""

    def __init__(self, grid: Grid) -> None:
        self._grid = grid

    def __getitem__(self, dim: str) -> Grid:
        if not isinstance(dim, str):
            raise DimensionError(repr(dim), "is not the name of one dimension", "Write grid.d['name']")
        return self._grid.diff(along=dim)


def _plain(value: Any) -> Any:
    """An argument as it can be written down and replayed."""
    import numpy as np

    if isinstance(value, np.ndarray):
        return [_plain(x) for x in value.tolist()]
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, range):
        return list(value)
    if isinstance(value, tuple | list):
        return type(value)(_plain(x) for x in value)
    if isinstance(value, Mapping):
        return {(_plain(k) if not isinstance(k, tuple) else tuple(map(_plain, k))): _plain(v) for k, v in value.items()}
    if isinstance(value, Grid):
        return f"<grid of {', '.join(value.vars)}>"
    return value


def as_coordinates(values: Any, what: str) -> tuple:
    """A 1-D list of unique finite numbers or strings."""
    import numpy as np

    array = np.atleast_1d(np.asarray(values))
    if array.ndim != 1 or not len(array):
        raise DataError(what, "coordinates are not a list", "Pass a one-dimensional, non-empty list")
    if array.dtype.kind in "US":
        out = tuple(str(x) for x in array.tolist())
    else:
        try:
            out = tuple(float(x) + 0.0 for x in array.tolist())
        except (TypeError, ValueError) as error:
            raise DataError(what, "coordinates are neither numbers nor strings", "Pass one kind") from error
        if not all(math.isfinite(x) for x in out):
            raise DataError(what, "coordinates are not finite", "Remove NaN and infinities")
    if len(set(out)) != len(out):
        raise DataError(what, "coordinates repeat", "Pass each once")
    return out
