"""Operations that are pure projections, on streaming DataFrames.

Equations, coordinate filters, assigned uncertainty, rotation and moment transfer work row by
row, so a stream of cells passes through them unchanged. What needs other cells (kernels,
interpolation, reductions over the whole grid) refuses a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StreamingError
from ..functions import numeric as n
from ..grid import DATAPOINT, Dim, Grid, Var, col
from ..plans.history import Provenance, current_user, now

ROW_WISE = frozenset(("compute", "set_uncertainty", "set_metadata", "set_correlation", "drop_correlation", "register_axis", "declare_vector", "rotate", "translate_moments"))


@dataclass(frozen=True, eq=False)
class _Carrying(Grid):
    """Datapoints whose other columns stay in every projection."""

    carried: tuple[str, ...] = ()

    @property
    def dim_names(self) -> list[str]:
        return list(self.carried)


class StreamGrid:
    """A grid view of a stream of datapoints, limited to row-wise operations."""

    def __init__(self, grid: Grid) -> None:
        self.grid = grid

    @property
    def frame(self) -> DataFrame:
        return self.grid.cells

    def __getattr__(self, name: str):
        if name.startswith("_") or not hasattr(Grid, name):
            raise AttributeError(name)
        if name not in ROW_WISE:
            raise StreamingError(name, "needs cells that a stream has not delivered", "Use it on a batch; streams take " + ", ".join(sorted(ROW_WISE)))

        def run(*args, **kwargs) -> StreamGrid:
            if name == "rotate" and self.grid.uncertain:
                raise StreamingError(name, "decides on correlations from all cells where uncertainty is carried", "Assign uncertainty after rotating")
            if name == "compute" and "np." in args[0] and any(f"np.{r}(" in args[0].replace(" ", "") for r in ("max", "min", "mean", "sum", "std", "var", "median", "nanmax", "nanmin", "nanmean", "nansum")):
                raise StreamingError(name, "reduces over the whole grid", "Use a windowed average")
            return StreamGrid(getattr(self.grid, name)(*args, **kwargs))

        return run

    def windowed_average(self, time: str, window: str, watermark: str, keys: Sequence[str] = ()) -> DataFrame:
        """Averages over event-time windows; rows later than the watermark are left out."""
        if time not in self.frame.columns:
            raise StreamingError(time, "is no column of the stream", "Name the event-time column")
        aggregates = [n.or_nan(F.avg(F.when(~F.isnan(col(v)), col(v)))).alias(v) for v in self.grid.vars if v not in keys]
        out = self.frame.withWatermark(time, watermark).groupBy(F.window(col(time), window).alias("window"), *map(col, keys)).agg(*aggregates)
        return out.select(F.col("window.start").alias("window_start"), *map(col, keys), *[col(v) for v in self.grid.vars if v not in keys])


def stream_grid(df: DataFrame, variables: Sequence[str]) -> StreamGrid:
    """Datapoints of a stream; columns that are no variables are carried along."""
    absent = [v for v in variables if v not in df.columns]
    if absent:
        raise StreamingError(", ".join(absent), "are no columns of the stream", "Columns are: " + ", ".join(df.columns))
    cells = df.withColumns({v: n.or_nan(col(v).cast("double")) for v in variables})
    made = Provenance("stream", current_user(), now())
    grid = Grid(cells, (Dim(DATAPOINT, None),), {v: Var() for v in variables}, made)
    carried = [c for c in df.columns if c not in variables]
    return StreamGrid(_Carrying(**{f: getattr(grid, f) for f in grid.__dataclass_fields__}, carried=tuple(carried)) if carried else grid)

