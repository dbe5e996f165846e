"""Refusals: what was touched, what was asked for, and what to do instead."""

from __future__ import annotations


class GridError(Exception):
    """Base of all refusals; ``obj``, ``operation`` and ``fix`` make up the message."""

    def __init__(self, obj: str, operation: str, fix: str) -> None:
        self.obj, self.operation, self.fix = obj, operation, fix
        super().__init__(f"{obj}: {operation}. {fix}")


class DataError(GridError):
    """Input data cannot form a grid."""


class DuplicateNameError(DataError):
    """Two columns, dimensions or variables share a name."""


class LoadCoordinateError(DataError):
    """Declared file coordinates do not fit the dimensions."""


class PivotDuplicateError(DataError):
    """Several rows claim one grid cell."""


class DimensionError(GridError):
    """A dimension is missing or has the wrong shape for the operation."""


class DimensionNotFoundError(DimensionError):
    """A dimension that the grid does not have."""


class NonNumericDimensionError(DimensionError):
    """A numeric operation along a dimension of strings."""


class VariableError(GridError):
    """A variable is missing or unfit."""


class AxisTranslationError(VariableError):
    """A variable that cannot replace a dimension."""


class SelectionError(GridError):
    """A selection that names or leaves nothing."""


class EmptySelectionError(SelectionError):
    """Conditions on values that no cell fits."""


class CombineError(GridError):
    """Two grids that do not line up."""


class ConcatOverlapError(CombineError):
    """Concatenated grids share coordinates."""


class DegreeError(GridError):
    """A polynomial degree or window that the points cannot carry."""


class EquationError(GridError):
    """An expression outside the language."""


class UncertaintyError(GridError):
    """Uncertainty that cannot be assigned or carried."""


class UncertaintyLineageError(UncertaintyError):
    """Operands that share an origin and would be treated as independent."""


class CorrelationError(UncertaintyError):
    """Coefficients that no covariance matrix has."""


class CorrelationKeyError(CorrelationError):
    """A coefficient of names that have none."""


class AxisError(GridError):
    """Axes, rotations and vector groups."""


class AxisNotFoundError(AxisError):
    """An axis that is neither built in nor registered."""


class RotationMatrixError(AxisError):
    """A matrix that is no rotation."""


class VectorGroupError(AxisError):
    """A vector group that is missing, taken or unfit."""


class ModeError(GridError):
    """Draft and production mode."""


class IntegrityError(GridError):
    """A stored file that does not match its own digests."""


class PipelineError(GridError):
    """Steps that cannot be replayed."""


class WorkflowError(GridError):
    """Equation files."""


class WorkflowFileError(WorkflowError):
    """An equation file that cannot be read as one."""


class WorkflowCycleError(WorkflowError):
    """Equations that need each other."""


class RegistryError(GridError):
    """Names of processors and accessors."""


class ProcessorNotFoundError(RegistryError):
    """A processor that is not registered."""


class ExportError(GridError):
    """Files that cannot be written as asked."""


class StreamingError(GridError):
    """An operation that needs the whole grid, on a stream."""
