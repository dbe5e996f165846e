"""gridloom: labelled engineering grids and training-data operators on Spark DataFrames."""

__version__ = "0.1.0"

from .errors import GridError  # noqa: E402
from .grid import Grid, no_default  # noqa: E402
from .operators.geometry import Axis  # noqa: E402
from .operators.reshape import concat  # noqa: E402
from .plans.history import set_mode, set_user  # noqa: E402
from .plans.pipeline import Pipeline, load_pipeline  # noqa: E402
from .plans.registry import register_accessor, register_processor, registered_processors  # noqa: E402
from .plans.workflow import processor  # noqa: E402
from .sources.archive import open_archive as open  # noqa: E402, A004
from .sources.load import load  # noqa: E402

__all__ = [
    "Axis", "Grid", "GridError", "Pipeline", "__version__", "concat", "load", "load_pipeline", "no_default", "open", "processor",
    "register_accessor", "register_processor", "registered_processors", "set_mode", "set_user",
]
