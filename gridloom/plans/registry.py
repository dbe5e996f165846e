"""Extensions by name: processors and accessors."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from ..errors import ProcessorNotFoundError, RegistryError


@runtime_checkable
class Processor(Protocol):
    """What a registered constructor must give."""

    name: str
    version: str

    def validate(self, grid) -> None: ...

    def info(self) -> None: ...

    def __call__(self, grid, **kwargs): ...


_processors: dict[str, Callable] = {}
_accessors: dict[str, type] = {}


def register_processor(name: str, constructor: Callable) -> None:
    if not name or name in _processors:
        raise RegistryError(str(name), "the name is empty or taken", "Choose another name")
    _processors[name] = constructor


def registered_processors() -> list[str]:
    return sorted(_processors)


def make_processor(name: str, config) -> Processor:
    if name not in _processors:
        raise ProcessorNotFoundError(name, "no such processor", "Registered are: " + (", ".join(sorted(_processors)) or "none; pass the path of an equation file"))
    made = _processors[name](config=config) if config else _processors[name]()
    if not isinstance(made, Processor):
        raise RegistryError(name, "its constructor gave no processor", "It needs name, version, validate, info and a call")
    return made


def register_accessor(name: str):
    """Class decorator: ``grid.<name>`` is then the class applied to the grid."""
    from ..grid import Grid

    def mark(kind: type) -> type:
        if not name.isidentifier() or name in _accessors or hasattr(Grid, name) or name in Grid.__dataclass_fields__:
            raise RegistryError(name, "is no free attribute name", "Choose another name")
        _accessors[name] = kind
        return kind

    return mark


def accessor(grid, name: str):
    if name.startswith("__") or name not in _accessors:
        raise AttributeError(name)
    made = _accessors[name](grid)
    object.__setattr__(grid, name, made)  # one instance for each grid
    return made
