"""Where a grid came from and what was done to it."""

from __future__ import annotations

import datetime
import getpass
import hashlib
import json
import socket
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from ..errors import ModeError, PipelineError

_session: dict[str, str | None] = {"user": None, "mode": "production"}


def set_user(user: str | None) -> None:
    """Name the user of new grids; None returns to the login name and host."""
    _session["user"] = user


def set_mode(mode: str) -> None:
    """Mode of new grids: 'production' records every operation, 'draft' those asked for."""
    if mode not in ("production", "draft"):
        raise ModeError(str(mode), "unknown mode", "Use 'production' or 'draft'")
    _session["mode"] = mode


def session_mode() -> str:
    return _session["mode"]


def current_user() -> str:
    if _session["user"]:
        return _session["user"]
    try:
        return f"{getpass.getuser()}@{socket.gethostname()}"
    except (OSError, KeyError):
        return "unknown"


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


@dataclass(frozen=True)
class Provenance:
    version: str
    user: str
    created_at: str
    sources: tuple[str, ...] = ()
    source_hash: str = ""
    mode: str = "production"
    tag: str | None = None
    coordinates: tuple = ()  # (file, coordinates) of sources that were declared with them


@dataclass(frozen=True)
class Step:
    """A call that can be made again."""

    call: str
    kwargs: dict[str, Any]
    comment: str | None = None


@dataclass(frozen=True)
class Entry:
    index: int
    operation: str
    timestamp: str
    recipe: str
    comment: str | None = None
    step: Step | None = None


@dataclass(frozen=True)
class History:
    """Append-only; every entry's recipe hash covers all entries before it."""

    entries: tuple[Entry, ...] = field(default=())

    def __len__(self) -> int:
        return len(self.entries)

    def __iter__(self) -> Iterator[Entry]:
        return iter(self.entries)

    def __getitem__(self, i: int) -> Entry:
        return self.entries[i]

    @property
    def last(self) -> Entry | None:
        return self.entries[-1] if self.entries else None

    def append(self, operation: str, comment: str | None, step: Step | None, mode: str) -> History:
        before = self.entries[-1].recipe if self.entries else ""
        recipe = hashlib.sha256(json.dumps([before, operation, comment, mode]).encode()).hexdigest()
        entry = Entry(len(self.entries) + 1, operation, now(), recipe, comment, step)
        return replace(self, entries=(*self.entries, entry))

    def to_pipeline(self, start: int | None = None, end: int | None = None):
        """The replayable steps from entry ``start`` to ``end`` (1-based, inclusive)."""
        from .pipeline import Pipeline

        first = start
        if first is None:  # leading loads and pivots make the grid a pipeline is applied to
            first = 1
            while first <= len(self.entries) and self.entries[first - 1].operation.split("(")[0] in ("load", "pivot"):
                first += 1
        last = len(self.entries) if end is None else end
        if not 1 <= first <= last + 1 or last > len(self.entries):
            raise PipelineError(f"entries {first} to {last}", "not in the history", f"It has entries 1 to {len(self.entries)}")
        steps = []
        for entry in self.entries[first - 1 : last]:
            if entry.step is None:
                raise PipelineError(f"entry {entry.index}, {entry.operation}", "cannot be replayed", "Choose start and end around it")
            steps.append(entry.step)
        return Pipeline(tuple(steps), first, last)
