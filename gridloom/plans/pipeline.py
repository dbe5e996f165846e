"""Replayable steps lifted from a history."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from ..errors import IntegrityError, PipelineError
from .history import Step

SCHEMA = "gridloom-pipeline/1"


def kwargs_to_plain(step: Step) -> dict:
    """Arguments as JSON values."""
    from ..operators.geometry import Axis

    def plain(x: Any) -> Any:
        if isinstance(x, Axis):
            return {"name": x.name, "rotation_matrix": x.rotation_matrix, "angles_from": x.angles_from, "convention": x.convention, "description": x.description}
        if isinstance(x, float) and not math.isfinite(x):
            return {"__float__": repr(x)}
        if isinstance(x, dict):
            if any(isinstance(k, tuple) for k in x):
                return [[*k, plain(v)] for k, v in x.items()]
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        if x is None or isinstance(x, str | int | float | bool):
            return x
        raise PipelineError(step.call, f"argument {x!r} cannot be written down", "Pass plain values")

    return {k: plain(v) for k, v in step.kwargs.items()}


def kwargs_from_plain(call: str, kwargs: dict) -> dict:
    from ..operators.geometry import Axis

    def value(x: Any) -> Any:
        if isinstance(x, dict):
            if set(x) == {"__float__"}:
                return float(x["__float__"])
            return {k: value(v) for k, v in x.items()}
        return [value(v) for v in x] if isinstance(x, list) else x

    out = {k: value(v) for k, v in kwargs.items()}
    if call == "register_axis":
        a = out["axis"]
        out["axis"] = Axis(a["name"], a["rotation_matrix"], tuple(a["angles_from"]) if a["angles_from"] else None, a["convention"], None, a["description"])
    if call == "set_correlation":
        out["spec"] = {(a, b): r for a, b, r in out["spec"]}
    return out


def replayable_calls() -> set[str]:
    from ..grid import Grid

    return {k for k in dir(Grid) if getattr(getattr(Grid, k), "replayable", False)}


@dataclass(frozen=True)
class Pipeline:
    """An ordered list of calls; ``apply`` makes them on another grid."""

    steps: tuple[Step, ...]
    start: int = 1
    end: int = 0

    def __len__(self) -> int:
        return len(self.steps)

    def apply(self, grid, *, history: bool = True):
        for step in self.steps:
            if step.call not in replayable_calls():
                raise PipelineError(step.call, "cannot be replayed", "Make the call yourself")
            kwargs = dict(step.kwargs)
            args = kwargs.pop("args", ())
            if step.call == "fill" and args:
                kwargs["method"] = args[0]
            grid = getattr(grid, step.call)(**kwargs, history=history, comment=step.comment)
        return grid

    def _body(self) -> list:
        return [{"call": s.call, "kwargs": kwargs_to_plain(s), "comment": s.comment} for s in self.steps]

    @property
    def content_hash(self) -> str:
        return hashlib.sha256(json.dumps(self._body(), sort_keys=True).encode()).hexdigest()

    def save(self, path) -> Path:
        from .. import __version__

        path = Path(path)
        body = {"schema": SCHEMA, "version": __version__, "history_start": self.start, "history_end": self.end, "content_hash": self.content_hash, "steps": self._body()}
        beside = path.with_name(path.name + ".tmp")
        beside.write_text(json.dumps(body, indent=1), encoding="utf-8")
        beside.replace(path)
        return path


def load_pipeline(path) -> Pipeline:
    """Read a pipeline file, checking every field and its digest."""
    try:
        body = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise PipelineError(str(path), f"cannot be read ({error})", "Pass a file written by Pipeline.save") from error
    if not isinstance(body, dict) or body.get("schema") != SCHEMA:
        raise PipelineError(str(path), "has another schema", f"This version reads {SCHEMA}")
    steps = []
    for i, s in enumerate(body.get("steps") or [], 1):
        if not isinstance(s, dict) or set(s) != {"call", "kwargs", "comment"} or not isinstance(s["kwargs"], dict):
            raise PipelineError(f"step {i}", "is malformed", "Pass a file written by Pipeline.save")
        if s["call"] not in replayable_calls():
            raise PipelineError(f"step {i}", f"{s['call']!r} cannot be replayed", "Remove it")
        steps.append(Step(s["call"], kwargs_from_plain(s["call"], s["kwargs"]), s["comment"]))
    made = Pipeline(tuple(steps), body.get("history_start", 1), body.get("history_end", 0))
    if made.content_hash != body.get("content_hash"):
        raise IntegrityError(str(path), "steps do not match their digest", "The file was changed after it was written")
    return made
