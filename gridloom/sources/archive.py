"""The native archive: a folder of Parquet cells and JSON, sealed by a manifest of digests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, replace

from ..errors import DataError, ExportError, IntegrityError
from ..grid import Dim, Grid, Var, col
from ..operators.geometry import axes_from_plain
from ..plans.hashing import content_digest, metadata_of, state_hash
from ..plans.history import Entry, History, Provenance, Step
from ..plans.pipeline import kwargs_from_plain, kwargs_to_plain
from . import files

SCHEMA = "gridloom-archive/1"
MEMBERS = ("cells", "frame.json", "history.json", "provenance.json")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _steps_hash(history: list) -> str:
    return _sha(json.dumps([e["step"] for e in history], sort_keys=True))


def save(grid: Grid, path, allow_draft: bool):
    """Write members first and the manifest last; a folder without one is no archive."""
    if grid.mode == "draft" and not allow_draft:
        raise ExportError("draft", "drafts are not saved", "Promote the grid, or pass allow_draft=True")
    spark, root = grid.spark, str(path).rstrip("/")
    if files.exists(spark, root):
        raise ExportError(root, "exists", "Choose a new folder")
    grid.cells.write.parquet(f"{root}/cells")
    stored = replace(grid, cells=spark.read.schema(grid.cells.schema).parquet(f"{root}/cells"))
    history = [
        {"index": e.index, "operation": e.operation, "timestamp": e.timestamp, "recipe": e.recipe, "comment": e.comment,
         "step": None if e.step is None else {"call": e.step.call, "kwargs": kwargs_to_plain(e.step), "comment": e.step.comment}}
        for e in grid.history
    ]
    texts = {"frame.json": json.dumps(metadata_of(grid)), "history.json": json.dumps(history), "provenance.json": json.dumps(asdict(grid.provenance))}
    for name, text in texts.items():
        files.write_text(spark, f"{root}/{name}", text)
    digests = {"cells": content_digest(stored), **{k: _sha(t) for k, t in texts.items()}}
    seal = {"schema": SCHEMA, "version": grid.provenance.version, "state_hash": state_hash(stored), "steps_hash": _steps_hash(history), "members": digests}
    files.write_text(spark, f"{root}/manifest.json", json.dumps(seal))
    return path


def open_archive(path) -> Grid:
    """Check schema, members and digests, then the steps and the state as a whole."""
    from .load import _session

    spark, root = _session(), str(path).rstrip("/")
    if not files.exists(spark, f"{root}/manifest.json"):
        raise DataError(root, "is no archive: it has no manifest", "Check the path")
    seal = json.loads(files.read_text(spark, f"{root}/manifest.json"))
    if seal.get("schema") != SCHEMA:
        raise IntegrityError(root, f"has schema {seal.get('schema')!r}", f"This version reads {SCHEMA}")
    names = set(files.names_in(spark, root))
    if names - {n for n in names if n.startswith(".")} != {*MEMBERS, "manifest.json"} or set(seal["members"]) != set(MEMBERS):
        raise IntegrityError(root, f"has members {sorted(names)}", f"An archive holds {sorted(MEMBERS)} and its manifest")
    texts = {k: files.read_text(spark, f"{root}/{k}") for k in MEMBERS if k != "cells"}
    for k, text in texts.items():
        if _sha(text) != seal["members"][k]:
            raise IntegrityError(k, "does not match its digest", "The archive was changed after it was written")
    meta, history, made = (json.loads(texts[k]) for k in ("frame.json", "history.json", "provenance.json"))
    if _steps_hash(history) != seal["steps_hash"]:
        raise IntegrityError("history.json", "steps do not match their digest", "The archive was changed after it was written")
    listed = lambda x: tuple(listed(y) for y in x) if isinstance(x, list) else x
    grid = Grid(
        cells=spark.read.parquet(f"{root}/cells"),
        dimensions=tuple(Dim(d["name"], None if d["coords"] is None else tuple(d["coords"]), d["unit"], d["description"]) for d in meta["dims"]),
        vars={v: Var(**{**meta["vars"][v], "fitted": listed(meta["vars"][v]["fitted"]) if meta["vars"][v]["fitted"] else None}) for v in meta["order"]},
        provenance=Provenance(**{**made, "sources": tuple(made["sources"]), "coordinates": listed(made["coordinates"])}),
        history=History(tuple(Entry(e["index"], e["operation"], e["timestamp"], e["recipe"], e["comment"], None if e["step"] is None else Step(e["step"]["call"], kwargs_from_plain(e["step"]["call"], e["step"]["kwargs"]), e["step"]["comment"])) for e in history)),
        correlation={(a, b): r for a, b, r in meta["correlation"]},
        axes=axes_from_plain(meta["axes"]), mode=meta["mode"], coords=meta["coords"], dense=meta["dense"],
        roots={v: frozenset(r) for v, r in meta["roots"].items()}, interpolated=frozenset(meta["interpolated"]), transferred=frozenset(meta["transferred"]),
    )
    grid = replace(grid, cells=grid.cells.select(*map(col, grid.dim_names), *map(col, grid.columns())))
    if content_digest(grid) != seal["members"]["cells"]:
        raise IntegrityError("cells", "do not match their digest", "The archive was changed after it was written")
    if state_hash(grid) != seal["state_hash"]:
        raise IntegrityError(root, "the state does not match its digest", "The archive was changed after it was written")
    return grid
