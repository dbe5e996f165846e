"""Grids to files and to memory."""

from __future__ import annotations

import csv
import io
import json
import math
import re
import warnings
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from ..errors import ExportError
from ..grid import Grid, col, u_rand, u_sys
from . import files


def _allow(grid: Grid, allow_draft: bool, in_memory: bool = False) -> bool:
    """Whether the grid is a draft, which must be asked for."""
    if grid.mode != "draft":
        return False
    if in_memory:
        warnings.warn("this grid is a draft: its history is incomplete", UserWarning, stacklevel=4)
    elif not allow_draft:
        raise ExportError("draft", "drafts are not exported", "Promote the grid, or pass allow_draft=True")
    return True


def ordered(grid: Grid):
    """All cells, missing ones too, in grid order."""
    dense = grid.densified()
    order = [dense.ordinal(d) for d in dense.dim_names]
    cells = dense.cells.select(*map(col, dense.dim_names), *map(col, dense.columns()))
    return cells.orderBy(*order) if order else cells


def _banner(grid: Grid, draft: bool) -> list[str]:
    p = grid.provenance
    lines = ["# DRAFT: not for release"] if draft else []
    lines += [f"# created by {p.user} at {p.created_at}, version {p.version}, mode {grid.mode}" + (f", tag {p.tag}" if p.tag else "")]
    if p.sources:
        lines.append("# sources: " + ", ".join(Path(s).name for s in p.sources) + f" (sha256 {p.source_hash})")
    for e in grid.history:
        lines.append(f"# {e.index}. {e.operation}" + (f"  -- {e.comment}" if e.comment else ""))
    return [x.replace("\r", " ").replace("\n", " ") for x in lines]


def _text(value) -> str:
    if isinstance(value, str):
        return value
    return "" if math.isnan(value) else repr(float(value))


def _write_csv(path: Path, banner: list[str], names: list[str], rows: Iterator) -> None:
    beside = path.with_name(path.name + ".tmp")
    with beside.open("w", newline="", encoding="utf-8") as out:
        for line in banner:
            out.write(line + "\n")
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(names)
        for row in rows:
            writer.writerow([_text(row[x]) for x in names])
    beside.replace(path)


def _folder(grid: Grid, path, draft: bool, split_by: str | None, form: str) -> str:
    """A folder that the tasks write: all cells in grid order, a part file each, and the banner beside them.

    Parts hold ranges of the grid's order, so their names sort as the cells do; ``split_by``
    makes a subfolder for each coordinate.
    """
    if split_by is not None:
        grid.dim(split_by)
    cells = ordered(grid).select(*map(col, grid.dim_names), *[F.when(~F.isnan(col(v)), col(v)).alias(v) for v in grid.vars])
    writer = cells.write.mode("error")
    if split_by is not None:
        writer = writer.partitionBy(split_by)
    if form == "csv":
        writer.option("header", True).option("emptyValue", "").csv(str(path))
    else:
        writer.option("ignoreNullFields", False).json(str(path))
    files.write_text(grid.spark, f"{str(path).rstrip('/')}/_banner.txt", "\n".join(_banner(grid, draft)) + "\n")
    return str(path)


def to_csv(grid: Grid, path, split_by: str | None, allow_draft: bool, distributed: bool = False):
    """One dense table, rows streamed to the driver a partition at a time; or one per coordinate.

    With ``distributed`` the tasks write a folder of part files instead, on any path Spark writes.
    """
    draft = _allow(grid, allow_draft)
    if distributed:
        return _folder(grid, path, draft, split_by, "csv")
    path = Path(path)
    names = [*grid.dim_names, *grid.vars]
    if split_by is None:
        _write_csv(path, _banner(grid, draft), names, ordered(grid).toLocalIterator())
        return path
    d = grid.dim(split_by)
    stems = {}
    for c in d.coords:
        label = re.sub(r"[^\w\-+]", "_", (c if isinstance(c, str) else f"{c:g}").replace(".", "p"))
        stem = f"{path.stem}_{split_by}_{label}{path.suffix}"
        if stem in stems:
            raise ExportError(stem, f"coordinates {stems[stem]!r} and {c!r} of {split_by} would write one file", "Rename or select coordinates")
        stems[stem] = c
    made = []
    for stem, c in stems.items():
        part = grid.select({split_by: c})
        _write_csv(path.with_name(stem), _banner(grid, draft), names, ordered(part).toLocalIterator())
        made.append(path.with_name(stem))
    return made


def to_parquet(grid: Grid, path: str, allow_draft: bool) -> str:
    """Cells with all mirrors, written by the tasks that hold them."""
    _allow(grid, allow_draft)
    grid.cells.write.mode("error").parquet(str(path))
    return str(path)


def to_pandas(grid: Grid, allow_draft: bool):
    """A flat table of dimensions and variables."""
    if not allow_draft:
        _allow(grid, allow_draft, in_memory=True)
    return ordered(grid).select(*map(col, grid.dim_names), *map(col, grid.vars)).toPandas()


def _arrays(grid: Grid, columns: list[str]) -> dict[str, np.ndarray]:
    pdf = ordered(grid).select(*map(col, columns)).toPandas()
    shape = (len(pdf),) if grid.is_datapoint else grid.shape
    return {c: pdf[c].to_numpy(dtype=float).reshape(shape) for c in columns}


def to_numpy(grid: Grid, return_dims: bool, copy: bool, allow_draft: bool):
    """Variables as arrays shaped by the dimensions."""
    if not allow_draft:
        _allow(grid, allow_draft, in_memory=True)
    out = _arrays(grid, list(grid.vars))
    if not copy:
        for a in out.values():
            a.setflags(write=False)
    if return_dims:
        return out, {d.name: np.array(d.coords) for d in grid.dimensions if d.coords is not None}
    return out


def _json(values: np.ndarray):
    if values.ndim > 1:
        return [_json(v) for v in values]
    return [None if math.isnan(x) else x if math.isfinite(x) else ("Infinity" if x > 0 else "-Infinity") for x in values.tolist()]


def to_json(grid: Grid, path, allow_draft: bool, distributed: bool = False) -> Path | str:
    """Provenance, history, dimensions, variables and uncertainties as nested lists.

    With ``distributed`` the tasks write a folder of JSON lines instead, one per cell.
    """
    draft = _allow(grid, allow_draft)
    if distributed:
        return _folder(grid, path, draft, None, "json")
    path = Path(path)
    mirrors = [c for v, s in grid.vars.items() for c, has in ((u_sys(v), s.sys), (u_rand(v), s.rand)) if has]
    arrays = _arrays(grid, [*grid.vars, *mirrors])
    p = grid.provenance
    body: dict = {"draft": True} if draft else {}
    body |= {
        "provenance": {"version": p.version, "user": p.user, "created_at": p.created_at, "sources": list(p.sources), "source_hash": p.source_hash, "mode": grid.mode, "tag": p.tag},
        "history": [{"index": e.index, "operation": e.operation, "timestamp": e.timestamp, "hash": e.recipe, "comment": e.comment} for e in grid.history],
        "dimensions": {d.name: {"coords": None if d.coords is None else list(d.coords), "unit": d.unit, "description": d.description} for d in grid.dimensions},
        "variables": {v: {"values": _json(arrays[v]), "unit": s.unit, "description": s.description, "long_name": s.long_name} for v, s in grid.vars.items()},
    }
    if mirrors:
        found = {}
        for v, s in grid.vars.items():
            if s.uncertain:
                parts = {k: arrays[c] for k, c, has in (("systematic", u_sys(v), s.sys), ("random", u_rand(v), s.rand)) if has}
                combined = np.sqrt(sum(np.where(np.isnan(x), np.nan, x) ** 2 for x in parts.values()))
                found[v] = {k: _json(x) for k, x in parts.items()} | {"combined": _json(combined)}
        body["uncertainty"] = {"rule": "combined is the root of the sum of squares of the systematic and random components", "variables": found}
    text = io.StringIO()
    json.dump(body, text, allow_nan=False, default=str)
    beside = path.with_name(path.name + ".tmp")
    beside.write_text(text.getvalue(), encoding="utf-8")
    beside.replace(path)
    return path
