"""What a grid holds: candidates for dimensions, extremes, gaps and sources."""

from __future__ import annotations

import csv
import json
import math
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import functions as F

from ..errors import ExportError
from ..functions import numeric as n
from ..grid import Grid, col


def inspect_grid(grid: Grid, threshold: int) -> dict:
    """Print and return which columns look like dimensions, and how full their grid would be."""
    names = list(grid.vars)
    ok = {v: F.when(n.finite(col(v)), col(v)) for v in names}
    row = grid.cells.agg(F.count(F.lit(1)).alias("rows"), *[f(ok[v]).alias(f"{p}{i}") for i, v in enumerate(names) for p, f in (("u", F.count_distinct), ("n", F.count))]).first()
    kinds = {}
    for i, v in enumerate(names):
        unique, finite = row[f"u{i}"], row[f"n{i}"]
        kinds[v] = "candidate" if unique <= threshold and unique < finite else "variable" if unique == finite else "ambiguous"
    cells = math.prod(row[f"u{i}"] for i, v in enumerate(names) if kinds[v] == "candidate")
    coverage = row["rows"] / cells if cells else 0.0
    report = {"rows": row["rows"], "columns": {v: {"kind": kinds[v], "unique": row[f"u{i}"], "finite": row[f"n{i}"]} for i, v in enumerate(names)}, "coverage": coverage}
    for v, x in report["columns"].items():
        print(f"{v}: {x['kind']} ({x['unique']} different of {x['finite']} finite values)")
    print(f"grid of the candidates: {cells} cells, coverage {coverage:.1%}")
    return report


@dataclass(frozen=True)
class Summary:
    shape: tuple[int, ...]
    variables: dict[str, dict[str, float]]
    bytes: int
    mode: str
    operations: int


def summary(grid: Grid) -> Summary:
    """Extremes and mean of the finite cells of every variable, from one aggregate."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(grid.vars):
        known = F.when(n.finite(col(v)), col(v))
        aggregates += [n.or_nan(f(known)).alias(f"{k}{i}") for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    row = grid.cells.agg(*aggregates).first()
    shape = tuple(row["rows"] if d.coords is None else len(d) for d in grid.dimensions)
    variables = {v: {k: row[f"{k}{i}"] for k in ("min", "max", "mean")} for i, v in enumerate(grid.vars)}
    out = Summary(shape, variables, row["rows"] * 8 * (len(grid.columns()) + len(grid.dim_names)), grid.mode, len(grid.history))
    print(f"shape {shape}, mode {out.mode}, {out.operations} operations, about {out.bytes} bytes")
    for v, x in variables.items():
        print(f"  {v}: min {x['min']:g}, max {x['max']:g}, mean {x['mean']:g}")
    return out


@dataclass(frozen=True)
class Diagnostics:
    total: int
    variables: dict[str, dict[str, float]]
    warnings: list[str] = field(default_factory=list)

    def to_csv(self, path) -> Path:
        path = Path(path)
        with path.open("w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out)
            writer.writerow(["variable", "total", "missing", "infinite", "coverage"])
            for v, x in self.variables.items():
                writer.writerow([v, self.total, x["missing"], x["infinite"], x["coverage"]])
        return path

    def to_json(self, path) -> Path:
        path = Path(path)
        path.write_text(json.dumps(asdict(self)), encoding="utf-8")
        return path


def missing_counts(grid: Grid):
    """One row: populated and infinite cells of every variable."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, v in enumerate(grid.vars):
        aggregates += [F.count(F.when(~F.isnan(col(v)), 1)).alias(f"p{i}"), F.count(F.when(F.abs(col(v)) == n.INF, 1)).alias(f"i{i}")]
    return grid.cells.agg(*aggregates)


def diagnostics(grid: Grid, log=None) -> Diagnostics:
    """Missing and infinite cells; absent rows are missing cells of every variable."""
    row = missing_counts(grid).first()
    total = grid.expected_cells()
    total = row["rows"] if total is None else total
    variables, notes = {}, []
    for i, v in enumerate(grid.vars):
        missing, infinite = total - row[f"p{i}"], row[f"i{i}"]
        coverage = 1.0 - missing / total if total else 0.0
        variables[v] = {"missing": missing, "infinite": infinite, "coverage": coverage}
        if total and missing + infinite == total:
            notes.append(f"{v} has no finite value")
        elif coverage < 0.25:
            notes.append(f"{v} covers {coverage:.1%} of the grid")
        if infinite:
            notes.append(f"{v} has {infinite} infinite values")
    notes += [f"dimension {d.name} has a single point" for d in grid.dimensions if d.coords is not None and len(d) == 1]
    out = Diagnostics(total, variables, notes)
    if log is not None:
        (out.to_json if str(log).lower().endswith(".json") else out.to_csv)(log)
    return out


def manifest(grid: Grid, path) -> Path:
    """Which file gave which coordinates, as CSV or JSON."""
    p = grid.provenance
    if not p.sources:
        raise ExportError("manifest", "the grid comes from memory", "Only files have a manifest")
    path = Path(path)
    of = {f: dict(c) for f, c in p.coordinates}
    keys = sorted({k for c in of.values() for k in c})
    if path.suffix.lower() == ".json":
        path.write_text(json.dumps({"source_hash": p.source_hash, "files": [{"file": s, "coordinates": of.get(s, {})} for s in p.sources]}), encoding="utf-8")
    elif path.suffix.lower() == ".csv":
        with path.open("w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out)
            writer.writerow(["file", *keys])
            for s in p.sources:
                writer.writerow([s, *[of.get(s, {}).get(k, "") for k in keys]])
    else:
        raise ExportError(str(path), "is neither .csv nor .json", "Choose one of them")
    return path
