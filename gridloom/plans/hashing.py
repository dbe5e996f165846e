"""Digests of grid contents that do not depend on the order or partitioning of rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bits(c: Column, kind: str) -> Column:
    """A value as text that tells -0.0 from 0.0 and has one NaN."""
    if kind == "double":
        zero = F.when(F.pow(c, F.lit(-1.0)) < 0, F.lit("-0.0")).otherwise(F.lit("0.0"))
        return F.when(F.isnan(c), F.lit("NaN")).when(c == 0, zero).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit("\0"))


def content_digest(grid) -> str:
    """SHA-256 over the count and two independent sums of row hashes of the dense content."""
    from ..grid import col

    kinds = dict(grid.cells.dtypes)
    named = [*sorted(grid.dim_names), *sorted(grid.columns())]
    # A row of NaN says no more than a missing row, unless it carries tags.
    values = [v for v in grid.vars]
    row = F.sha2(F.concat_ws("\x1f", *[_bits(col(c), kinds[c]) for c in named]), 256) if named else F.lit("0" * 64)
    some = F.lit(grid.is_datapoint)
    for v in values:
        some = some | ~F.isnan(col(v)) | (grid.tag_column(v) != grid.vars[v].absent_tag)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    found = grid.cells.where(some).agg(F.count(F.lit(1)).alias("rows"), *[part(at).alias(f"s{at}") for at in (1, 16, 31, 46)]).first()
    return hashlib.sha256("|".join(str(x) for x in found).encode()).hexdigest()


def metadata_of(grid) -> dict:
    """Everything but the cells, as plain values."""
    from ..operators.geometry import axes_to_plain

    return {
        "dims": [{"name": d.name, "coords": None if d.coords is None else list(d.coords), "unit": d.unit, "description": d.description} for d in grid.dimensions],
        "vars": {
            v: {"unit": s.unit, "description": s.description, "long_name": s.long_name, "sys": s.sys, "rand": s.rand, "tagged": s.tagged, "absent_tag": s.absent_tag, "fitted": s.fitted}
            for v, s in sorted(grid.vars.items())
        },
        "order": list(grid.vars),
        "correlation": [[a, b, r] for (a, b), r in sorted(grid.correlation.items())],
        "axes": axes_to_plain(grid.axes),
        "mode": grid.mode,
        "coords": grid.coords,
        "dense": grid.dense,
        "roots": {v: sorted(r) for v, r in sorted(grid.roots.items())},
        "interpolated": sorted(grid.interpolated),
        "transferred": sorted(grid.transferred),
    }


def state_hash(grid) -> str:
    """Contents, metadata, operations and comments; not times, users, paths or versions."""
    meta = {k: v for k, v in metadata_of(grid).items() if k not in ("dense", "roots")}
    done = [[e.operation, e.comment] for e in grid.history]
    return hashlib.sha256(json.dumps([content_digest(grid), meta, done], sort_keys=True, default=str).encode()).hexdigest()
