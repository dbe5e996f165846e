"""Exact deduplication with a distributed cuckoo-filter index.

Texts are equal when they are identical after lower-casing A-Z. Their content address is
the SHA-256 of the normalised text. Each task keeps a cuckoo filter of the live digests it
has met: a hit on a 16-bit fingerprint is verified against the whole digest kept in the same
bucket, a newer row of an equal text deletes the old live entry and inserts its own, and an
overflow rebuilds the filter at twice the size from the stored keys. Tasks first index their
own partition (so a group of copies leaves one row per task), then the digests are dealt by
digest and merged, one digest prefix at a time, by the same index.

Defined results: a null text counts as the empty text; a null doc_id loses against any other;
a row that repeats both doc_id and text is listed as often as it occurs, the first of them
kept; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SLOTS = 4
_MAX_KICKS = 200


class CuckooIndex:
    """Cuckoo filter with bucketed content: fingerprints decide, stored digests verify."""

    def __init__(self, buckets: int = 1024) -> None:
        self.resizes = 0
        self._build(buckets)

    def _build(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[tuple]] = [[] for _ in range(buckets)]
        self.live = 0

    @staticmethod
    def _fingerprint(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _places(self, digest: bytes, fingerprint: int) -> tuple[int, int]:
        first = int.from_bytes(digest[:8], "little") & self.mask
        return first, self._other(first, fingerprint)

    def _other(self, place: int, fingerprint: int) -> int:
        return (place ^ (fingerprint * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> tuple | None:
        """The payload of a live digest; fingerprint hits are verified on the whole digest."""
        fp = self._fingerprint(digest)
        for place in self._places(digest, fp):
            if fp in self.prints[place]:
                for key, payload in self.content[place]:
                    if key == digest:
                        return payload
        return None

    def delete(self, digest: bytes) -> bool:
        fp = self._fingerprint(digest)
        for place in self._places(digest, fp):
            for slot, (key, _) in enumerate(self.content[place]):
                if key == digest:
                    del self.content[place][slot], self.prints[place][slot]
                    self.live -= 1
                    return True
        return False

    def insert(self, digest: bytes, payload: tuple) -> None:
        """Insert a digest that is not live; grow from the stored keys on overflow."""
        entry = (digest, payload)
        fp = self._fingerprint(digest)
        first, second = self._places(digest, fp)
        for place in (first, second):
            if len(self.prints[place]) < _SLOTS:
                self.prints[place].append(fp)
                self.content[place].append(entry)
                self.live += 1
                return
        place = second
        for kick in range(_MAX_KICKS):
            slot = kick % _SLOTS
            self.prints[place][slot], fp = fp, self.prints[place][slot]
            self.content[place][slot], entry = entry, self.content[place][slot]
            place = self._other(place, fp)
            if len(self.prints[place]) < _SLOTS:
                self.prints[place].append(fp)
                self.content[place].append(entry)
                self.live += 1
                return
        kept = [*self.items(), entry]
        self.resizes += 1
        self._build((self.mask + 1) * 2)
        for key, value in kept:
            self.insert(key, value)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        for bucket in self.content:
            yield from bucket

    def add(self, digest: bytes, doc_id: int | None, rows: int) -> None:
        """Count ``rows`` more rows of a text; the largest doc_id becomes its live row."""
        held = self.find(digest)
        if held is None:
            self.insert(digest, (doc_id, rows))
            return
        self.delete(digest)
        best = held[0] if doc_id is None or (held[0] is not None and held[0] >= doc_id) else doc_id
        self.insert(digest, (best, held[1] + rows))


_GROUP_SCHEMA = "digest binary, keep_id long, group_size long"
_GROUP_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _flush(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    items = list(index.items())
    for lo in range(0, len(items), 50_000):
        part = items[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in part], pa.binary()),
                pa.array([v[0] for _, v in part], pa.int64()),
                pa.array([v[1] for _, v in part], pa.int64()),
            ],
            schema=_GROUP_ARROW,
        )


def _index_partition(max_live: int):
    """Index the rows of a task; beyond ``max_live`` digests what is known goes on to the merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, doc_id, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                index.add(digest, doc_id, rows)
            if index.live >= max_live:
                yield from _flush(index)
                index = CuckooIndex()
        yield from _flush(index)

    return run


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by digest, so one index for each two-byte prefix is enough."""
    index, prefix = CuckooIndex(), None
    for batch in batches:
        for digest, keep_id, rows in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if digest[:2] != prefix:
                if index.live >= 5_000:
                    yield from _flush(index)
                    index = CuckooIndex()
                prefix = digest[:2]
            index.add(digest, keep_id, rows)
    yield from _flush(index)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_live: int = 200_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    normal = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _UPPER.lower())
    stage = Stage(docs.sparkSession, "exact-dedup")
    counted = (
        docs.select(F.unhex(F.sha2(F.encode(normal, "UTF-8"), 256)).alias("digest"), F.col(id_col).cast("long").alias("doc_id"))
        .groupBy("digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # Written, so that every text is read and hashed once.
    rows = stage.table(counted)
    groups = (
        rows.select("digest", "doc_id", "rows")
        .mapInArrow(_index_partition(max_live), _GROUP_SCHEMA)
        .repartition("digest")
        .sortWithinPartitions("digest")
        .mapInArrow(_merge_sorted, _GROUP_SCHEMA)
    )
    return (
        rows.join(groups, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
