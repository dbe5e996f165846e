"""Substring deduplication: paragraphs that recur, nearly or exactly, are kept once.

A paragraph is a line of at least ``min_words`` words. Its 5-word shingles are banded by
MinHash, with as many bands as give the wanted recall at the threshold; paragraphs that
collide are verified by exact Jaccard, and of every connected component the occurrence with
the smallest (doc_id, paragraph number) stays, all others are removed.

A passage inside a longer paragraph, or one whose lines break elsewhere, leaves two paragraphs
far below any threshold, so documents are compared once more by windows of ``window`` words,
selected by winnowing over the words of the whole text, whatever its lines. Documents that
share ``window + reach - 1`` words in a row (39 by default) share a selected window. Windows
that touch a removed paragraph are out; the others that a document shares are cut out, joined
where they touch, except in the document with the smallest doc_id that has them. So no two
documents are left with so long a run of words that stood in a row in the input.

Defined results: lines of fewer words are only compared by windows; a null text is the empty
text; documents are told apart by doc_id and text, so rows without an id or with a repeated
one are documents of their own, those without an id last; rows that repeat both are one
document and lose the same; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .similarity import line_words, node_ids, rep_of, sets_of, signature_keys, verified_links, winnowed, with_row_key
from .staging import Stage
from .vectext import chunks, codes_of, word_spans


def band_count(rows: int, threshold: float, recall: float) -> int:
    """Bands of ``rows`` minima with which a pair at the threshold collides with ``recall``."""
    return math.ceil(math.log(1.0 - recall) / math.log(1.0 - threshold**rows))


def _paragraphs(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and line numbers of the lines that are long enough."""
    found = [(i, k) for i, text in enumerate(texts) for k, line in enumerate(text.split("\n")) if len(line.split()) >= min_words]
    return np.array([x[0] for x in found], dtype=np.int64), np.array([x[1] for x in found], dtype=np.int64)


def _line_sets(texts: list[str], owner: np.ndarray, number: np.ndarray, shingle: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Shingle sets of the given lines; and all words, their bounds by text and their lines."""
    words, bounds, line = line_words(texts)
    wide = np.int64(1 << 32)
    at = np.repeat(np.arange(len(texts)), np.diff(bounds)) * wide + line
    place = owner * wide + number
    return sets_of(words, np.searchsorted(at, place), np.searchsorted(at, place, side="right"), shingle), words, bounds, line


def _lists(values: np.ndarray, of: np.ndarray, many: int) -> pa.ListArray:
    """The values of each owner 0 to many - 1; ``of`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(many + 1)).astype(np.int32)), pa.array(values))


def _sign(bands: int, rows: int, shingle: int, min_words: int, window: int, reach: int):
    """A row for each paragraph, and one without ``par`` for the windows of each document that has any."""
    lists = [pa.field(c, pa.list_(t)) for c, t in (("keys", pa.int64()), ("windows", pa.int64()), ("from", pa.int32()), ("to", pa.int32()))]
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("par", pa.int32()), ("node", pa.int64()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0, 500_000):
            owner, number = _paragraphs(texts, min_words)
            sets, words, bounds, line = _line_sets(texts, owner, number, shingle)
            keep = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
            sets = [sets[i] for i in keep.tolist()]
            keys = signature_keys(sets, bands, rows)
            of = pa.array(owner[keep])
            none = lambda f: pa.nulls(len(keep), f.type)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(of),
                    batch.column(2).take(of),
                    pa.array(number[keep].astype(np.int32)),
                    pa.array(node_ids(sets), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(keys.ravel())),
                    *[none(f) for f in lists[1:]],
                ],
                schema=schema,
            )
            where, hashes = winnowed(words, bounds, window, reach)
            text = np.searchsorted(bounds, where, side="right") - 1
            some = pa.array(np.unique(text))
            columns = [_lists(v, text, len(texts)).take(some) for v in (hashes.view(np.int64), line[where].astype(np.int32), line[where + window - 1].astype(np.int32))]
            empty = [pa.nulls(len(some), f.type) for f in (schema.field("par"), schema.field("node"), lists[0])]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(some), batch.column(2).take(some), *empty, *columns], schema=schema)

    return run


def _wanted_sets(shingle: int, min_words: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0):
            owner, number = _paragraphs(texts, min_words)
            wanted = [set(w) for w in batch.column(1).to_pylist()]
            sets = _line_sets(texts, owner, number, shingle)[0]
            rows = {n: s.tobytes() for n, s, o in zip(node_ids(sets), sets, owner.tolist(), strict=True) if n in wanted[o]}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], schema=schema)

    return run


def touching(gone: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a line of ``gone``, which is sorted, lies between each first and last line."""
    return np.searchsorted(gone, first) < np.searchsorted(gone, last, side="right")


def _standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each document, without those that touch one of its removed lines."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("hash", pa.int64())])
    for batch in batches:
        places = batch.column(2)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
        flat = places.flatten()
        first, last = flat.field("from").to_numpy(), flat.field("to").to_numpy()
        stands = np.ones(len(owner), dtype=bool)
        edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        for i, gone in enumerate(batch.column(3).to_pylist()):
            if gone:
                at = slice(edges[i], edges[i + 1])
                stands[at] = ~touching(np.sort(np.array(gone)), first[at], last[at])
        of = pa.array(owner[stands])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), flat.field("hash").filter(pa.array(stands))], schema=schema)


def cut_text(text: str, drop: Collection[int], shared: Collection[int], window: int, reach: int) -> tuple[str, int]:
    """The text without the dropped lines and the words of shared windows; and how many runs of words went.

    A run goes from its first word to the next word that stays, or to the end of its last
    line; what lies before the first word of a line stays with the line. Lines that
    lose all they had are left out.
    """
    lines = text.split("\n")
    spans: list[tuple[int, int]] = []
    if shared:
        words, bounds, line = line_words([text])
        where, hashes = winnowed(words, bounds, window, reach)
        hit = np.isin(hashes.view(np.int64), np.fromiter(shared, dtype=np.int64, count=len(shared)))
        hit &= ~touching(np.sort(np.fromiter(drop, dtype=np.int64, count=len(drop))), line[where], line[where + window - 1])
        covered: list[list[int]] = []
        for place in where[hit].tolist():
            if covered and place <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], place + window)
            else:
                covered.append([place, place + window])
        if covered:
            codes = codes_of([text])[0]
            begin, end = word_spans(codes)
            breaks = np.flatnonzero(codes == 10)
            for lo, hi in covered:
                stop = np.searchsorted(breaks, end[hi - 1])
                line_end = int(breaks[stop]) if stop < len(breaks) else len(codes) - 1
                spans.append((int(begin[lo]) - 1, min(int(begin[hi]), line_end) - 1 if hi < len(begin) else line_end - 1))
    kept, at, k = [], 0, 0
    for number, x in enumerate(lines):
        stop = at + len(x)
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        if number not in drop:
            parts, lo, j = [], at, k
            while j < len(spans) and spans[j][0] < stop:
                parts.append(text[lo : max(lo, spans[j][0])])
                lo = min(stop, max(lo, spans[j][1]))
                j += 1
            if j > k:
                x = ("".join(parts) + text[lo:stop]).strip()
            if j == k or x:
                kept.append(x)
        at = stop + 1
    return "\n".join(kept), len(spans)


def _strip(min_words: int, window: int, reach: int):
    """Remove the listed paragraphs and shared windows of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int32()), ("n_removed", pa.int32()), ("kept_in", pa.list_(pa.int64())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0):
            paragraphs = np.bincount(_paragraphs(texts, min_words)[0], minlength=len(texts))
            removed, kept_in, left = [], [], []
            for text, gone in zip(texts, batch.column(2).to_pylist(), strict=True):
                drop = {g["par"] for g in gone or () if g["par"] is not None}
                shared = {g["hash"] for g in gone or () if g["par"] is None}
                new, cuts = cut_text(text, drop, shared, window, reach) if gone else (text, 0)
                removed.append(len(drop) + cuts)
                kept_in.append(sorted({g["keep"] for g in gone or () if g["keep"] is not None}))
                left.append(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(paragraphs.astype(np.int32)), pa.array(removed, pa.int32()), pa.array(kept_in, schema.field("kept_in").type), pa.array(left, pa.string())],
                schema=schema,
            )

    return run


def dedup_paragraphs(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    rows: int = 3,
    recall: float = 0.995,
    min_words: int = 8,
    window: int = 20,
    reach: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_removed, kept_in (doc_ids), text.

    ``n_removed`` counts the paragraphs and the passages inside of paragraphs; ``kept_in`` lists the documents that keep the first occurrence of what was removed here.
    """
    stage = Stage(docs.sparkSession, "paragraph-dedup")
    d = with_row_key(docs, id_col, text_col)
    signed = stage.table(
        d.mapInArrow(
            _sign(band_count(rows, threshold, recall), rows, shingle, min_words, window, reach),
            "id long, row long, par int, node long, keys array<long>, windows array<long>, `from` array<int>, `to` array<int>",
        )
    )
    paragraphs = signed.where("par is not null")
    nodes = stage.table(paragraphs.groupBy("node").agg(F.min(rep_of()).alias("rep"), F.count(F.lit(1)).alias("size"), F.first("keys").alias("keys")))

    def payload(need: DataFrame) -> DataFrame:
        chosen = stage.table(need.groupBy("rep").agg(F.collect_set("node").alias("wanted")))
        joined = d.join(chosen.hint("merge"), (d["row"] == chosen["rep.row"]) & d["id"].eqNullSafe(chosen["rep.id"])).select("text", "wanted")
        return joined.mapInArrow(_wanted_sets(shingle, min_words), "node long, shingles binary")

    links = verified_links(nodes, payload, threshold, stage)
    roots = stage.table(connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), stage))
    # Only paragraphs with a copy or a link can go; the rest needs no shuffle.
    shared = nodes.select("node", "size").join(roots, "node", "left").where("size > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"))
    places = paragraphs.select("id", "row", "par", "node").join(shared, "node").select("root", F.struct(rep_of().alias("of"), F.col("par")).alias("place"))
    first = stage.table(places.groupBy("root").agg(F.min("place").alias("first")), release=True)
    removed = stage.table(places.join(first, "root").where("place <> first").select("place.of.id", "place.of.row", "place.par", F.col("first.of.id").alias("keep")))
    # Windows that several documents hold, by their rows, which differ between any two documents.
    windows = signed.where("par is null").select("id", "row", F.explode(F.arrays_zip("windows", "from", "to")).alias("w"))
    # The two line numbers travel as one number.
    lines_of = F.shiftleft(F.col("w.from").cast("long"), 32).bitwiseOR(F.col("w.to").cast("long"))
    windows = windows.select("id", "row", F.col("w.windows").alias("hash"), lines_of.alias("lines"))
    held = windows.groupBy("hash").agg(F.min("row").alias("least"), F.max("row").alias("most"))
    often = stage.table(held.where("least <> most").select("hash"), release=True)
    hits = windows.join(often.hint("merge"), "hash").select(
        "id", "row", F.struct("hash", F.shiftright("lines", 32).cast("int").alias("from"), F.col("lines").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("to")).alias("place")
    )
    lines = stage.table(removed.groupBy(F.col("id").alias("of_id"), F.col("row").alias("of_row")).agg(F.collect_set("par").alias("gone")))
    of_doc = hits.groupBy("id", "row").agg(F.collect_list("place").alias("places"))
    beside = of_doc.join(lines.hint("merge"), (of_doc["row"] == lines["of_row"]) & of_doc["id"].eqNullSafe(lines["of_id"]), "left")
    standing = stage.table(beside.select("id", "row", "places", "gone").mapInArrow(_standing, "id long, row long, hash long").distinct(), release=True)
    keepers = stage.table(standing.groupBy("hash").agg(F.min(rep_of()).alias("keep"), F.max(rep_of()).alias("other")).where("keep <> other").select("hash", "keep"))
    own = (F.col("row") == F.col("keep.row")) & F.col("id").eqNullSafe(F.col("keep.id"))
    cut = standing.join(keepers.hint("merge"), "hash").where(~own).select("id", "row", F.lit(None).cast("int").alias("par"), F.col("keep.id").alias("keep"), "hash")
    lost = removed.withColumn("hash", F.lit(None).cast("long")).unionByName(cut)
    gone = lost.groupBy(F.col("id").alias("gone_id"), F.col("row").alias("gone_row")).agg(F.collect_set(F.struct("par", "keep", "hash")).alias("gone"))
    marked = d.join(gone.hint("merge"), (d["row"] == gone["gone_row"]) & d["id"].eqNullSafe(gone["gone_id"]), "left").select("text", "id", "gone")
    return marked.mapInArrow(_strip(min_words, window, reach), "doc_id long, n_paragraphs int, n_removed int, kept_in array<long>, text string")
