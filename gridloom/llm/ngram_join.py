"""N-gram Jaccard join of all documents by a MinHash LSH forest.

Documents with equal sets of word shingles are one node from the start; nodes are known by a
64-bit hash of the set. Their signatures stand in the prefix tries of ``forest``, whose matched
prefixes are shortened, document by document, until a pair at the threshold meets with the
target recall; what shares a bucket is verified exactly on its shingle sets.

A document's links are the other documents, copies included, at the threshold or above; its
class is the connected component of the links, named by its smallest doc_id.

Defined results: a text without words (null or empty, too) is similar to nothing, is a class
of its own and has no links; a text of fewer than ``shingle`` words is one shingle; repeated
rows are copies of each other; rows without an id, or with a repeated one, are told apart by
their texts; a null doc_id never names a class that has another; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .forest import forest_buckets, signatures
from .similarity import node_ids, rep_of, shingle_sets, verified_links, with_row_key
from .staging import Stage
from .vectext import chunks


def _sign(trees: int, longest: int, shingle: int):
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("words", pa.int32()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0):
            sets = shingle_sets(texts, shingle)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    pa.array(node_ids(sets), pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(signatures(sets, trees, longest), pa.binary()),
                ],
                schema=schema,
            )

    return run


def _wanted_sets(shingle: int):
    """(node, shingles) of the wanted nodes of each joined document."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0):
            sets = shingle_sets(texts, shingle)
            rows = {n: s.tobytes() for n, s, want in zip(node_ids(sets), sets, batch.column(1).to_pylist(), strict=True) if n == want}
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], schema=schema)

    return run


def _classes(docs: DataFrame, threshold: float, shingle: int, trees: int, shortest: int, longest: int, recall: float, id_col: str, text_col: str, stage: Stage) -> DataFrame:
    """One row per document: id, row, first (the document that names its class), class_size, n_links, words."""
    d = with_row_key(docs, id_col, text_col)
    signed = stage.table(d.mapInArrow(_sign(trees, longest, shingle), "id long, row long, node long, words int, signature binary"))
    some = signed.where("words > 0")
    nodes = stage.table(some.groupBy("node").agg(F.min(rep_of()).alias("rep"), F.count(F.lit(1)).alias("size"), F.first("signature").alias("signature")))
    keys = forest_buckets(nodes.select("node", "signature"), trees, shortest, longest, threshold, recall, stage)
    near = stage.table(nodes.select("node", "rep", "size").join(keys.hint("merge"), "node"))

    def payload(need: DataFrame) -> DataFrame:
        # What is to verify grows with the corpus, so the join is planned for that at every size.
        chosen = stage.table(need).select("node", "rep")
        at = (d["row"] == chosen["rep.row"]) & d["id"].eqNullSafe(chosen["rep.id"])
        return d.join(chosen.hint("merge"), at).select("text", "node").mapInArrow(_wanted_sets(shingle), "node long, shingles binary")

    links = verified_links(near, payload, threshold, stage)
    per_node = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = stage.table(connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v")), stage))
    named = (
        nodes.select("node", "rep", "size")
        .join(roots, "node", "left")
        .join(per_node, "node", "left")
        .select("node", "size", "rep", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    classes = stage.table(named.groupBy("root").agg(F.min("rep").alias("first"), F.sum("size").alias("class_size")))
    of_node = stage.table(named.join(classes, "root").select("node", "first", "class_size", (F.col("links") + F.col("size") - 1).alias("n_links")))
    lone = signed.where("words = 0").select("id", "row", rep_of().alias("first"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), "words")
    return some.select("id", "row", "node", "words").join(of_node, "node").select("id", "row", "first", "class_size", "n_links", "words").unionByName(lone)


def similar_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    trees: int = 12,
    shortest: int = 3,
    longest: int = 5,
    recall: float = 0.998,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_links."""
    stage = Stage(docs.sparkSession, "ngram-join")
    classes = _classes(docs, threshold, shingle, trees, shortest, longest, recall, id_col, text_col, stage)
    return classes.select(F.col("id").alias("doc_id"), F.col("first.id").alias("class_id"), "class_size", "n_links")


def keep_one_of_each(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    trees: int = 12,
    shortest: int = 3,
    longest: int = 5,
    recall: float = 0.998,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The documents, all their columns, but those whose class keeps another one.

    The one with the smallest doc_id stays. Of rows that repeat both id and text one stays,
    told by a hash of all columns; rows without words all stay.
    """
    stage = Stage(docs.sparkSession, "keep-one")
    classes = _classes(docs, threshold, shingle, trees, shortest, longest, recall, id_col, text_col, stage).where("words > 0")
    of_doc = stage.table(classes.groupBy("id", "row").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("rows")))
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("row") == F.col("first.row"))
    gone = stage.table(of_doc.where(~own | (F.col("rows") > 1)).select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row"), own.alias("repeated")))
    doc_id = F.col(id_col).cast("long")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), doc_id.alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), doc_id).alias("row"))
    at = (whole["row"] == gone["gone_row"]) & whole["id"].eqNullSafe(gone["gone_id"])
    left = whole.join(gone.hint("merge"), at, "left").where("repeated is null or repeated")
    once = left.where("repeated is null").select("doc.*")
    if gone.where("repeated").isEmpty():
        return once
    told = F.xxhash64(*[F.col(f"doc.`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])
    return once.unionByName(left.where("repeated").groupBy("id", "row").agg(F.min_by("doc", told).alias("doc")).select("doc.*"))
