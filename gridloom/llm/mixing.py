"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of all words by weight, at most ``multiple`` times its own
size; what lies above is reshared by weight until nothing does. A source first gives as many
complete epochs as fit its target; the rest is the prefix, up to the remaining words, of its
documents sorted by the exponential key -ln(u) / quality, u being a hash of the doc_id.

Texts are read once, for their sizes; all else works on a written table of (key, size) rows.
Sorting a whole source in one task would not scale, so that table is dealt by ranges of
(source, key) to as many slices as give each about ``slice_rows`` rows, whatever the keys: a
small table of word sums per (source, slice) gives every slice its offset, and rows are only
sorted within a slice.

Quality is a table of (id, quality between 0 and 1); a document's weight is 0.25 + 0.75 of its
quality, the largest if the id is repeated there, and 0.5 without one.

Defined results: a null text has size 0; null sources form one source, listed last; repeated
rows count as often as they occur; a row without an id is told by its text; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import Stage

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from the MD5 of the id, or else of the text, the same in every engine."""
    told = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(text)))
    digits = F.substring(F.md5(F.concat(F.lit(seed), told)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**12))


def source_targets(sizes: DataFrame, weights: Sequence[int], multiple: int) -> DataFrame:
    """One row per source (grp, source_size) with its target; the windows see one row per source."""
    in_order = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(int(multiple)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    whole = Window.partitionBy()
    s = (
        s.withColumn("all_words", F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_words") - F.col("capped")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    )
    # The first source, by ratio, that stays below its cap sets the level for all that follow.
    first = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "capped", "level"))).over(whole)
    return s.withColumn("final", first["level"]).select(
        "grp", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target")
    )


def _decided(
    docs: DataFrame, quality: DataFrame | None, weights: Sequence[int], multiple: int, seed: str, slice_rows: int, id_col: str, text_col: str, source_col: str
) -> DataFrame:
    """A row for each document: id, size, source_size, target, full (complete epochs), more (0 or 1), and two hashes of the row."""
    stage = Stage(docs.sparkSession, "mixing")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The source as a key that is never null.
    group = F.concat(F.when(F.col(source_col).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(F.col(source_col), F.lit("")))
    d = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).alias("src"),
        group.alias("grp"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(uniform(F.col(id_col), text, seed))).alias("drawn"),
        *row_hashes(docs),
    )
    if quality is None:
        d = d.withColumn("quality", F.lit(None).cast("double"))
    else:
        rated = quality.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("of")).agg(F.max(F.col("quality").cast("double")).alias("quality"))
        # Ratings grow with the corpus, so the join is planned for that at every size.
        d = d.join(rated.hint("merge"), F.col("id") == F.col("of"), "left").drop("of")
    rows = stage.table(d.select("id", "src", "grp", "size", "r1", "r2", (F.col("drawn") / F.coalesce(F.lit(0.25) + F.lit(0.75) * F.col("quality"), F.lit(0.5))).alias("key")))
    # Equal rows are told apart by a number, so that no run of them has to stay in one slice.
    numbered = rows.withColumn("tie", F.monotonically_increasing_id())
    order = ["key", "id", "size", "tie"]
    slices = max(1, math.ceil(rows.count() / slice_rows))
    sliced = stage.table(numbered.repartitionByRange(slices, "grp", *order).withColumn("slice", F.spark_partition_id()))
    sums = sliced.groupBy("src", "grp", "slice").agg(F.sum("size").alias("slice_size"))
    targets = source_targets(sums.groupBy("src", "grp").agg(F.sum("slice_size").alias("source_size")), weights, multiple)
    before = Window.partitionBy("grp").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    plan = stage.table(offsets.join(targets, "grp").select("grp", "slice", "offset", "source_size", "target"))
    inside = Window.partitionBy("grp", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.when(F.col("full") >= multiple, F.lit(0.0)).otherwise(F.col("target") - F.col("full") * F.col("source_size"))
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return (
        sliced.join(plan.hint("merge"), ["grp", "slice"])
        .withColumn("full", full)
        .withColumn("start", start)
        .select("id", "size", "source_size", "target", "full", ((F.col("start") + F.col("size") / F.lit(2.0)) < rest).cast("long").alias("more"), "r1", "r2")
    )


def row_hashes(docs: DataFrame) -> list[Column]:
    """128 bits of all columns: rows with equal bits are equal and can stand for each other."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    return [F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(7), *columns).alias("r2")]


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[int] = (1, 2, 3),
    multiple: int = 3,
    seed: str = "mix",
    slice_rows: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and epochs (how often the mix takes it)."""
    decided = _decided(docs, quality, weights, multiple, seed, slice_rows, id_col, text_col, source_col)
    epochs = F.col("full") + F.col("more")
    return decided.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * epochs).alias("taken"), epochs.alias("epochs"))


def mixed_documents(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[int] = (1, 2, 3),
    multiple: int = 3,
    seed: str = "mix",
    slice_rows: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents, all their columns, each as often as the mix takes it.

    What is taken is decided on ids and sizes; whole rows move once, to meet the decision. Of
    equal rows it says how many are taken once more than the others.
    """
    stage = Stage(docs.sparkSession, "mixed")
    decided = _decided(docs, quality, weights, multiple, seed, slice_rows, id_col, text_col, source_col)
    of_row = decided.groupBy(F.col("r1").alias("d1"), F.col("r2").alias("d2")).agg(F.max("full").alias("full"), F.sum("more").alias("more"))
    taken = stage.table(of_row.where("full + more > 0"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_hashes(docs))
    met = whole.join(taken.hint("merge"), (F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2")))
    number = F.row_number().over(Window.partitionBy("r1", "r2").orderBy("r1"))
    epochs = F.col("full") + (F.col("number") <= F.col("more")).cast("long")
    return met.withColumn("number", number).where(epochs > 0).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), epochs)).alias("epoch")).select("doc.*")
