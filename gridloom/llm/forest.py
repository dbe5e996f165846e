"""MinHash LSH forest: prefix tries of signatures, whose matched prefixes are shortened as recall needs.

Each tree is the trie of one sequence of ``longest`` minima of every set, as labels of 16 bits.
A subtree is a prefix of labels; its size comes from a partial aggregate level by level, from
the ``shortest`` prefixes down, and what is alone below a prefix goes no deeper.

A set starts from its longest prefixes, at which a pair at the threshold could be missed, and
shortens them one label at a time, always in the tree where the next subtree is smallest, until
the chance that such a pair shares none of its prefixes is at most 1 - recall. So a set in a
sparse part of a tree gets its recall from short prefixes there and keeps long ones where the
trie is crowded. A subtree that any of its sets asks for is a bucket for all sets below it, and
of nested ones the largest counts, which can only add to the recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import minima
from .staging import Stage
from .vectext import mix64

#: Bytes of a label.
LABEL = 2


def signatures(sets: list[np.ndarray], trees: int, longest: int) -> list[bytes]:
    """The labels of each set, tree by tree; zeros for an empty set."""
    out = np.zeros((len(sets), trees * longest), dtype=np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        for k, least in enumerate(minima([sets[i] for i in some], trees * longest)):
            out[some, k] = (mix64(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    return [row.tobytes() for row in out]


def shortened(sizes: np.ndarray, shortest: int, threshold: float, recall: float) -> np.ndarray:
    """The prefix length of each set in each tree; ``sizes[i, t, k]`` is that of the subtree at ``shortest + k``."""
    levels = sizes.shape[2]
    depth = np.full(sizes.shape[:2], levels - 1)
    miss = np.log1p(-(threshold ** (shortest + np.arange(levels, dtype=float))))
    enough = np.log1p(-recall)
    rows = np.arange(len(sizes))
    while len(rows):
        at = depth[rows]
        # Of the trees that can still be shortened, the smallest next subtree; ties to the longer prefix.
        ahead = np.take_along_axis(sizes[rows], np.maximum(at - 1, 0)[:, :, None], axis=2)[:, :, 0].astype(float)
        ahead = np.where(at > 0, ahead - at / 64.0, np.inf)
        todo = (miss[at].sum(axis=1) > enough) & (at > 0).any(axis=1)
        rows, ahead = rows[todo], ahead[todo]
        depth[rows, ahead.argmin(axis=1)] -= 1
    return shortest + depth


def guaranteed(trees: int, shortest: int, threshold: float) -> float:
    """The recall at the threshold with all prefixes at their shortest."""
    return 1.0 - (1.0 - threshold**shortest) ** trees


def _ask(trees: int, shortest: int, longest: int, threshold: float, recall: float):
    """The subtrees that each set asks for, of those that hold another set, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            tree, at = flat.field("tree").to_numpy(), flat.field("depth").to_numpy()
            sizes = np.ones((batch.num_rows, trees, longest - shortest + 1), dtype=np.int64)
            sizes[owner, tree, at - shortest] = flat.field("n").to_numpy()
            depth = shortened(sizes, shortest, threshold, recall)[owner, tree]
            yield pa.RecordBatch.from_arrays([flat.field("at").filter(pa.array(at == depth))], names=["at"])

    return run


def forest_buckets(nodes: DataFrame, trees: int, shortest: int, longest: int, threshold: float, recall: float, stage: Stage) -> DataFrame:
    """Written (node, keys) of the nodes that share a bucket; ``nodes`` holds (node, signature).

    ``keys`` has the node's bucket in each tree, or a key of its own where it has none.
    """
    if guaranteed(trees, shortest, threshold) < recall:
        raise ValueError(f"{trees} trees of prefixes of {shortest} or more cannot reach a recall of {recall}")
    width = LABEL * longest

    def subtree(depth: int) -> Column:
        return F.xxhash64("tree", F.lit(depth), F.expr(f"substring(path, 1, {LABEL * depth})"))

    def crowded(places: DataFrame) -> DataFrame:
        """The places, with its size, of every subtree that holds more than one set.

        Sizes are written, so that the join has an exchange on either side and splits at a hot
        subtree; they grow with the corpus, so the join is planned for that at every size.
        """
        sizes = stage.table(places.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        return places.join(sizes.hint("merge"), "at")

    paths = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    paths = paths.select("node", "tree", F.expr(f"substring(signature, tree * {width} + 1, {width})").alias("path"))
    top = stage.table(crowded(paths.withColumn("at", subtree(shortest))).withColumn("depth", F.lit(shortest)))
    deeper = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), subtree(d).alias("at")) for d in range(shortest + 1, longest + 1)]))
    columns = ["node", "tree", "depth", "at", "n"]
    below = crowded(top.select("node", "tree", deeper.alias("e")).select("node", "tree", "e.*")) if longest > shortest else top.limit(0)
    places = stage.table(top.select(*columns).unionByName(below.select(*columns)))
    of_node = places.groupBy("node").agg(F.collect_list(F.struct("tree", "depth", "at", "n")).alias("places"))
    asked = of_node.select("places").mapInArrow(_ask(trees, shortest, longest, threshold, recall), "at long")
    buckets = stage.table(asked.distinct())
    found = places.join(buckets.hint("merge"), "at").groupBy("node").agg(F.collect_list(F.struct("tree", "depth", "at")).alias("found"))
    # Structs are ordered by tree, then depth, so the least of a tree is its shortest prefix asked for.
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.coalesce(F.array_min(F.filter("found", lambda e: e["tree"] == t))["at"], F.xxhash64(F.col("node"), t, F.lit("alone"))),
    )
    return stage.table(found.select("node", cut.alias("keys")))
