"""MinHash signatures and exact verification, shared by the document join and paragraph dedup.

Items are sets of hashed word shingles. Items with equal sets form one node. Nodes meet in
buckets of equal signature keys; a pair is looked at in the first bucket it shares only. A
bucket of more than ``BLOCK`` nodes is cut into blocks, and each pair of blocks is a unit of
work of bounded size, so a hot bucket spreads over many tasks and no pair is ever written
out: a unit returns each node's links and a spanning forest of the verified pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Stage
from .vectext import codes_of, mix64, pieces, word_hashes, word_spans

#: Most nodes of one block; a unit compares two blocks.
BLOCK = 256


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and where each text's begin (with the end of the last)."""
    hashed, of = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for parts, owners in pieces(texts):
        codes, starts = codes_of(parts)
        begin, end = word_spans(codes)
        hashed.append(word_hashes(codes, begin, end))
        of.append(owners[np.searchsorted(starts, begin, side="right") - 1])
    return np.concatenate(hashed), np.searchsorted(np.concatenate(of), np.arange(len(texts) + 1))


def line_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As hashed_words, and the number of the line of its text in which each word stands."""
    hashed, of, line = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    passed, last = 0, -1  # line breaks in the earlier pieces of the text that goes on
    for parts, owners in pieces(texts):
        codes, starts = codes_of(parts)
        begin, end = word_spans(codes)
        part = np.searchsorted(starts, begin, side="right") - 1
        breaks = np.cumsum(codes == 10)
        at = breaks[starts - 1]
        before = at[:-1].copy()
        if len(owners) and owners[0] == last:
            before[0] -= passed
        passed = int(at[-1] - before[-1])
        last = int(owners[-1])
        hashed.append(word_hashes(codes, begin, end))
        of.append(owners[part])
        line.append(breaks[begin] - before[part] if len(begin) else np.empty(0, dtype=np.int64))
    return np.concatenate(hashed), np.searchsorted(np.concatenate(of), np.arange(len(texts) + 1)), np.concatenate(line)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; too few are left at the end for the last."""
    usable = max(0, len(words) - size + 1)
    out = np.zeros(usable, dtype=np.uint64)
    for j in range(size if usable else 0):
        out = mix64(out * np.uint64(0x100000001B3) + words[j : j + usable])
    return out


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles.

    Words are runs of lower-case letters and digits. A text of fewer words than ``size`` has
    one shingle, all its words; a text without words has none.
    """
    words, bounds = hashed_words(texts)
    return sets_of(words, bounds[:-1], bounds[1:], size)


def sets_of(words: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of the words from each begin to before its end."""
    whole = rolling(words, size)
    out = []
    for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
        n = hi - lo
        if n >= size:
            out.append(np.unique(whole[lo : hi - size + 1]))
        elif n:
            out.append(rolling(words[lo:hi], n) + np.uint64(n))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _sliding(x: np.ndarray, width: int, join) -> np.ndarray:
    """join over the ``width`` entries from each place on, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = join(out[: len(out) - step], out[step:])
        have += step
    return out


def winnowed(words: np.ndarray, bounds: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the selected windows of ``size`` words; ``reach`` is at most ``size``.

    Of any ``reach`` neighbouring windows of a text the one with the smallest hash is selected,
    so texts that share ``size + reach - 1`` words in a row share a selected window. A text of
    fewer windows has one group, all of them.
    """
    h = rolling(words, size)
    if not len(h):
        return np.empty(0, dtype=np.int64), h
    at = np.arange(len(h))
    text = np.searchsorted(bounds, at, side="right") - 1
    last = bounds[text + 1] - size  # the last window of the text
    inside = at <= last
    whole = inside & ((at + reach - 1 <= last) | (at == bounds[text]))
    # Behind a text's last window lie size - 1 places that hold no window, so no group of a
    # short text reaches the next one.
    highest = np.iinfo(np.uint64).max
    ranked = np.concatenate([np.where(inside, h, highest), np.full(reach - 1, highest, dtype=np.uint64)])
    least = np.where(whole, _sliding(ranked, reach, np.minimum), np.uint64(0))
    # A window is the smallest of one of its groups if the greatest of their minima is its own.
    groups = _sliding(np.concatenate([np.zeros(reach - 1, dtype=np.uint64), least]), reach, np.maximum)
    where = np.flatnonzero(inside & (groups == h))
    return where, h[where]


def minima(sets: list[np.ndarray], many: int, seed: int = 20_011) -> Iterator[np.ndarray]:
    """``many`` times the least hash of each set, none of which is empty, each under another function."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    h = (flat >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, size=many, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, size=many, dtype=np.uint64).astype(np.uint32)
    for k in range(many):
        yield np.minimum.reduceat((h ^ b[k]) * a[k], at)


def signature_keys(sets: list[np.ndarray], groups: int, depth: int, seed: int = 20_011) -> np.ndarray:
    """(items, groups) int64 keys, each over ``depth`` minima; rows of empty sets are 0."""
    keys = np.zeros((len(sets), groups), dtype=np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return keys.view(np.int64)
    least = minima([sets[i] for i in some], groups * depth, seed)
    for g in range(groups):
        key = np.full(len(some), g + 1, dtype=np.uint64)
        for _ in range(depth):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + next(least))
        keys[some, g] = key
    return keys.view(np.int64)


def node_ids(sets: list[np.ndarray]) -> list[int]:
    """A 64-bit number of each set: the scrambled sum of its scrambled members and their count."""
    with np.errstate(over="ignore"):
        return [int(mix64(np.array([mix64(s).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0]) for s in sets]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of each run of equal leading columns, as lists by column."""
    current, rows = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        rest = [batch.column(i) for i in range(keys, batch.num_columns)]
        lo = 0
        for i in range(1, len(heads) + 1):
            if i == len(heads) or heads[i] != heads[lo]:
                if heads[lo] != current:
                    if rows is not None:
                        yield current, rows
                    current, rows = heads[lo], [[] for _ in rest]
                for held, column in zip(rows, rest, strict=True):
                    held.extend(column.slice(lo, i - lo).to_pylist())
                lo = i
    if rows is not None:
        yield current, rows


def _first_meeting(keys: np.ndarray, group: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each pair of left and right rows meets first in this key group."""
    met = np.zeros((len(left), len(right)), dtype=bool)
    for g in range(group):
        met |= keys[left, g][:, None] == keys[right, g][None, :]
    return ~met


def _pairs(block: np.ndarray, nodes: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks of a unit and which pairs belong to it."""
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    own = np.ones((len(left), len(right)), dtype=bool)
    if lo == hi:
        own = nodes[left][:, None] < nodes[right][None, :]
    return left, right, own


#: The row that stands for a node; those without an id come last.
REP = "struct<none:boolean,id:bigint,row:bigint>"
_NEED = pa.schema([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("node", pa.int64()), ("block", pa.int32()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("grp", pa.int32())])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a unit that have a pair to verify there."""
    out: list[tuple] = []
    for (key, lo, hi), (node, block, size, keys, grp) in _runs(batches, 3):
        nodes, blocks, k = np.array(node), np.array(block), np.array(keys)
        left, right, own = _pairs(blocks, nodes, lo, hi)
        if not len(left) or not len(right):
            continue
        todo = own & _first_meeting(k, grp[0], left, right)
        for i in sorted({*left[todo.any(axis=1)].tolist(), *right[todo.any(axis=0)].tolist()}):
            out.append((key, lo, hi, node[i], block[i], size[i], keys[i], grp[i]))
        if len(out) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NEED, strict=True)], schema=_NEED)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NEED, strict=True)], schema=_NEED)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], dtype=np.int64).reshape(len(left), len(right))
    flat = np.concatenate(left + right)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, row = column[shared], row[shared]
    _, column = np.unique(column, return_inverse=True)
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = 4096
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + width + 1, width))
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        m = np.zeros((len(left) + len(right), width), dtype=np.float32)
        m[row[a:b], column[a:b] - c * width] = 1.0
        total += m[: len(left)] @ m[len(left) :].T
    return total.astype(np.int64)


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verified(threshold: float):
    """Links of each member of a unit (copies counted) and the root of its verified component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for (_, lo, hi), (node, block, size, keys, grp, shingles) in _runs(batches, 3):
            keep = list({n: i for i, n in reversed(list(enumerate(node)))}.values())  # repeated rows of a document
            nodes, blocks = np.array([node[i] for i in keep]), np.array([block[i] for i in keep])
            sizes, k = np.array([size[i] for i in keep]), np.array([keys[i] for i in keep])
            sets = [np.frombuffer(shingles[i], dtype=np.uint64) for i in keep]
            left, right, own = _pairs(blocks, nodes, lo, hi)
            if not len(left) or not len(right):
                continue
            own &= _first_meeting(k, grp[0], left, right)
            both = common_counts([sets[i] for i in left], [sets[i] for i in right])
            counts = np.array([len(s) for s in sets])
            union = counts[left][:, None] + counts[right][None, :] - both
            linked = own & (both >= threshold * union - 1e-9)
            if not linked.any():
                continue
            links = np.zeros(len(nodes), dtype=np.int64)
            np.add.at(links, left, linked @ sizes[right])
            np.add.at(links, right, linked.T @ sizes[left])
            root = nodes.copy()
            while True:  # the smallest node spreads along the links
                before = root.copy()
                spread = np.where(linked, np.minimum(root[left][:, None], root[right][None, :]), np.iinfo(np.int64).max)
                np.minimum.at(root, left, spread.min(axis=1, initial=np.iinfo(np.int64).max))
                np.minimum.at(root, right, spread.min(axis=0, initial=np.iinfo(np.int64).max))
                if (root == before).all():
                    break
            out += [(int(nodes[i]), int(links[i]), int(root[i])) for i in np.flatnonzero(links)]
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_LINKS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_LINKS)

    return run


def verified_links(
    nodes: DataFrame, payload: Callable[[DataFrame], DataFrame], threshold: float, stage: Stage, block: int = BLOCK
) -> DataFrame:
    """Written (node, links, root) rows, several per node; nodes without a link have none.

    ``nodes``: written rows (node, rep, size, keys), one per distinct set, rep being a row of
    type REP that holds it. ``payload`` gets the (node, rep) that have a pair to verify and
    gives their (node, shingles).
    """
    keyed = nodes.select("node", F.posexplode("keys").alias("grp", "key"))
    # Written, so that the join below has exchanges on both sides and splits at a hot key.
    full = stage.table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    met = keyed.join(full, "key").select("key", "grp", "node", F.ceil(F.col("members") / F.lit(float(block))).cast("int").alias("blocks"))
    met = met.join(nodes.select(F.col("node").alias("n"), "size", "keys"), F.col("node") == F.col("n")).drop("n")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    units = (
        met.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block", "size", "keys", "grp")
    )
    dealt = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    need = stage.table(dealt.mapInArrow(_needed, "key long, lo int, hi int, node long, block int, size long, keys array<long>, grp int"))
    wanted = need.select("node").distinct().join(nodes.select("node", "rep"), "node")
    # Once for each node, however often its row is repeated.
    sets = payload(wanted).groupBy("node").agg(F.first("shingles").alias("shingles"))
    rows = need.join(sets.hint("merge"), "node").select("key", "lo", "hi", "node", "block", "size", "keys", "grp", "shingles")
    found = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_verified(threshold), "node long, links long, root long")
    links = stage.table(found, release=True)
    for done in (full, need):
        stage.drop(done)
    return links


def with_row_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, id, row): a document is told by its id and text, so rows without an id or with a repeated one differ."""
    d = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"))
    return d.select("text", "id", F.xxhash64("text", "id").alias("row"))


def rep_of(of: str = "") -> Column:
    """A row as REP: the least of them is the one with the smallest id."""
    return F.struct(F.col(f"{of}id").isNull().alias("none"), F.col(f"{of}id").alias("id"), F.col(f"{of}row").alias("row"))
