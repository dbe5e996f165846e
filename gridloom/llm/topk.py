"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors become integers, floor(256 * x). Candidates lie in blocks of bounded size, each with
one list per dimension, sorted by component. A batch of queries reads the lists together, from
the ends that its components favour and all to the same depth. Whatever the lists show is scored
exactly, and a query stops once its bound, its product with the components at the lists' depth,
is below its kth score, which it keeps from block to block. A bound equal to the kth score reads
on, since an unseen vector with a smaller id could tie. In a block the rows stand in the order in
which the lists show them, so that the scores of a round are one product of two matrices.

Queries and candidates meet in cells: each cell has one part of the queries and one of the
candidates, packed into rows of bytes as they are read, and is one partition of bounded size
(``CELL_BYTES`` of candidates, half as many of queries). A task holds its queries and streams
its candidates; the best of each cell are merged per query.

Defined results: vectors that are null, empty, or hold a null or non-finite component, and
rows without an id take no part; vectors of another length than the query's are no candidates
for it; a repeated id as query is answered once, for the least of its vectors in order of
components, is no candidate for itself, and as candidate counts once for each row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
QUERY_BLOCK = 256
#: So many scores are made at once: they fit a core's cache.
PIECE = 2**19
#: Bytes of packed candidates in a cell; so many pairs are worth a cell of their own, in so many parts of the candidates at most.
CELL_BYTES = 32_000_000
CELL_PAIRS = 2**29
CELL_PARTS = 64


def _exact(*vectors: np.ndarray) -> type:
    """The fastest type in which all products of such vectors, and their partial sums, are exact."""
    limit = max((max(abs(int(v.min(initial=0))), abs(int(v.max(initial=0)))) for v in vectors), default=0) ** 2 * vectors[0].shape[1]
    return np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else object


class Best:
    """The k best so far of each of some queries, best first; no row yet where the score is -inf."""

    def __init__(self, own: np.ndarray, k: int) -> None:
        self.own, self.k = own, k
        self.scores = np.full((len(own), k), -np.inf)
        self.ids = np.zeros((len(own), k), dtype=np.int64)
        self.rooms: dict = {}
        self.noted: list[tuple] = []

    def room(self, lines: int, rows: int, kind: type) -> np.ndarray:
        """An array to write to, in memory that is used again."""
        if len(self.rooms.get(kind, ())) < lines * rows:
            self.rooms[kind] = np.empty(lines * rows, dtype=kind)
        return self.rooms[kind][: lines * rows].reshape(lines, rows)

    def _reached(self, scores: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Positions of the scores that are at least ``least`` of their line. Few are, so 64 are looked at at once."""
        whole = self.room(-(-scores.size // 64), 64, bool)
        flat = whole.reshape(-1)
        flat[scores.size :] = False
        np.greater_equal(scores, least[:, None], out=flat[: scores.size].reshape(scores.shape))
        some = np.flatnonzero(np.packbits(flat).view(np.uint64))
        word, place = np.divmod(np.flatnonzero(whole[some]), 64)
        return some[word] * 64 + place

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Note which scores, a line for each of ``queries``, can be among the best; many are settled at once."""
        k, wide = self.k, scores.shape[1]
        least = self.scores[queries, k - 1].astype(scores.dtype)
        flat = self._reached(scores, least)
        if len(flat) > 4 * k * len(queries) and scores.dtype != object:
            # The kth score of these rows is nearer than the kth so far.
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            flat = self._reached(scores, least)
        line = flat // wide
        whom, found, whose = queries[line], scores.ravel()[flat], ids[flat - line * wide]
        better = (found > -np.inf) & ((found > self.scores[whom, k - 1]) | (whose < self.ids[whom, k - 1])).astype(bool)
        self.noted.append((whom[better], found[better], whose[better]))
        if sum(len(x[0]) for x in self.noted) >= len(queries):
            self.settle()

    def settle(self) -> None:
        """Keep the best of what was noted."""
        noted, self.noted = [x for x in self.noted if len(x[0])], []
        if not noted:
            return
        queries, scores, ids = (np.concatenate(x) for x in zip(*noted, strict=True))
        if scores.dtype == object and self.scores.dtype != object:
            whole = np.isfinite(self.scores)
            self.scores = self.scores.astype(object)
            self.scores[whole] = [int(x) for x in self.scores[whole]]
        met = np.unique(queries)
        held = self.scores[met].ravel()
        filled = (held > -np.inf).astype(bool)
        q = np.concatenate([np.repeat(met, self.k)[filled], queries])
        s = np.concatenate([held[filled], scores.astype(self.scores.dtype)])
        i = np.concatenate([self.ids[met].ravel()[filled], ids])
        falling = -s if s.dtype != object else -np.unique(s, return_inverse=True)[1]
        order = np.lexsort((i, falling, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.scores[q[kept], place[kept]] = s[kept]
        self.ids[q[kept], place[kept]] = i[kept]


def _needed(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The rows that can be among the k best of any query: of equal vectors the 2 k least ids, each k times at most, of which a query's own are k at most."""
    alike = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.itemsize * vectors.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    rows = np.lexsort((ids, alike))
    for keys, most in ((lambda: alike[rows] * len(ids) + np.unique(ids[rows], return_inverse=True)[1], k), (lambda: alike[rows], 2 * k)):
        key = keys()
        rows = rows[np.arange(len(rows)) - np.searchsorted(key, key) < most]
    return np.sort(rows)


class SortedLists:
    """One block of candidates under per-dimension sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, n = ids, vectors, len(ids)
        columns = np.ascontiguousarray(vectors.T)
        order = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, order, axis=1)
        self.place = np.empty((vectors.shape[1], n), dtype=np.int32)
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.int32)[None, :], axis=1)
        self.as_shown: tuple = (None,)

    def _shown(self, up: np.ndarray, down: np.ndarray, exact: type) -> tuple:
        """Ids and vectors in the order in which the upper ends of some lists and the lower ends of some show them, the depths at which they do, and the rows by id."""
        key = (up.tobytes(), down.tobytes(), exact)
        if self.as_shown[0] != key:
            n = len(self.ids)
            first = np.minimum(n - self.place[up].max(axis=0, initial=0), 1 + self.place[down].min(axis=0, initial=n - 1))
            rows = np.argsort(first, kind="stable")
            ids = self.ids[rows]
            by_id = np.argsort(ids, kind="stable")
            self.as_shown = (key, ids, self.vectors[rows].astype(exact), first[rows], by_id, ids[by_id])
        return self.as_shown[1:]

    def search(self, queries: np.ndarray, best: Best, part: slice, exact: type) -> int:
        """Take into ``best`` what the block has for the queries at ``part`` of it; how many scores that took."""
        n, k, scored = len(self.ids), best.k, 0
        queries = queries.astype(exact)
        ids, vectors, shown, by_id, sorted_ids = self._shown((queries > 0).any(axis=0), (queries < 0).any(axis=0), exact)
        upper, lower = np.maximum(queries, 0), np.minimum(queries, 0)
        depths = [0]
        while depths[-1] < n:
            depths.append(min(n, max(1, depths[-1] * 4)))
        # At a depth the bound of what is left; there is nothing at the last.
        at = np.array(depths[:-1])
        bounds = upper @ self.values[:, n - np.maximum(at, 1)].astype(exact) + lower @ self.values[:, np.maximum(at, 1) - 1].astype(exact)
        own = best.own[part]
        left, right = np.searchsorted(sorted_ids, own), np.searchsorted(sorted_ids, own, side="right")
        many = right - left
        whose = np.repeat(np.arange(len(own)), many)
        where = by_id[np.repeat(left, many) + np.arange(len(whose)) - np.repeat(np.cumsum(many) - many, many)]
        step, before, active = 0, 0, np.arange(len(queries))
        while True:
            kth = best.scores[part][active, k - 1]
            reads = ~(bounds[active, step] < kth)
            active, kth = active[reads.astype(bool)], kth[reads.astype(bool)]
            if not len(active):
                break
            # The lists are read on to the next depth at which a query can stop; a query without k rows tries each.
            stops = (bounds[active, step + 1 :] < kth[:, None]).astype(bool) | (kth == -np.inf)[:, None]
            step += 1 + (int(np.argmax(stops.any(axis=0))) if stops.any() else stops.shape[1])
            upto = n if depths[step] >= n else int(np.searchsorted(shown, depths[step], side="right"))
            asked = queries if len(active) == len(queries) else queries[active]
            line = np.minimum(np.searchsorted(active, whose), len(active) - 1)
            here = active[line] == whose
            for start in range(before, upto, span := max(1, PIECE // len(active))):
                rows = slice(start, min(upto, start + span))
                scores = np.matmul(asked, vectors[rows].T, out=best.room(len(active), rows.stop - start, exact))
                hit = here & (where >= start) & (where < rows.stop)
                scores[line[hit], where[hit] - start] = -np.inf
                scored += scores.size - int(hit.sum())
                best.offer(active + part.start, ids[rows], scores)
            best.settle()
            before = max(before, upto)
            if depths[step] >= n or before >= n:
                break
        return scored

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best but the query's own rows, and how many were scored."""
        best = Best(np.array([own]), k)
        scored = self.search(query[None, :], best, slice(0, 1), _exact(self.vectors, query[None, :]))
        found = best.scores[0] > -np.inf
        return best.ids[0][found], best.scores[0][found], scored


def integer_components(embedding: Column) -> Column:
    """floor(256 * x) of every component; null where the vector takes no part."""
    usable = embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(
        embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    )
    return F.when(usable, F.transform(embedding, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


_PACKED = "part int, dim int, width int, ids binary, vectors binary"


def _pack(parts: int, most: int):
    """Rows of id and v as rows of bytes, of ``most`` vectors of one length; the packed rows of a task are dealt to the parts in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for batch in batches:
            ids, v = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(1)
            flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.asarray(v.offsets)
            starts, dims = ends[:-1] - ends[0], np.diff(ends)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for a in range(0, len(rows), most):
                    some = rows[a : a + most]
                    vectors = flat[starts[some][:, None] + np.arange(dim)]
                    low, high = vectors.min(), vectors.max()
                    width = next(w for w in (2, 4, 8) if w == 8 or -(2 ** (8 * w - 1)) <= low and high < 2 ** (8 * w - 1))
                    turn += 1
                    packed = [[turn % parts], [dim], [width], [ids[some].tobytes()], [vectors.astype(f"<i{width}").tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, _PACKED_TYPES, strict=True)], schema=_PACKED_SCHEMA)

    return run


_PACKED_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_PACKED_SCHEMA = pa.schema(list(zip(("part", "dim", "width", "ids", "vectors"), _PACKED_TYPES, strict=True)))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            group, dim, candidates, width = (batch.column(c)[i].as_py() for c in range(4))
            ids, vectors = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((4, "<i8"), (5, f"<i{width}")))
            yield (group, dim), candidates, ids, vectors.reshape(-1, dim)


def _search(k: int, block: int, query_block: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def against(held: list[tuple], queries: np.ndarray, best: Best) -> None:
        ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
        for a in range(0, len(ids), block):
            needed = a + _needed(ids[a : a + block], vectors[a : a + block], k)
            lists = SortedLists(ids[needed], vectors[needed])
            exact = _exact(lists.vectors, queries)
            for b in range(0, len(queries), query_block):
                lists.search(queries[b : b + query_block], best, slice(b, min(b + query_block, len(queries))), exact)

    def results(best: Best | None) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(best.own) if best else 0, 4096):
            line, place = np.nonzero(best.scores[a : a + 4096] > -np.inf)
            scores = best.scores[a + line, place]
            yield pa.RecordBatch.from_arrays([pa.array(best.own[a + line]), pa.array(best.ids[a + line, place]), pa.array([int(s) for s in scores], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, held, queries, best = None, [], [], None, None
        for group, candidates, ids, vectors in _unpacked(batches):
            if group != at:
                if held:
                    against(held, queries, best)
                yield from results(best)
                at, asked, held, queries, best = group, [], [], None, None
            if not candidates:
                asked.append((ids, vectors))
            elif asked or best:
                if best is None:
                    own, queries = (np.concatenate(x) for x in zip(*asked, strict=True))
                    asked, best = [], Best(own, k)
                held.append((ids, vectors))
                if sum(len(x) for x, _ in held) >= block:
                    against(held, queries, best)
                    held = []
        if held:
            against(held, queries, best)
        yield from results(best)

    return run


def top_inner_products(
    vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e")).where("id is not null")
    high = F.greatest(F.abs(F.array_max("e").cast("double")), F.abs(F.array_min("e").cast("double")))
    shape = raw.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("id") % every == 0).cast("long")).alias("q"),
        F.max(F.size("e")).alias("dim"),
        F.max(F.when(high < float("inf"), high)).alias("high"),
    ).first()
    n, q, high = shape["n"], shape["q"] or 0, 256 * (shape["high"] or 0) + 1
    row = 8 + max(shape["dim"] or 0, 1) * (2 if high < 2**15 else 4 if high < 2**31 else 8)
    parts = max(1, math.ceil(n * row / CELL_BYTES), min(math.ceil(n * q / CELL_PAIRS), math.ceil(n / block), CELL_PARTS))
    query_parts = max(1, math.ceil(q * row / (CELL_BYTES / 2)))

    v = raw.select("id", integer_components(F.col("e")).alias("v")).where("v is not null")
    queries = v.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))

    def cells(df: DataFrame, own: int, others: int, most: int, cell: str, candidates: bool) -> DataFrame:
        """Each packed row in the cells of its part with all parts of the others."""
        packed = df.select("id", "v").mapInArrow(_pack(own, most), _PACKED).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return packed.select(F.expr(cell).cast("int").alias("cell"), "dim", F.lit(candidates).alias("candidates"), "width", "ids", "vectors")

    # A packed row is 1 MB at most; several small ones make a block.
    most = max(1, min(block, 1_000_000 // row))
    asked = cells(queries, query_parts, parts, most, f"part * {parts} + other", False)
    held = cells(v, parts, query_parts, most, f"other * {parts} + part", True)
    met = asked.unionByName(held).repartitionById(parts * query_parts, "cell").sortWithinPartitions("cell", "dim", "candidates")
    found = met.mapInArrow(_search(k, block, query_block), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
