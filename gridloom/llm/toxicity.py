"""Toxicity by class-conditional Kneser-Ney models of character 5-grams.

Toxic and ordinary training rows have a model each: interpolated Kneser-Ney with absolute
discounting whose top order counts the class's own 5-grams and whose lower orders are
continuation counts shared by both classes, so a rare expression is smoothed alike in both.
Text is the lower-case letters and digits of each word between white space.

What a 5-gram adds to the log-likelihood ratio is fixed once the counts are known: for a
5-gram that either class has seen, the ratio of the two probabilities; for any other, the
shared lower order cancels and the ratio of the two back-off weights remains. Both are looked
up by the whole gram in tables with one entry for each distinct gram, so no two grams share a
number and an unseen gram is never taken for a seen one; they are all that reaches the workers,
and grow with the distinct 5-grams. A document is described by the length-normalised difference
of the two log-likelihoods over the whole text, by the strongest word's own, and by its share of
words that lean to the toxic class, and a logistic regression on these gives the score.

The regression is fitted on at most ``fit_rows`` training rows, chosen by a hash of the id; the
counts cover every other training row.

Defined results: null and empty texts are scored as texts without words; rows of ``labels``
that repeat an id are joined to the largest label; null labels are left out; with no training
row or one class only the score is the smoothed share of toxic rows; repeated documents are
scored as often as they occur; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import chunks, codes_of, pieces, word_spans

ORDER = 5
_PAD = " "
_GRAMS = pa.schema([("gram", pa.string()), ("c0", pa.int64()), ("c1", pa.int64())])


def _class_grams(flush_words: int):
    """Counts of the padded 5-grams of each class within a task, by way of its word types."""

    def emit(words: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, list[int]] = {}
        for label in (0, 1):
            for word, count in words[label].items():
                padded = _PAD * (ORDER - 1) + word + _PAD
                for i in range(len(padded) - ORDER + 1):
                    grams.setdefault(padded[i : i + ORDER], [0, 0])[label] += count
        items = list(grams.items())
        for lo in range(0, len(items), 50_000):
            part = items[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in part]), pa.array([c[0] for _, c in part], pa.int64()), pa.array([c[1] for _, c in part], pa.int64())], schema=_GRAMS
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = (Counter(), Counter())
        for batch, texts in chunks(batches, 0):
            labels = batch.column(1).to_pylist()
            for parts, owners in pieces(texts):
                codes, starts = codes_of(parts)
                begin, end = word_spans(codes)
                whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
                owner = owners[np.searchsorted(starts, begin, side="right") - 1]
                for b, e, d in zip(begin.tolist(), end.tolist(), owner.tolist(), strict=True):
                    words[labels[d]][whole[b:e]] += 1
            if len(words[0]) + len(words[1]) > flush_words:
                yield from emit(words)
                words = (Counter(), Counter())
        yield from emit(words)

    return run


class GramTable:
    """A number for each gram of up to six code points, found by the whole gram."""

    def __init__(self, high: np.ndarray, low: np.ndarray, value: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(len(value), 1).bit_length() - 1)
        bucket = (_spread(high, low) >> self.shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.high, self.low, self.value = high[order], low[order], value[order].astype(np.float32)
        self.start = np.searchsorted(bucket[order], np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def get(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The grams' numbers, NaN where there is none."""
        out = np.full(len(high), np.nan, dtype=np.float32)
        bucket = (_spread(high, low) >> self.shift).astype(np.int64)
        at, stop = self.start[bucket], self.start[bucket + 1]
        todo = np.flatnonzero(at < stop)
        at, stop = at[todo], stop[todo]
        while len(todo):
            same = (self.high[at] == high[todo]) & (self.low[at] == low[todo])
            out[todo[same]] = self.value[at[same]]
            at = at + 1
            more = ~same & (at < stop)
            todo, at, stop = todo[more], at[more], stop[more]
        return out


def packed(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each column of up to six code points as two numbers, without loss."""
    both = []
    for rows in (columns[:3], columns[3:]):
        out = np.zeros(columns.shape[1], dtype=np.uint64)
        for row in rows:
            out = (out << np.uint64(21)) | row.astype(np.uint64)
        both.append(out)
    return both[0], both[1]


def _spread(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    from .vectext import mix64

    return mix64(mix64(high) ^ low)


def _empty() -> GramTable:
    none = np.zeros(0, dtype=np.uint64)
    return GramTable(none, none, np.zeros(0, dtype=np.float32))


@dataclass(frozen=True)
class ToxicityModel:
    """Tables of log-likelihood ratios and the regression on top of them."""

    gram_ratio: GramTable  # of the 5-grams that a class has seen
    context_ratio: GramTable
    beta: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: whole-text normalised ratio, strongest word's, log share of leaning words."""
        out = np.zeros((len(texts), 3))
        total, chars, top = np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), -np.inf)
        leaning, words = np.zeros(len(texts)), np.zeros(len(texts))
        for parts, owners in pieces(texts):
            owner, ratio, length = self._words(parts)
            of = owners[owner]
            np.add.at(total, of, ratio)
            np.add.at(chars, of, length)
            np.maximum.at(top, of, np.minimum(ratio, 30.0))
            np.add.at(leaning, of, ratio > 6.0)
            np.add.at(words, of, 1.0)
        some = words > 0
        out[some, 0] = total[some] / chars[some]
        out[some, 1] = top[some]
        out[some, 2] = np.log1p(leaning[some]) - 0.5 * np.log1p(words[some] / 100.0)
        return out

    def _words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's part, summed log-likelihood ratio, and number of predicted characters."""
        codes, starts = codes_of(parts)
        begin, end = word_spans(codes)
        if not len(begin):
            return np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64)
        # Every letter, and the space behind each word, is predicted from the four codes before
        # it; what lies before the word's start counts as padding.
        length = end - begin + 1
        first = np.repeat(begin.astype(np.int32), length)
        offset = np.cumsum(length) - length
        at = (np.arange(len(first), dtype=np.int32) - np.repeat(offset, length).astype(np.int32)) + first
        columns = np.empty((ORDER, len(at)), dtype=np.uint32)
        for k in range(ORDER - 1):
            back = at - (ORDER - 1 - k)
            columns[k] = np.where(back >= first, codes[np.maximum(back, 0)], np.uint32(32))
        columns[-1] = codes[at]
        columns[-1][offset + length - 1] = 32
        value = self.gram_ratio.get(*packed(columns))
        unseen = np.flatnonzero(np.isnan(value))
        value[unseen] = np.nan_to_num(self.context_ratio.get(*packed(columns[:-1, unseen])))
        ratio = np.add.reduceat(value.astype(np.float64), offset)
        return np.searchsorted(starts, begin, side="right") - 1, ratio, length

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        z = self.beta[0] + x @ self.beta[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _packed_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of one size and their numbers, packed for a table."""
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("v", pa.float32())])
    for batch in batches:
        grams = batch.column(0).to_pylist()
        if not grams:
            continue
        columns = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, len(grams[0])).T
        high, low = packed(columns)
        yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), batch.column(1).cast(pa.float32())], schema=schema)


def _tables(grams: DataFrame, discount: float) -> tuple[GramTable, GramTable]:
    """The two tables, from the counts of all 5-grams; 20 bytes are collected for each distinct gram."""
    sub = lambda c, a, n: F.substring(c, a, n)
    # Shared lower orders: in how many distinct places a shorter gram continues a longer one.
    order4 = grams.groupBy(sub("gram", 2, 4).alias("g4")).agg(F.count(F.lit(1)).cast("double").alias("n4"))
    order3 = order4.groupBy(sub("g4", 2, 3).alias("g3")).agg(F.count(F.lit(1)).cast("double").alias("n3"))
    order2 = order3.groupBy(sub("g3", 2, 2).alias("g2")).agg(F.count(F.lit(1)).cast("double").alias("n2"))
    d = F.lit(discount)

    def lower(longer: DataFrame, gram: str, n: str, size: int, below: DataFrame | None, below_gram: str) -> DataFrame:
        """Interpolated probability of the last character of each gram of one shared order."""
        context = longer.groupBy(sub(gram, 1, size - 1).alias("h")).agg(F.sum(n).alias("hn"), F.count(F.lit(1)).cast("double").alias("ht"))
        g = longer.join(context, sub(gram, 1, size - 1) == F.col("h"))
        if below is None:
            return g.select(gram, ((F.greatest(F.col(n) - d, F.lit(0.0)) + d * F.col("ht") / F.lit(65536.0)) / F.col("hn")).alias(f"p{size}"))
        g = g.join(below, sub(gram, 2, size - 1) == F.col(below_gram))
        return g.select(gram, ((F.greatest(F.col(n) - d, F.lit(0.0)) + d * F.col("ht") * F.col(f"p{size - 1}")) / F.col("hn")).alias(f"p{size}"))

    p2 = lower(order2, "g2", "n2", 2, None, "")
    p3 = lower(order3, "g3", "n3", 3, p2, "g2")
    p4 = lower(order4, "g4", "n4", 4, p3, "g3")
    context = grams.groupBy(sub("gram", 1, 4).alias("h")).agg(
        *[F.sum(c).cast("double").alias(f"h{c}") for c in ("c0", "c1")],
        *[F.sum((F.col(c) > 0).cast("double")).alias(f"t{c}") for c in ("c0", "c1")],
    )
    full = grams.join(context, sub("gram", 1, 4) == F.col("h")).join(p4, sub("gram", 2, 4) == F.col("g4"))

    def probability(c: str):
        own = F.greatest(F.col(c) - d, F.lit(0.0)) + d * F.col(f"t{c}") * F.col("p4")
        return F.when(F.col(f"h{c}") > 0, own / F.col(f"h{c}")).otherwise(F.col("p4"))

    def backoff(c: str):
        return F.when(F.col(f"h{c}") > 0, d * F.col(f"t{c}") / F.col(f"h{c}")).otherwise(F.lit(1.0))

    seen = full.select("gram", F.log(probability("c1") / probability("c0")).alias("v"))
    unseen = context.select("h", F.log(backoff("c1") / backoff("c0")).alias("v"))
    found = []
    for frame in (seen, unseen):
        rows = frame.mapInArrow(_packed_grams, "high long, low long, v float").toArrow()
        high, low = (rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("high", "low"))
        found.append(GramTable(high, low, rows["v"].to_numpy()))
    return found[0], found[1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    x1 = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x1.shape[1])
    penalty = np.full(x1.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x1 @ beta, -35, 35)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _feature_rows(model, with_score: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch, texts in chunks(batches, 0):
            f = m.features(texts)
            rest = {batch.schema.field(i).name: batch.column(i) for i in range(1, batch.num_columns)}
            if with_score:
                s = m.score(f)
                more = {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}
            else:
                more = {f"f{k}": pa.array(f[:, k]) for k in range(f.shape[1])}
            yield pa.RecordBatch.from_pydict(rest | more)

    return run


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    discount: float = 0.75,
    fit_rows: int = 20_000,
    flush_words: int = 400_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Trained on labelled rows whose crc32(id) is not a multiple of 5: the regression on the first
    ``fit_rows`` of those with remainder 4, by a hash of the id; the counts come from all others.
    """
    spark = docs.sparkSession
    part = F.crc32(F.col("i").cast("string")) % 5
    d = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.col("i").isNotNull() & (part != 0))
    y = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("y is not null and i is not null").where(part != 0)
    y = y.groupBy("i").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    # Labels grow with the corpus, so the join is planned for that at every size.
    rows = d.join(y.hint("merge"), "i").select("text", "y", "i")
    order = F.xxhash64("i")
    # The ids alone tell where the rows of the regression end: in order of (hash, id), behind the last one.
    first = d.select("i").join(y.select("i").hint("merge"), "i").where(part == 4).select(order.alias("h"), "i").orderBy("h", "i").limit(fit_rows)
    last = first.agg(F.max(F.struct("h", "i")).alias("last"), F.count(F.lit(1)).alias("n")).first()
    fits = part == 4
    if last["n"] >= fit_rows:
        h, i = (last["last"]["h"], last["last"]["i"]) if last["last"] else (-(1 << 63), None)
        fits = fits & ((order < F.lit(h)) | ((order == F.lit(h)) & (F.col("i") <= F.lit(i))))
    counted = rows.where(~F.coalesce(fits, F.lit(False))).select("text", "y").mapInArrow(_class_grams(flush_words), "gram string, c0 long, c1 long")
    grams = counted.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).persist()
    try:
        seen = grams.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1")).first()
        if seen["n0"] and seen["n1"]:
            gram_ratio, context_ratio = _tables(grams, discount)
        else:
            gram_ratio, context_ratio = _empty(), _empty()
    finally:
        grams.unpersist()
    raw = ToxicityModel(gram_ratio, context_ratio, np.zeros(4), np.zeros(3), np.ones(3))
    held = (
        rows.where(fits)
        .mapInArrow(_feature_rows(spark.sparkContext.broadcast(raw), False), "y int, i long, f0 double, f1 double, f2 double")
        .orderBy(F.xxhash64("i"), "i")
        .limit(fit_rows)
        .toPandas()
    )
    x, label = held[["f0", "f1", "f2"]].to_numpy(dtype=float), held["y"].to_numpy(dtype=float)
    if len(x) and 0 < label.sum() < len(label):
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        beta = _logistic((x - centre) / scale, label)
    else:
        centre, scale = np.zeros(3), np.ones(3)
        beta = np.zeros(4)
        beta[0] = np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5 + (len(label) == 0)))
    return ToxicityModel(gram_ratio, context_ratio, beta, centre, scale)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id")).mapInArrow(
        _feature_rows(shared, True), "doc_id long, score double, predicted int"
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below the threshold; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in chunks(batches, at):
            yield batch.filter(pa.array(m.score(m.features(texts)) < threshold))

    return docs.mapInArrow(run, docs.schema)
