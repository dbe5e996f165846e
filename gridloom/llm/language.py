"""Language identification by nearest centroid of TF-IDF character n-grams.

A text is the sequence of its lower-case letters with one space for whatever else; its
features are counts of letter pairs and triples, hashed into ``dims`` cells, as
log(1 + count) times idf, at unit length. Each language has up to ``per_lang`` centroids from
spherical k-means; a text takes the language of the centroid with the largest cosine, which
is its score. A text farther from that centroid than any but the farthest of its training
rows is marked as rejected.

Document frequencies cover every training row. The centroids are fitted on at most
``sample_rows`` rows, dealt evenly to the languages and chosen by a hash of the id.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0, and
so is every text where nothing could be learned; rows with null lang teach nothing; repeated
rows are predicted as often as they occur; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectext import chunks, codes_of, is_letter, mix64, pieces

DIMS = 4096
_PART = 256


def gram_counts(texts: list[str], dims: int) -> Iterator[np.ndarray]:
    """Count matrices, ``_PART`` texts at a time; a longer text is counted in pieces."""
    for lo in range(0, len(texts), _PART):
        part = texts[lo : lo + _PART]
        out = np.zeros((len(part), dims), dtype=np.int64)
        for some, owners in pieces(part):
            np.add.at(out, owners, _piece_counts(some, dims))
        yield out


def _piece_counts(texts: list[str], dims: int) -> np.ndarray:
    """Counts of pairs and triples; a gram belongs to the text of its middle letter."""
    codes, starts = codes_of(texts)
    letter = is_letter(codes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator behind each run of letters
    keep[0] = True
    at = np.flatnonzero(keep)
    c = np.where(letter[at], codes[at], np.uint32(32)).astype(np.uint64)
    middle = np.flatnonzero(c[1:-1] != 32) + 1
    base = (np.searchsorted(starts, at[middle], side="right") - 1) * dims
    triple = (c[middle - 1] * np.uint64(0x100000001B3) + c[middle]) * np.uint64(0x9E3779B97F4A7C15) + c[middle + 1]
    pair = (c[middle - 1] * np.uint64(0xD6E8FEB86659FD93)) ^ (c[middle] + np.uint64(7))
    counts = np.bincount(base + (mix64(triple) % np.uint64(dims)).astype(np.int64), minlength=len(texts) * dims)
    counts += np.bincount(base + (mix64(pair) % np.uint64(dims)).astype(np.int64), minlength=len(texts) * dims)
    return counts.reshape(len(texts), dims)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (centroids, dims), unit rows
    lang_of: np.ndarray
    reach: np.ndarray  # the farthest cosine distance of a training row, by centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts.astype(np.float32)) * self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, scores, rejected = [], [], []
        for counts in gram_counts(texts, len(self.idf)):
            some = counts.any(axis=1)
            if not len(self.langs):
                langs += ["und"] * len(counts)
                scores.append(np.zeros(len(counts)))
                rejected.append(np.ones(len(counts), dtype=bool))
                continue
            cosine = self.vectors(counts) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)
            langs += [self.langs[self.lang_of[b]] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, top, 0.0).astype(float))
            rejected.append(~some | (1.0 - top > self.reach[best]))
        if not langs:
            return [], np.zeros(0), np.zeros(0, dtype=bool)
        return langs, np.concatenate(scores), np.concatenate(rejected)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; the same result on every run."""
    seeds = [_unit(x.mean(axis=0, keepdims=True))[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[(x @ np.stack(seeds).T).max(axis=1).argmin()])
    c = np.stack(seeds)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([_unit(x[near == j].mean(axis=0, keepdims=True))[0] if (near == j).any() else c[j] for j in range(len(c))])
    return c, (x @ c.T).argmax(axis=1)


def _document_frequencies(dims: int):
    schema = pa.schema([("cell", pa.int32()), ("df", pa.int64()), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(dims, dtype=np.int64), 0
        for _, texts in chunks(batches, 0):
            rows += len(texts)
            for counts in gram_counts(texts, dims):
                df += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(df), pa.array(np.where(np.arange(dims) == 0, rows, 0))], schema=schema)

    return run


def _sampled(dims: int):
    schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0):
            at = 0
            for rows in gram_counts(texts, dims):
                part = batch.slice(at, len(rows))
                packed = [np.log1p(r).astype(np.float16).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(packed, pa.binary())], schema=schema)
                at += len(rows)

    return run


def fit_language(
    docs: DataFrame, dims: int = DIMS, per_lang: int = 3, sample_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """Learn from the given rows; choose them (train only) before."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("i")).where("lang is not null and text is not null")
    of_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    idf = np.ones(dims, dtype=np.float32)
    if not of_lang:
        return LanguageModel([], idf, np.zeros((0, dims), dtype=np.float32), np.zeros(0, dtype=int), np.zeros(0))
    found = rows.select("text").mapInArrow(_document_frequencies(dims), "cell int, df long, rows long").groupBy("cell").agg(F.sum("df").alias("df"), F.sum("rows").alias("rows")).toPandas()
    df = np.zeros(dims)
    df[found["cell"].to_numpy()] = found["df"].to_numpy()
    idf = np.log((1.0 + found["rows"].sum()) / (1.0 + df)).astype(np.float32) + np.float32(0.1)
    each = max(1, sample_rows // len(of_lang))
    slot = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("lang")), F.lit(1_000_000))
    wanted = F.lit(False)
    for lang, n in of_lang.items():
        wanted = wanted | ((F.col("lang") == F.lit(lang)) & (slot < int(max(1.0, 1_000_000 * min(1.0, each / n)))))
    drawn = rows.where(wanted).select("text", "lang", F.xxhash64("text", F.col("i").cast("string")).alias("h"))
    sample = drawn.mapInArrow(_sampled(dims), "lang string, h long, v binary").orderBy("h", "lang").limit(2 * sample_rows).toPandas()
    langs, centroids, lang_of, reach = sorted(sample["lang"].unique()), [], [], []
    x = np.stack([np.frombuffer(v, dtype=np.float16) for v in sample["v"]]).astype(np.float32) if len(sample) else np.zeros((0, dims), dtype=np.float32)
    x = _unit(x * idf)
    for j, lang in enumerate(langs):
        own = x[(sample["lang"] == lang).to_numpy()]
        own = own[own.any(axis=1)]
        if not len(own):
            continue
        c, near = _cluster(own, per_lang)
        far = 1.0 - (own * c[near]).sum(axis=1)
        for k in range(len(c)):
            centroids.append(c[k])
            lang_of.append(j)
            reach.append(np.quantile(far[near == k], 0.999) if (near == k).any() else 0.0)
    if not centroids:
        return LanguageModel([], idf, np.zeros((0, dims), dtype=np.float32), np.zeros(0, dtype=int), np.zeros(0))
    return LanguageModel(langs, idf, np.stack(centroids).astype(np.float32), np.array(lang_of), np.array(reach))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in chunks(batches, 0):
            langs, scores, rejected = m.predict(texts)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(1), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores), "rejected": pa.array(rejected)}
            )

    return docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id")).mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )
