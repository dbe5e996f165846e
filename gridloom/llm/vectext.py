"""Texts as NumPy code point arrays: windows, words and hashes without a loop over characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = re.compile(r"\s")
_tables: dict[str, np.ndarray] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _table(kind: str) -> np.ndarray:
    """By code point: whether it is a letter, or a letter or digit."""
    if kind not in _tables:
        test = str.isalpha if kind == "alpha" else str.isalnum
        _tables[kind] = np.fromiter((test(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables[kind]


def is_letter(codes: np.ndarray) -> np.ndarray:
    return _table("alpha")[codes]


def is_word(codes: np.ndarray) -> np.ndarray:
    return _table("alnum")[codes]


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length."""
    whole = text.lower()
    if len(whole) == len(text):
        return whole
    return "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, each behind and before a 0; starts[i] is that of text i.

    ``starts`` has one entry more than there are texts: the position past the last separator.
    """
    joined = "\0" + "".join(lowered(t) + "\0" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.ones(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    starts[1:] += 1
    return codes, starts


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 1_500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``most`` characters each, nulls as empty texts."""
    for batch in batches:
        lo, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            t = batch.column(text_at)[i].as_py() or ""
            texts.append(t)
            size += len(t)
            if size >= most:
                yield batch.slice(lo, i + 1 - lo), texts
                lo, size, texts = i + 1, 0, []
        if texts:
            yield batch.slice(lo, len(texts)), texts


def pieces(texts: list[str], most: int = 500_000) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts in groups of about ``most`` characters, and which text each piece is of.

    A text longer than that is cut behind white space, so no word is cut; what is counted per
    word can be summed over the pieces, and memory does not grow with the longest text.
    """
    parts: list[str] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        lo = 0
        while True:
            hi = len(text)
            if hi - lo > most:
                space = _SPACE.search(text, lo + most)
                hi = space.end() if space else hi
            parts.append(text[lo:hi])
            owners.append(i)
            size += hi - lo
            if size >= most:
                yield parts, np.array(owners)
                parts, owners, size = [], [], 0
            lo = hi
            if lo >= len(text):
                break
    if parts:
        yield parts, np.array(owners)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of letters and digits."""
    flag = is_word(codes).view(np.int8)
    edge = np.diff(flag)
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def word_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: equal words have equal hashes wherever they stand.

    A word's hash is the sum over its letters of a scrambled (letter, place in word) pair.
    """
    if not len(begin):
        return np.empty(0, dtype=np.uint64)
    lengths = end - begin
    first = np.repeat(begin, lengths)
    at = np.arange(len(first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    letters = codes[first + at].astype(np.uint64)
    mixed = mix64((letters << np.uint64(32)) + at.astype(np.uint64) + _MIX)
    return mix64(np.add.reduceat(mixed, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
