"""Best-fit packing of tokenised documents by bin completion with branch and bound.

A document is its token ids followed by the end token. One longer than the capacity is cut
into full pieces behind a first piece that holds the remainder, so it never leaves more than
one partial piece. All pieces are dealt, by a hash of the document, its task, its number among
equal rows and the piece, into independent groups of about ``group_docs`` documents, so equal
rows spread like any others. Full pieces are sequences of their own and only pass through;
the partial ones of a group are packed in one task of bounded size.

Packing works on the count of pieces of each length. The longest open piece is completed by
every undominated filling of what it leaves, of any number of pieces, made one at a time and
least waste first; branches whose waste rules out fewer bins than the incumbent are cut, as is
the search once the incumbent meets the lower bound. Best-fit decreasing and dives, which take
of the fillings near the least waste the one with fewest pieces, give the incumbents. The steps
of the search in a group are bounded; what it has found by then is a whole packing.

Defined results: a null text is the empty text and gives one piece that holds the end token;
repeated rows are packed as often as they occur; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import json
import math
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_loaded: dict[str, Encoder] = {}


def _bytes_of_letters() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as letters: printable ones as themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that a tokenizer file gives, without special tokens added.

    A byte-level file whose merges are in the order of their ids says the same as a table of
    ranks, and encoding by ranks is three times as fast; any other file, and any text that
    holds one of the file's special tokens, is left to the file's own library. The two are
    compared on a sample when a file is loaded.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._by_ranks(json.loads(Path(path).read_text(encoding="utf-8")))

    def _by_ranks(self, file: dict):
        import tiktoken

        model, split = file["model"], file.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        vocabulary = model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(vocabulary.get(m) != 256 + i for i, m in enumerate(merged)):
            return None
        letters = _bytes_of_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        made = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sample = "It's 3 o'clock,\n\n  Größe №12\t日本語  🙂 \x1c\x85\u200b end  "
        return made if made.encode_ordinary(sample) == self.tokenizer.encode(sample, add_special_tokens=False).ids else None

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.ranked is None or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return array("I", ids).tobytes()


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def reachable(free: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """Bit s of entry i: whether pieces among the i shortest lengths can sum to s, up to ``free``."""
    whole = (1 << (free + 1)) - 1
    masks = [1]
    for a in lengths:
        mask, left, some = masks[-1], min(counts[a], free // a), 1
        while left:
            take = min(some, left)
            mask |= (mask << (take * a)) & whole
            left -= take
            some *= 2
        masks.append(mask)
    return masks


class _Fillings:
    """Undominated fillings of one bin, or as many as are found within the choices that ``left`` holds."""

    def __init__(self, free: int, lengths: list[int], counts: dict[int, int], left: list[float]) -> None:
        self.free, self.lengths, self.counts, self.left = free, lengths, counts, left
        self.masks = reachable(free, lengths, counts)
        self.open = sum(1 << a for a in lengths)
        self.used: Counter = Counter()

    def of(self, total: int, i: int, one: int, more: int) -> Iterator[tuple[int, ...]]:
        """Sets of pieces among the i shortest lengths that sum to ``total``, longest pieces first.

        ``one`` and ``more`` have the sums of one, and of two or more, of the pieces chosen so far as bits.
        """
        if not total:
            yield ()
            return
        while i and self.masks[i] >> total & 1:
            i -= 1
            a = self.lengths[i]
            for c in range(min(self.counts[a], total // a), 0, -1):
                self.left[0] -= 1
                if self.left[0] < 0:
                    return
                if not self.masks[i] >> (total - c * a) & 1:
                    continue
                now, sums = one, more
                for _ in range(c):
                    sums |= (now | sums) << a
                    now |= 1 << a
                self.used[a] += c
                if not self._replaced(sums):
                    for rest in self.of(total - c * a, i, now, sums):
                        yield (a,) * c + rest
                self.used[a] -= c

    def _replaced(self, sums: int) -> bool:
        """Whether a piece that is left could stand for several of those chosen."""
        sums &= self.open
        while sums:
            total = sums.bit_length() - 1
            if self.counts[total] > self.used[total]:
                return True
            sums ^= 1 << total
        return False

    def largest(self, waste: int) -> Iterator[tuple[int, ...]]:
        """Those that waste so much, without room for any piece that is left."""
        for filling in self.of(self.free - waste, len(self.lengths), 0, 0):
            number = Counter(filling)
            if next((a for a in self.lengths if self.counts[a] > number[a]), waste + 1) > waste:
                yield filling


def completions(
    free: int, lengths: list[int], counts: dict[int, int], most_waste: int | None = None, left: list[float] | None = None
) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``free``, least waste first; fewer if ``left``, a number of choices that is counted down, ends.

    A piece that could stand for several of a filling's pieces dominates it, since the shorter
    ones can replace it later; so does any larger filling of the same pieces. A single piece
    that fits exactly dominates all others.
    """
    hi = bisect.bisect_right(lengths, free)
    if not hi:
        if most_waste is None or free <= most_waste:
            yield ()
        return
    if lengths[hi - 1] == free:
        yield (free,)
        return
    # Two pieces that fill the room can only be replaced by one, and there is none.
    for a in reversed(lengths[bisect.bisect_left(lengths, (free + 1) // 2) : hi]):
        if counts.get(free - a, 0) > (2 * a == free):
            yield (a, free - a)
    left = [math.inf] if left is None else left
    found = _Fillings(free, lengths[:hi], counts, left)
    for waste in range(min(free, free if most_waste is None else most_waste) + 1):
        if found.masks[-1] >> (free - waste) & 1:
            yield from (f for f in found.largest(waste) if waste or len(f) != 2)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: of all splits into long, middling and short pieces, the best bound.

    Pieces over half need a bin each; those longer than the capacity less ``k`` leave no room
    for any piece of ``k`` or more, and what the others of them leave must hold all middling pieces.
    """
    if not len(lengths):
        return 0
    number = np.bincount(lengths, minlength=capacity + 1)
    upto, length = np.cumsum(number), np.cumsum(number * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    long = upto[capacity] - upto[capacity - k]
    wide = upto[capacity - k] - upto[half]
    room = wide * capacity - (length[capacity - k] - length[half])
    middling = length[half] - np.where(k > 0, length[np.maximum(k - 1, 0)], 0)
    return int((long + wide + np.maximum(0, -(-(middling - room) // capacity))).max())


def _best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing on lengths alone: the first incumbent."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for n in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([n])
            bisect.insort(room, (capacity - n, len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(n)
            if free > n:
                bisect.insort(room, (free - n, b))
    return bins


def _dive(lengths: list[int], counts: dict[int, int], capacity: int, slack: int) -> list[list[int]]:
    """One path to the bottom: of the fillings within ``slack`` of the least waste, that of fewest pieces.

    A little waste at the long pieces saves the short ones, which the middling pieces need.
    """
    alive, counts = list(lengths), dict(counts)

    def take(n: int) -> None:
        counts[n] -= 1
        if not counts[n]:
            alive.pop(bisect.bisect_left(alive, n))

    bins = []
    while alive:
        longest = alive[-1]
        take(longest)
        free = capacity - longest
        at = bisect.bisect_right(alive, free)
        if at and free - alive[at - 1] <= slack:
            filling: tuple[int, ...] = (alive[at - 1],)
        else:
            fillings = completions(free, alive, counts, None, [5_000])
            found = [next(fillings, (alive[at - 1],) if at else ())]
            most = sum(found[0])
            if len(found[0]) != 2 or most < free:
                found += itertools.islice(fillings, 5)
            filling = min((f for f in found if most - sum(f) <= slack), key=lambda f: (len(f), -sum(f)))
        for n in filling:
            take(n)
        bins.append([longest, *filling])
    return bins


def pack_lengths(lengths: np.ndarray, capacity: int, nodes: int = 2_000, slacks: tuple[int, ...] = (1, 2, 4), choices: int = 300_000) -> list[list[int]]:
    """Bins (lists of lengths) as few as the search finds within one dive, ``nodes`` completions and ``choices`` pieces tried.

    Best-fit decreasing and dives with some slack give the incumbent of the exact search.
    """
    total = int(lengths.sum())
    floor = lower_bound(lengths, capacity)
    best = _best_fit(lengths, capacity)
    if len(best) <= floor or not len(lengths):
        return best
    values, numbers = np.unique(lengths, return_counts=True)
    counts = dict(zip(values.tolist(), numbers.tolist(), strict=True))
    alive = values.tolist()
    for slack in slacks:
        found = _dive(alive, counts, capacity, slack)
        if len(found) < len(best):
            best = found
        if len(best) <= floor:
            return best

    def take(n: int) -> None:
        counts[n] -= 1
        if not counts[n]:
            alive.pop(bisect.bisect_left(alive, n))

    def put(n: int) -> None:
        if not counts[n]:
            bisect.insort(alive, n)
        counts[n] += 1

    # Depth first without recursion. A frame is a bin and which of its fillings it is; coming
    # back to it, the fillings are made again up to there, so that a frame stays small.
    frames: list[tuple[list[int], int]] = []
    waste, spent, tried, left = 0, 0, 0, [float(choices)]
    while True:
        longest = alive[-1]
        take(longest)
        allowed = (len(best) - 1) * capacity - total - waste  # waste that still saves a bin
        filling = next(itertools.islice(completions(capacity - longest, alive, counts, allowed, left), tried, None), None) if allowed >= 0 else None
        spent += 1
        if filling is not None:
            for n in filling:
                take(n)
            frames.append(([longest, *filling], tried))
            waste += capacity - longest - sum(filling)
            tried = 0
            if alive:
                continue
            best = [b for b, _ in frames]
            if len(best) <= floor:
                break
        else:
            put(longest)
        if spent >= nodes + len(best) or left[0] < 0 or not frames:
            break
        bin_, tried = frames.pop()
        tried += 1
        waste -= capacity - sum(bin_)
        for n in bin_:
            put(n)
    return best


_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, pack_group long"
_PACKED = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pieces(tokenizer_path: str, end_id: int, capacity: int, groups: int):
    """Rows of every piece and its group. Equal rows of a task are numbered, in whatever order they come."""
    arrow = pa.schema([*list(_PACKED)[:5], ("pack_group", pa.int64())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        again: Counter = Counter()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                row = (doc_id, zlib.crc32(ids))
                again[row] += 1
                view = memoryview(ids)
                start = 0
                for piece in range(-(-n // capacity)):
                    length = first if piece == 0 else capacity
                    group = zlib.crc32(f"{row}:{again[row]}:{task}:{piece}".encode()) % groups
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), group), strict=True):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return run


def _pack_sorted(capacity: int, nodes: int):
    """Rows come sorted by group: full pieces pass through, the others are packed group by group."""

    def packed(group: int, rows: pd.DataFrame) -> pa.RecordBatch:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        lengths = rows["length"].to_numpy()
        where: dict[int, list[int]] = {}
        for i in range(len(rows) - 1, -1, -1):
            where.setdefault(int(lengths[i]), []).append(i)
        for b, members in enumerate(pack_lengths(lengths, capacity, nodes)):
            at = 0
            for length in members:
                i = where[length].pop()
                sequence[i], offset[i] = b, at
                at += length
        rows["sequence_id"], rows["offset"] = group * (1 << 32) + sequence, offset
        return pa.RecordBatch.from_pandas(rows[_PACKED.names], schema=_PACKED, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        current, full = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            rows = rows.astype({"length": "int64", "pack_group": "int64"})
            for group, part in rows.groupby("pack_group", sort=False):
                if group != current:
                    if held:
                        yield packed(current, pd.concat(held))
                    held, current, full = [], int(group), 0
                whole = part["length"] >= capacity
                if whole.any():
                    out = part[whole].copy()
                    out["sequence_id"] = current * (1 << 32) + (1 << 31) + full + np.arange(len(out))
                    out["offset"] = 0
                    full += len(out)
                    yield pa.RecordBatch.from_pandas(out[_PACKED.names], schema=_PACKED, preserve_index=False)
                if not whole.all():
                    held.append(part[~whole])
        if held:
            yield packed(current, pd.concat(held))

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 1024,
    group_docs: int = 8192,
    nodes: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each group leaves at most about one bin that a single packing of everything could have
    saved, one in several thousand.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    groups = max(1, math.ceil(docs.count() / group_docs))
    return (
        chosen.mapInArrow(_pieces(tokenizer_path, end_id, capacity, groups), _PIECE_SCHEMA)
        .repartition("pack_group")
        .sortWithinPartitions("pack_group")
        .mapInArrow(_pack_sorted(capacity, nodes), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
