"""Line deduplication with a log-template tree.

A line is its lower-case tokens between white space; a token with a digit is a variable
field, but in lines of fewer than ``SHORT`` tokens, or with digits in more than half of them (rows
of numbers), which only share a template when they are equal. The tree has fixed depth: token count, then ``depth`` leading tokens. Lines that reach
one leaf are merged into a template where at least ``similarity`` of their tokens agree, the
others becoming variable fields, too. A template that recurs in ``min_docs`` different texts
is dropped, but for the document with the smallest doc_id, which keeps its lines. Copies of a
text count as one, so a copied document does not turn its own lines into templates. Documents
are told apart by doc_id and text.

A leaf of up to ``leaf_lines`` distinct lines is merged in one task. A larger one is dealt to
parts of about that size, which are folded to templates in parallel; the templates of ``FAN``
parts are merged by the same rule, round by round, until the leaf has one list of templates.
No line is left out at any size. A line joins, of the templates that keep their constant part
with it, the one it agrees with most; lines too short to vary in a token, or with too many
variable fields, can only equal others and are not sent to leaves.

Defined results: lines of fewer than ``min_tokens`` tokens stay, by default only those without
any; a null text stays null; rows without an id, or with a repeated one, are documents of their
own if their texts differ, those without an id last; an empty table gives
an empty result; columns of the input are returned as they are, whatever their names, but for
the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import _runs
from .staging import Stage
from .vectext import chunks, codes_of, mix64, word_hashes

_VARIABLE = np.uint64(0x5EED5EED5EED5EED)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Lines of fewer tokens have no variable fields.
SHORT = 3
#: Parts of a leaf whose templates are merged in one task of a round.
FAN = 8


def _last():
    """What stands for a missing id where documents are ordered."""
    return F.lit((1 << 63) - 1)


class Lines:
    """The lines of some texts with at least ``min_tokens`` tokens: token hashes and line keys."""

    def __init__(self, texts: list[str], min_tokens: int, depth: int, similarity: float = 0.85) -> None:
        codes, starts = codes_of(texts)
        space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 0)
        edge = np.diff((~space).view(np.int8))
        begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        tokens = word_hashes(codes, begin, end)
        digits = np.add.reduceat((codes >= 48) & (codes <= 57), begin) if len(begin) else np.zeros(0, dtype=int)
        stop = codes == 10
        stop[starts[1:] - 1] = stop[0] = True
        ends = np.flatnonzero(stop)  # a line ends before each of these
        line = np.searchsorted(ends, begin)
        change = np.flatnonzero(np.diff(line, prepend=-1))
        count = np.diff(np.append(change, len(line)))
        varies = np.asarray(digits, dtype=np.int64) > 0
        if len(change):
            # A line that would be mostly variable has no constant part to share: it stands as it is.
            shares = (count >= SHORT) & (2 * np.add.reduceat(varies, change, dtype=np.int64) <= count)
            tokens[varies & np.repeat(shares, count)] = _VARIABLE
        at = np.arange(len(line)) - np.repeat(change, count)
        placed = mix64(tokens + at.astype(np.uint64) * _STEP)
        size = mix64(count.astype(np.uint64))
        self.key = mix64(np.add.reduceat(placed, change) ^ size).view(np.int64) if len(change) else np.zeros(0, dtype=np.int64)

        part = np.where(at < depth, placed, np.uint64(0))
        self.leaf = mix64((np.add.reduceat(part, change) + _STEP) ^ size).view(np.int64) if len(change) else np.zeros(0, dtype=np.int64)
        variable = np.add.reduceat(tokens == _VARIABLE, change, dtype=np.int64) if len(change) else np.zeros(0, dtype=np.int64)
        self.merges = (count - np.maximum(variable, 1)) / count >= similarity  # can share a template with another line
        self.owner = np.searchsorted(starts, begin[change], side="right") - 1
        first_line = np.searchsorted(ends, starts[:-1])
        self.number = line[change] - first_line[self.owner]  # which line of its text
        self.enough = count >= min_tokens
        self.change, self.count, self.tokens = change, count, tokens


def _line_keys(min_tokens: int, depth: int, similarity: float):
    """The lines of each text; the leaf is null where a line can only equal others."""
    schema = pa.schema([("id", pa.int64()), ("content", pa.int64()), ("line", pa.int64()), ("leaf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0):
            lines = Lines(texts, min_tokens, depth, similarity)
            _, once = np.unique(np.stack([lines.owner, lines.key]), axis=1, return_index=True)
            once = once[lines.enough[once]]
            owner = lines.owner[once]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array(lines.key[once]), pa.array(lines.leaf[once], mask=~lines.merges[once])],
                schema=schema,
            )

    return run


_DEALT = [("leaf", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("line", pa.int64())]


def _line_tokens(min_tokens: int, depth: int):
    """(leaf, part, parts, line, tokens) of the wanted lines of each joined document."""
    schema = pa.schema([*_DEALT, ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0):
            wanted = [{w["line"]: (w["leaf"], w["part"], w["parts"]) for w in ws} for ws in batch.column(1).to_pylist()]
            lines = Lines(texts, min_tokens, depth)
            rows = {}
            for i, (key, owner) in enumerate(zip(lines.key.tolist(), lines.owner.tolist(), strict=True)):
                if key in wanted[owner]:
                    lo = lines.change[i]
                    rows[key] = (*wanted[owner][key], key, lines.tokens[lo : lo + lines.count[i]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v[c] for v in rows.values()], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def fold(rows: list[np.ndarray], similarity: float) -> tuple[list[int], np.ndarray]:
    """The template number of each line, or template, in the order given, and the templates.

    Two that can share a template agree, without a variable field, in at least one of as many
    groups of columns as it may have variable fields, and one; only those are compared.
    """
    lines = np.stack(rows)
    n, k = lines.shape
    spare = int(np.flatnonzero((k - np.arange(k + 1)) / k >= similarity)[-1])  # variable fields of a template
    varies = (lines != lines[0]).any(axis=0)
    left = spare - int((lines[0][~varies] == _VARIABLE).sum())
    if left < 0:
        return list(range(n)), lines
    groups = np.array_split(np.flatnonzero(varies), left + 1)
    places = mix64(lines + np.arange(k, dtype=np.uint64) * _STEP)
    hashes = [mix64(places[:, g].sum(axis=1, dtype=np.uint64)).tolist() for g in groups]
    clean = [(lines[:, g] != _VARIABLE).all(axis=1).tolist() for g in groups]
    held: list[dict[int, list[int]]] = [{} for _ in groups]
    templates, count, out = lines.copy(), 0, []
    for i, line in enumerate(lines):
        keys = [(by, h[i]) for by, h, c in zip(held, hashes, clean, strict=True) if c[i]]
        near = np.array(sorted({t for by, h in keys for t in by.get(h, ())}), dtype=np.int64)
        if len(near):
            some = templates[near]
            agree = (some == line) | (some == _VARIABLE)
            fits = ((some != line) | (some == _VARIABLE)).sum(axis=1) <= spare  # a template may not lose its constant part
            best = int(np.where(fits, agree.sum(axis=1), -1).argmax())
            if fits[best]:
                templates[near[best]] = np.where(some[best] == line, line, _VARIABLE)
                out.append(int(near[best]))
                continue
        templates[count] = line
        for by, h in keys:
            by.setdefault(h, []).append(count)
        out.append(count)
        count += 1
    return out, templates[:count]


def merge_leaf(rows: list[np.ndarray], similarity: float) -> list[int]:
    """The template number of each line of a leaf, in the order given."""
    return fold(rows, similarity)[0]


def _merge(similarity: float):
    """The template of each line of a part; of a leaf in several parts, its tokens with its first line."""
    schema = pa.schema([*_DEALT, ("template", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (leaf, part, parts), (line, tokens) in _runs(batches, 3):
            rows = dict(sorted(zip(line, tokens, strict=True)))
            number, templates = fold([np.frombuffer(t, dtype=np.uint64) for t in rows.values()], similarity)
            head: dict[int, int] = {}
            for k, n in zip(rows, number, strict=True):
                first = n not in head
                out.append((leaf, part, parts, k, head.setdefault(n, k), templates[n].tobytes() if first and parts > 1 else None))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _strip(min_tokens: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, 0):
            gone = [set(g) if g else None for g in batch.column(1).to_pylist()]
            kept: list[str | None] = batch.column(0).to_pylist()
            dropped = [0] * len(texts)
            some = [i for i, g in enumerate(gone) if g]
            if some:
                lines = Lines([texts[i] for i in some], min_tokens, depth)
                drop: dict[int, set[int]] = {}
                for j, number, key, enough in zip(lines.owner.tolist(), lines.number.tolist(), lines.key.tolist(), lines.enough.tolist(), strict=True):
                    if enough and key in gone[some[j]]:
                        drop.setdefault(some[j], set()).add(number)
                for i, numbers in drop.items():
                    kept[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in numbers)
                    dropped[i] = len(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32()), pa.array(dropped, pa.int32()), batch.column(2)],
                names=["text", "n_lines", "n_dropped", "row"],
            )

    return run


def recurring_lines(
    docs: DataFrame, stage: Stage, min_docs: int, depth: int, similarity: float, min_tokens: int, leaf_lines: int, id_col: str, text_col: str
) -> DataFrame:
    """(id, content, lines): the keys of the lines each document loses."""
    d = _documents(docs, id_col, text_col)
    keyed = stage.table(
        d.mapInArrow(
            _line_keys(min_tokens, depth, similarity), "id long, content long, line long, leaf long"
        )
    )
    # Distinct texts per line: copies fold before anything is counted.
    once = keyed.groupBy("line", "leaf", "content").agg(F.min(F.coalesce("id", _last())).alias("id"))
    lines = stage.table(once.groupBy("line", "leaf").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("id", "content")).alias("first")))
    # Leaves that several lines reach and whose lines could together recur often enough.
    reached = lines.where("leaf is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("texts").alias("texts"))
    rich = stage.table(reached.where((F.col("n") > 1) & (F.col("texts") >= min_docs)).select("leaf", F.ceil(F.col("n") / leaf_lines).cast("int").alias("parts")))
    crowded = stage.table(lines.join(rich, "leaf").select("line", "first", "leaf", F.pmod("line", "parts").cast("int").alias("part"), "parts"))
    wanted = stage.table(crowded.groupBy("first").agg(F.collect_list(F.struct("line", "leaf", "part", "parts")).alias("wanted")))
    # The lines of crowded leaves grow with the corpus, so the join is planned for that at every size.
    at = (d["content"] == wanted["first.content"]) & (F.coalesce(d["id"], _last()) == wanted["first.id"])
    tokens = d.join(wanted.hint("merge"), at).select("text", "wanted").mapInArrow(
        _line_tokens(min_tokens, depth), "leaf long, part int, parts int, line long, tokens binary"
    )

    def templates(dealt: DataFrame) -> DataFrame:
        ordered = dealt.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "line")
        return stage.table(ordered.mapInArrow(_merge(similarity), "leaf long, part int, parts int, line long, template long, tokens binary"))

    level = templates(tokens)
    merged = level.select("line", "template")
    parts = rich.agg(F.max("parts")).first()[0] or 1
    while parts > 1:
        heads = level.where("parts > 1 and tokens is not null")
        level = templates(heads.select("leaf", F.floor(F.col("part") / FAN).cast("int").alias("part"), F.ceil(F.col("parts") / FAN).cast("int").alias("parts"), "line", "tokens"))
        higher = level.select(F.col("line").alias("template"), F.col("template").alias("higher"))
        merged = stage.table(merged.join(higher, "template", "left").select("line", F.coalesce("higher", "template").alias("template")))
        parts = -(-parts // FAN)
    # A line that shares a template counts with it; any other is its own template.
    shared = merged.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("template")
    grouped = stage.table(merged.join(shared, "template"))
    texts_of = keyed.join(grouped, "line").select("template", "content", F.coalesce("id", _last()).alias("id"))
    often = (
        texts_of.groupBy("template", "content").agg(F.min("id").alias("id"))
        .groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("id", "content")).alias("first"))
        .where(F.col("texts") >= min_docs)
    )
    by_template = grouped.join(often, "template").select("line", "first")
    alone = lines.where(F.col("texts") >= min_docs).join(grouped.select("line"), "line", "left_anti").select("line", "first")
    dropped = stage.table(by_template.unionByName(alone))
    keeps = (F.coalesce("id", _last()) == F.col("first.id")) & (F.col("content") == F.col("first.content"))
    return keyed.join(dropped, "line").where(~keeps).groupBy("id", "content").agg(F.collect_set("line").alias("lines"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, id, content) of every row; the content is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(text.alias("text"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("content"))


def drop_recurring_lines(
    docs: DataFrame,
    min_docs: int = 5,
    depth: int = 4,
    similarity: float = 0.85,
    min_tokens: int = 1,
    leaf_lines: int = 250,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(text, n_lines, n_dropped, row): what is left of each text, and the whole input row."""
    stage = Stage(docs.sparkSession, "line-templates")
    gone = stage.table(recurring_lines(docs, stage, min_docs, depth, similarity, min_tokens, leaf_lines, id_col, text_col))
    rest = [F.col(c) for c in docs.columns if c != text_col]
    content = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    whole = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("key_id"), content.alias("key_content"), F.struct(*rest).alias("row"))
    # What documents lose grows with the corpus, so the join is planned for that at every size.
    at = (whole["key_content"] == gone["content"]) & whole["key_id"].eqNullSafe(gone["id"])
    marked = whole.join(gone.hint("merge"), at, "left").select("text", "lines", "row")
    schema = T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_dropped", T.IntegerType()), T.StructField("row", marked.schema["row"].dataType)]
    )
    return marked.mapInArrow(_strip(min_tokens, depth), schema)
