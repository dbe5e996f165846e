import functools
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm.mixing import mix_sources, mixed_documents
from gridloom.llm.packing import Encoder, _best_fit, completions, lower_bound, pack_documents, pack_lengths
from gridloom.llm.topk import SortedLists, top_inner_products

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_topk(rows, every, k):
    rows = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, u in dict(rows).items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(u))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 40])
def test_topk_matches_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(200)]
    rows += [(300 + i, rows[i % 5][1]) for i in range(20)] + [(400, None), (401, []), (402, [None] * 8), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, rows[0][1]), (406, [1.0, 2.0]), (408, [3.0, -2.0]), (410, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as score", "4 as block")
    got = sorted(tuple(r) for r in top_inner_products(df, every=2, block=block, query_block=16).collect())
    assert got == brute_topk(rows, 2, 5)
    assert top_inner_products(df.limit(0)).count() == 0


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(0)
    v = rng.integers(-20, 20, (5000, 4))
    v[17] = [900, 0, 0, 0]
    v[99] = [800, 0, 0, 0]
    ids, scores, scored = SortedLists(np.arange(5000), v).top(np.array([5, 0, 0, 0]), -1, 2)
    assert ids.tolist() == [17, 99] and scores.tolist() == [4500, 4000] and scored < 100


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_queries_are_not_copied_to_every_block(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(64)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        got = sorted(tuple(r) for r in top_inner_products(df, every=1, block=10).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute_topk(rows, 1, 5)
    assert shuffled_bytes(spark) - before < 1_000_000  # the vectors themselves are 0.15 MB


@pytest.mark.parametrize("size", [0.4, 2e4, 1e6])
def test_topk_over_cells_with_ties_and_copies(spark, monkeypatch, size):
    monkeypatch.setattr("gridloom.llm.topk.CELL_BYTES", 2000)
    monkeypatch.setattr("gridloom.llm.topk.CELL_PAIRS", 1000)
    rng = random.Random(7)
    rows = [(i, [rng.choice([-size, 0.0, size / 3, rng.uniform(-size, size)]) for _ in range(6)]) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(60)] + [(211, rows[7][1])] * 20 + [(212, rows[8][1])] * 20 + [(i, [0.0] * 6) for i in range(220, 230)] + [(i, [size] * 3) for i in range(230, 240)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(tuple(r) for r in top_inner_products(df, every=2, block=30, query_block=7).collect())
    assert got == brute_topk(rows, 2, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_bins_hold_every_piece(lengths):
    bins = pack_lengths(np.array(lengths, dtype=int), 64, 500)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 64 for b in bins)
    assert len(bins) >= -(-sum(lengths) // 64)


def best_bins(lengths, capacity):
    """The least number of bins, by dynamic programming over subsets."""
    n = len(lengths)
    best = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1)
    for s in range(1, 1 << n):
        for i in range(n):
            if s >> i & 1:
                bins, room = best[s ^ (1 << i)]
                best[s] = min(best[s], (bins, room - lengths[i]) if room >= lengths[i] else (bins + 1, capacity - lengths[i]), key=lambda z: (z[0], -z[1]))
    return best[-1][0]


def test_search_finds_least_bins():
    rng = random.Random(8)
    worse = 0
    for _ in range(60):
        lengths = [rng.randrange(1, 100) for _ in range(rng.randrange(1, 11))]
        found, least = len(pack_lengths(np.array(lengths), 100)), best_bins(lengths, 100)
        assert found >= least
        worse += found > least
    assert worse <= 1


TEXTS = ["", " ", "a  b\n\n c\t", "don't we'll 'S", "Größe № 12,345.67!!!   x", "日本語 テキスト", "<|endoftext|> x", "  \r\n ", "\x00\x01", "é 🙂🙃", "a" * 5000, "e\u0301 \u1680\u2028x"]


def test_ids_are_the_tokenizers_ids():
    plain, coder = Tokenizer.from_file(PATH), Encoder(PATH)
    assert coder.ranked is not None
    every = [f"a{chr(c)} b{chr(c)}{chr(c)}1 {chr(c)}'s" for c in [*range(0x3100), *range(0xA000, 0xA200), *range(0xFB00, 0x10000), *range(0x1F300, 0x1F700)]]
    for t in [*TEXTS, " ".join(TEXTS), *every]:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    plain, coder = _coders()
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@functools.cache
def _coders():
    return Tokenizer.from_file(PATH), Encoder(PATH)


def test_other_files_go_to_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, coder = Tokenizer.from_file(path), Encoder(path)
    assert coder.ranked is None
    assert np.frombuffer(coder.encode("Some words"), "<u4").tolist() == plain.encode("Some words", add_special_tokens=False).ids


def test_packing_round_trip(spark, make_docs):
    rng = random.Random(3)
    texts = [" ".join(f"t{rng.randrange(10**4)}" for _ in range(rng.choice([0, 1, 5, 40, 300, 900]))) for _ in range(120)] + [None, "", "same", "same"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(5, texts[5], "en", "s"), (None, "no id", None, None)]
    df = make_docs(rows).selectExpr("*", "1 as piece", "2 as pack_group", "3 as length")
    got = pack_documents(df, PATH, group_docs=50).toPandas()
    plain = Tokenizer.from_file(PATH)
    want = []
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows_got = [(None if r.doc_id != r.doc_id else int(r.doc_id), int(r.piece), int(r.start), int(r.length), int(r.ids_crc32)) for r in got.itertuples()]
    assert sorted(rows_got, key=repr) == sorted(want, key=repr)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= len(_best_fit(got["length"].to_numpy(), 1024)) + 3
    assert pack_documents(make_docs([]), PATH).count() == 0


def test_equal_rows_spread_over_groups(spark):
    df = spark.createDataFrame([(None, "no id and the same text")] * 3000, "doc_id long, text string").repartition(4)
    long = spark.createDataFrame([(1, "word " * 60_000)], "doc_id long, text string")
    got = pack_documents(df.unionByName(long), PATH, group_docs=100).toPandas()
    partial = got[got["length"] < 1024]
    assert (partial.groupby(partial["sequence_id"] // 2**32).size()).max() < 250
    assert got["sequence_id"].nunique() < got["length"].sum() / 1024 + 35 and (got[got["length"] == 1024]["offset"] == 0).all()
    assert (got.groupby("sequence_id")["length"].sum() <= 1024).all()


def every_filling(free, pieces):
    """Sums and lengths of all maximal fillings that no piece can improve, by brute force."""
    found = set()
    for r in range(len(pieces) + 1):
        for some in set(itertools.combinations(sorted(pieces, reverse=True), r)):
            left = Counter(pieces) - Counter(some)
            if sum(some) > free or any(a <= free - sum(some) for a in left):
                continue
            if not any(left[sum(part)] for k in range(2, r + 1) for part in itertools.combinations(some, k)):
                found.add(some)
    if any(f == (free,) for f in found):
        return {(free,)}
    return found


def test_completions_are_all_undominated_fillings():
    rng = random.Random(4)
    for _ in range(150):
        pieces = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 9))]
        free = rng.randrange(1, 80)
        got = list(completions(free, sorted(set(pieces)), Counter(pieces)))
        assert len(got) == len(set(got)) and set(got) == every_filling(free, pieces)
        assert [free - sum(f) for f in got] == sorted(free - sum(f) for f in got)
    assert next(completions(40, [10], {10: 6})) == (10, 10, 10, 10)


def test_full_bins_of_many_pieces_are_found():
    rng = random.Random(3)
    better = 0
    for _ in range(25):
        lengths = []
        for _ in range(2):
            cuts = sorted(rng.sample(range(1, 1024), rng.choice([5, 6])))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 1024])]
        found = len(pack_lengths(np.array(lengths), 1024))
        better += found < len(_best_fit(np.array(lengths), 1024))
        assert found == 2
    assert better > 10


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_lower_bound_holds(lengths):
    assert -(-sum(lengths) // 30) <= lower_bound(np.array(lengths, dtype=int), 30) <= best_bins(lengths, 30)


def test_mix_meets_targets(spark, make_docs):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "b", "c", None, "Z", "é"]) if i > 3 else "tiny"
        rows.append((i, " ".join("word" for _ in range(rng.randrange(0, 40))), "en", source))
    rows += [(5007, "twice here", "en", "b"), (5007, "twice here", "en", "b"), (None, "no id", "en", "b"), (999, None, "en", "nul"), (998, "", "en", "nul")]
    df = make_docs(rows).selectExpr("*", "1 as size", "2 as target", "3 as key", "4 as grp", "5 as offset")
    rated = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(6, 1), (None, 0)], "doc_id long, quality int")
    out = mix_sources(df, rated, slice_rows=30).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, mix_sources(df.repartition(7), rated, slice_rows=1000).collect()))
    source = {i: s for i, _, _, s in rows}
    words = {i: len((t or "").split()) for i, t, _, _ in rows}
    assert all(r.taken <= 3 * r["size"] and r["size"] == words[r.doc_id] for r in out)
    copies = Counter(r.doc_id for r in mixed_documents(df, rated, slice_rows=50).collect())
    assert copies == Counter({r.doc_id: 0 for r in out}) + sum((Counter({r.doc_id: r.epochs}) for r in out), Counter())
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {s: sum(r["size"] for r in out if source[r.doc_id] == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total, target, full = sum(size.values()), {}, set()
    while True:
        left = total - sum(3 * size[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources if s not in full}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * size[s] if s in full else share[s] for s in sources}
    for s in sources:
        own = [r for r in out if source[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= max([r["size"] for r in own]) / 2 + 1e-6
        assert len({r.epochs for r in own}) <= 2
    assert mix_sources(make_docs([])).count() == 0 and mixed_documents(make_docs([])).count() == 0


def test_better_documents_are_taken_first(spark, make_docs):
    rows = [(i, "some words of equal number here", "en", "a" if i < 800 else "b") for i in range(1000)]
    rated = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(1000)], "doc_id long, quality int")
    took = {r.doc_id: r.epochs for r in mix_sources(make_docs(rows), rated, weights=(1, 3)).collect() if r.doc_id < 800}
    good, bad = (sum(took[i] for i in took if i % 2 == k) for k in (0, 1))
    assert set(took.values()) == {0, 1} and good > 1.8 * bad > 0


def test_equal_rows_spread_over_slices(spark, make_docs):
    rows = [(None, "same words", "en", "a")] * 500 + [(3, "same id", "en", "a")] * 500 + [(i, "no_spaces_at_all" * 9, "en", "a") for i in range(10, 510)]
    docs = make_docs(rows)
    out = mix_sources(docs, weights=(1,), slice_rows=100).collect()
    assert len(out) == 1500 and all(r.epochs == 1 for r in out) and {r.target for r in out} == {2500.0}
    assert mixed_documents(docs, weights=(1,), slice_rows=100).count() == 1500
    two = make_docs([*rows, *[(i, "word " * 500, "en", "b") for i in range(1000, 1002)]])
    for rows_of in (50, 10**6):
        mixed = mix_sources(two, slice_rows=rows_of)
        taken, target, size = mixed.where("source_size = 2500").selectExpr("sum(taken)", "max(target)", "max(size)").first()
        assert abs(taken - target) <= size / 2
        assert mixed_documents(two, slice_rows=rows_of).count() == mixed.agg({"epochs": "sum"}).first()[0]
