import random
import re

import numpy as np
import pytest

from gridloom.llm import similarity
from gridloom.llm.components import connected_components
from gridloom.llm import forest
from gridloom.llm.ngram_join import keep_one_of_each, similar_documents
from gridloom.llm.paragraph_dedup import band_count, cut_text, dedup_paragraphs
from gridloom.llm.staging import Stage


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def classes(sets, ids, threshold=0.8):
    """Brute force: (id, class, size, links) of every row."""
    n = len(sets)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return sorted((ids[i], min(ids[j] for j in g), len(g), links[i]) for g in groups.values() for i in g)


def test_shingles_equal_by_words_only():
    a, b, c, d = similarity.shingle_sets(["One two, three four five six!", "one TWO three  four five six", "one two", ""], 5)
    assert a.tolist() == b.tolist() and len(a) == 2 and len(c) == 1 and len(d) == 0
    assert similarity.node_ids([a, c])[0] == similarity.node_ids([b])[0]


def test_common_counts_dense_and_sparse():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 3, 500, 6000, 7000, 8000)]
    want = [[len(np.intersect1d(x, y)) for y in sets[2:]] for x in sets]
    assert similarity.common_counts(sets, sets[2:]).tolist() == want


def test_depth_and_bands_reach_their_recall():
    assert forest.guaranteed(12, 3, 0.8) >= 0.998 > forest.guaranteed(12, 5, 0.8)
    assert 1 - (1 - 0.8**4) ** band_count(4, 0.8, 0.995) >= 0.995


def test_prefixes_are_shortened_where_that_is_cheap():
    sizes = np.ones((3, 12, 3), dtype=np.int64)
    sizes[1] = np.array([500, 400, 300])  # crowded in every tree
    sizes[2, :6] = np.array([500, 400, 300])  # crowded in half of them
    depth = forest.shortened(sizes, 3, 0.8, 0.998)
    missed = np.prod(1 - 0.8 ** depth.astype(float), axis=1)
    assert (missed <= 0.002).all() and (missed > 0.0002).all()
    assert len({tuple(sorted(x)) for x in depth.tolist()}) >= 1 and (depth[2, :6] == 5).all() and (depth[2, 6:] < 5).any()
    best = forest.shortened(sizes[:1], 3, 0.8, 1 - 1e-6)
    assert (best == 3).all()  # as short as they get where the target is out of reach


def test_forest_finds_pairs_at_the_threshold():
    """Recall of the buckets that the sets ask for, over pairs of similarity 0.8 to 0.85."""
    rng = np.random.default_rng(7)
    sets, pairs = [], 400
    for _ in range(pairs):
        base = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        sets += [np.sort(base[:165]), np.sort(np.concatenate([base[15:165], base[165:]]))]  # 150 of 180 shared
    signed = [np.frombuffer(x, dtype=np.uint16).reshape(12, 5) for x in forest.signatures(sets, 12, 5)]
    sizes = np.ones((len(sets), 12, 3), dtype=np.int64)
    for t in range(12):
        for k in range(3):
            seen = {}
            for i, s in enumerate(signed):
                seen.setdefault(s[t, : 3 + k].tobytes(), []).append(i)
            for members in seen.values():
                sizes[members, t, k] = len(members)
    depth = forest.shortened(sizes, 3, 0.8, 0.998)
    found = sum(any((signed[i][t, : depth[i, t]] == signed[i + 1][t, : depth[i, t]]).all() for t in range(12)) for i in range(0, 2 * pairs, 2))
    assert found >= 0.99 * pairs


@pytest.mark.parametrize("block", [256, 4])
def test_join_matches_brute_force(spark, make_docs, corpus, block, monkeypatch):
    monkeypatch.setattr(similarity.verified_links, "__defaults__", (block,))
    rows = [(i, t, "en", "s") for i, t in enumerate(corpus)] + [(2, corpus[2], "en", "s")]
    got = sorted(tuple(r) for r in similar_documents(make_docs(rows)).collect())
    assert got == classes([shingles(r[1]) for r in rows], [r[0] for r in rows])


def test_join_of_a_large_near_group(spark, make_docs):
    rng = random.Random(2)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    texts = []
    for _ in range(150):
        v = list(base)
        for _ in range(rng.randrange(0, 5)):
            v[rng.randrange(200)] = f"z{rng.randrange(999)}"
        texts.append(" ".join(v))
    rows = [(i + 10, t, "en", "s") for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in similar_documents(make_docs(rows)).collect())
    want = classes([shingles(t) for t in texts], [r[0] for r in rows])
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert sum(g[3] for g in got) >= 0.99 * sum(w[3] for w in want)


def test_join_edges(spark, make_docs):
    assert similar_documents(make_docs([])).count() == 0
    df = make_docs([(None, "a b c d e f", "en", "s"), (4, "A b c d e f", "en", None), (5, None, None, None)]).selectExpr("*", "1 as node", "2 as id", "'x' as keys", "3 as class_id")
    assert sorted((tuple(r) for r in similar_documents(df).collect()), key=repr) == sorted([(None, 4, 2, 1), (4, 4, 2, 1), (5, 5, 1, 0)], key=repr)
    kept = keep_one_of_each(make_docs([(1, "q w e r t y", "en", "s"), (1, "q w e r t y", "en", "s"), (2, "q w e r t y", "en", "s"), (None, "q w", "en", "s"), (3, "", "en", "s")]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, None], key=str)


def test_rows_without_an_id_or_with_a_repeated_one_are_told_apart(spark, make_docs):
    x, y, z = "q w e r t y u", "only here once and never more", "another one of its own kind"
    rows = [(1, x, "en", "s"), (5, x, "en", "s"), (5, y, "en", "s"), (None, x, "en", "s"), (None, z, "en", "s"), (None, z, "en", "t"), (None, None, None, None), (None, "", None, None), (1, x, "en", "s"), (1, x, "en", "t")]
    left = [(r.doc_id, r.text) for r in keep_one_of_each(make_docs(rows)).collect()]
    assert sorted(left, key=str) == sorted([(1, x), (5, y), (None, z), (None, None), (None, "")], key=str)
    got = sorted((tuple(r) for r in similar_documents(make_docs(rows)).collect()), key=str)
    want = [(1, 1, 5, 4)] * 3 + [(5, 1, 5, 4), (5, 5, 1, 0), (None, 1, 5, 4), (None, None, 2, 1), (None, None, 2, 1), (None, None, 1, 0), (None, None, 1, 0)]
    assert got == sorted(want, key=str)
    clash = make_docs(rows).selectExpr("*", "1 as row", "2 as rows", "3 as repeated", "4 as gone_id", "5 as __id")
    assert keep_one_of_each(clash).count() == 5 and set(keep_one_of_each(clash).columns) == set(clash.columns)


def test_join_of_very_long_texts(spark, make_docs):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    near = list(long)
    for k in range(0, len(near), 100):
        near[k] = "changed"
    got = sorted(tuple(r) for r in similar_documents(make_docs([" ".join(long), "\n".join(near), "short"])).collect())
    assert got == [(0, 0, 2, 1), (1, 0, 2, 1), (2, 2, 1, 0)]


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = {r.node: r.root for r in connected_components(edges, Stage(spark, "t")).collect()}
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(100):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert connected_components(spark.createDataFrame([], "u long, v long"), Stage(spark, "t")).count() == 0


def brute_paragraphs(rows, min_words=8):
    """(doc_id, n_paragraphs, removed lines, kept_in, text) by comparing all lines; documents are (doc_id, text)."""
    last = lambda d: (d[0] is None, d[0] or 0)
    items = [((i, t), k, shingles(line)) for i, t in sorted(set(rows), key=str) for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= min_words]
    items = [x for x in items if x[2]]
    n = len(items)
    root = list(range(n))
    changed = True
    linked = [(a, b) for a in range(n) for b in range(a) if len(items[a][2] & items[b][2]) >= 0.8 * len(items[a][2] | items[b][2]) - 1e-9]
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    first = {}
    for x in range(n):
        first[root[x]] = min(first.get(root[x], items[x][:2]), items[x][:2], key=lambda p: (last(p[0]), p[1]))
    gone = {}
    for x in range(n):
        if items[x][:2] != first[root[x]]:
            gone.setdefault(items[x][0], {})[items[x][1]] = first[root[x]][0][0]
    out = []
    for i, t in rows:
        g = gone.get((i, t), {})
        lines = (t or "").split("\n")
        out.append((i, sum(len(x.split()) >= min_words for x in lines), len(g), sorted({x for x in g.values() if x is not None}), "\n".join(x for k, x in enumerate(lines) if k not in g)))
    return sorted(out, key=repr)


def brute_windows(rows, window, gone):
    """Every window of words that two documents share, cut but in the first: {document: word places}.

    Without winnowing (a reach of one) every window is selected.
    """
    streams = {}
    for i, t in set(rows):
        spans = [(m.group().lower(), t[: m.start()].count("\n")) for m in re.finditer(r"[^\W_]+", t)]
        for k in range(len(spans) - window + 1):
            lines = {x[1] for x in spans[k : k + window]}
            if not lines & gone.get((i, t), set()):
                streams.setdefault(tuple(x[0] for x in spans[k : k + window]), {}).setdefault((i, t), []).append(k)
    cut = {}
    for holders in streams.values():
        if len(holders) > 1:
            keep = min(holders, key=lambda d: (d[0] is None, d[0] or 0))
            for d, at in holders.items():
                if d != keep:
                    cut.setdefault(d, set()).update(w for k in at for w in range(k, k + window))
    return cut


def test_paragraphs_match_brute_force(spark, make_docs, corpus):
    passage = " ".join(f"shared{i}" for i in range(55))
    texts = [f"{t}\n{passage} tail{i}" if i % 5 == 0 and t else t for i, t in enumerate(corpus)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s"), (3, texts[5], "en", "s")]
    got = sorted(((r.doc_id, r.n_paragraphs, r.n_removed, list(r.kept_in), r.text) for r in dedup_paragraphs(make_docs(rows), window=10**6).collect()), key=repr)
    assert got == brute_paragraphs([(r[0], r[1]) for r in rows])
    assert sum(passage in g[4] for g in got) == 1


def test_both_passes_match_brute_force(spark, make_docs):
    """Paragraphs, then all windows of 6 words across lines: what is left of each document, word by word."""
    rng = random.Random(31)
    pool = [[f"p{k}x{i}" for i in range(rng.randrange(6, 14))] for k in range(12)]
    rows = []
    for i in range(40):
        stream = [w for _ in range(rng.randrange(1, 5)) for w in ([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 9))] + (rng.choice(pool) if rng.random() < 0.6 else []))]
        lines, at = [], 0
        while at < len(stream):
            n = rng.randrange(1, 15)
            lines.append(" ".join(stream[at : at + n]))
            at += n
        rows.append((i if i != 20 else None, "\n".join(lines)))
    rows.append(rows[0])
    gone, stays = {}, {x[0]: x[4] for x in brute_paragraphs(rows)}
    for i, t in rows:
        gone[i, t] = set(range(t.count("\n") + 1)) - _kept(t, stays[i])
    cut = brute_windows(rows, 6, gone)
    want = []
    for i, t in rows:
        words = [(m.group(), t[: m.start()].count("\n")) for m in re.finditer(r"[^\W_]+", t)]
        want.append((i, [w for k, (w, line) in enumerate(words) if line not in gone[i, t] and k not in cut.get((i, t), ())]))
    got = [(r.doc_id, r.text.split()) for r in dedup_paragraphs(make_docs([(i, t, "en", "s") for i, t in rows]), window=6, reach=1).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(cut.values()) and any(gone.values())


def _kept(text, left):
    """Numbers of the lines of the text that are left."""
    lines, out = left.split("\n") if left else [], set()
    for k, x in enumerate(text.split("\n")):
        if lines and lines[0] == x:
            out.add(k)
            lines.pop(0)
    assert not lines
    return out


def test_windows_of_shared_words_are_selected():
    rng = random.Random(4)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(39)]
    for _ in range(30):
        texts = [" ".join([*(f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(60))), *passage, *(f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(60)))]) for _ in range(2)]
        words, bounds = similarity.hashed_words([*texts, "too short", ""])
        where, h = similarity.winnowed(words, bounds, 20, 20)
        text = np.searchsorted(bounds, where, side="right") - 1
        assert set(h[text == 0]) & set(h[text == 1]) and not (text > 1).any()
        assert ((where + 20) <= bounds[text + 1]).all()
    thirty = " ".join(f"w{i}" for i in range(30))
    words, bounds = similarity.hashed_words([thirty, "x " + thirty])
    assert len(similarity.winnowed(words, bounds, 20, 20)[0]) >= 2


def test_winnowing_matches_its_definition():
    rng = np.random.default_rng(2)
    lengths = [0, 3, 19, 20, 21, 39, 40, 90, 1, 25]
    words = rng.integers(0, 1 << 60, sum(lengths)).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    h, want = similarity.rolling(words, 20), set()
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        own = list(range(lo, hi - 19))
        for k in range(max(1, len(own) - 19)) if own else ():
            want.add(min(own[k : k + 20], key=lambda i: h[i]))
    assert similarity.winnowed(words, bounds, 20, 20)[0].tolist() == sorted(want)


def test_cutting_keeps_what_is_around():
    passage = " ".join(f"P{i}" for i in range(60))
    line = f"Before, İ it; ({passage}) after it!"
    where, hashes = similarity.winnowed(*similarity.hashed_words([line]), 20, 20)
    shared = {h for place, h in zip(where.tolist(), hashes.view(np.int64).tolist()) if 3 <= place <= 43}
    left, cuts = cut_text(line, (), shared, 20, 20)
    assert cuts == 1 and left.startswith("Before, İ it") and left.endswith("after it!")
    assert len(left.split()) <= 5 + 2 * 20 and cut_text("short\n\nline", (), shared, 20, 20) == ("short\n\nline", 0)
    wrapped = f"top line\n\nBefore {passage[:89]}\n{passage[90:]}\nafter it!\n"
    every = set(similarity.winnowed(*similarity.hashed_words([passage]), 20, 1)[1].view(np.int64).tolist())
    assert cut_text(wrapped, (), every, 20, 1) == ("top line\n\nBefore\nafter it!\n", 1)
    assert cut_text(wrapped, (2, 3), every, 20, 1) == ("top line\n\nafter it!\n", 0)


def test_words_know_their_lines_in_long_texts(monkeypatch):
    rng = random.Random(8)
    texts = ["\n".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 60))) for _ in range(20)]
    want = [[k for k, line in enumerate(t.split("\n")) for _ in line.split()] for t in texts]
    small = similarity.pieces
    monkeypatch.setattr(similarity, "pieces", lambda x: small(x, 50))
    words, bounds, line = similarity.line_words(texts)
    assert [line[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:])] == want
    assert words.tolist() == similarity.hashed_words(texts)[0].tolist()


def test_unique_text_is_never_lost(spark, make_docs):
    dup = " ".join(f"same{i}" for i in range(50))
    own = [" ".join(f"own{k}x{i}" for i in range(50)) for k in range(4)]
    rows = [(1, dup), (None, dup), (None, own[0]), (None, own[1]), (7, dup), (7, own[2]), (9, own[3])]
    got = [(r.doc_id, r.text) for r in dedup_paragraphs(make_docs([(i, t, "en", "s") for i, t in rows])).collect()]
    assert sorted(got, key=repr) == sorted([(1, dup), (None, ""), (None, own[0]), (None, own[1]), (7, ""), (7, own[2]), (9, own[3])], key=repr)


def test_no_long_run_is_left_whatever_the_lines(spark, make_docs):
    rng = random.Random(14)
    stream = [f"s{rng.randrange(10**6)}" for _ in range(140)]
    wrap = lambda n: "\n".join(" ".join(stream[k : k + n]) for k in range(0, 140, n))
    texts = [wrap(7), wrap(5), "head line\n" + wrap(140), "\n" * 300 + wrap(3), wrap(9) + "\nand a tail"]
    left = [re.findall(r"\w+", r.text) for r in dedup_paragraphs(make_docs(texts)).collect()]
    runs = [{tuple(w[k : k + 39]) for k in range(len(w) - 38)} for w in left]
    assert not any(runs[a] & runs[b] for a in range(5) for b in range(a)) and set(stream) <= set(sum(left, []))


def test_passages_inside_paragraphs_are_kept_once(spark, make_docs):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**7)}" for _ in range(n))
    passage = fresh(55)
    texts = [f"{fresh(10)}\n{fresh(rng.randrange(5, 90))} {passage} {fresh(rng.randrange(5, 90))}" if i % 3 == 0 else fresh(100) for i in range(30)]
    out = {r.doc_id: r for r in dedup_paragraphs(make_docs([(i + 5, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    runs = {tuple(passage.split()[i : i + 39]) for i in range(17)}
    for i, t in enumerate(texts):
        r = out[i + 5]
        if i % 3 or i == 0:
            assert r.text == t and r.n_removed == 0 and not r.kept_in
        else:
            left = r.text.split()
            assert not any(tuple(left[k : k + 39]) in runs for k in range(len(left))) and r.n_removed >= 1 and 5 in r.kept_in
            assert len(t.split()) - len(left) >= 20 and t.split()[:12] == r.text.split()[:12] and t.split()[-5:] == r.text.split()[-5:]


def test_paragraph_edges(spark, make_docs):
    assert dedup_paragraphs(make_docs([])).count() == 0
    line = "a b c d e f g h i j"
    df = make_docs([(None, line, "en", "s"), (7, line, "en", "s"), (7, line, "en", "s"), (8, line + "\n" + line, "en", "s"), (9, None, None, None)]).selectExpr("*", "1 as gone", "2 as rep")
    got = sorted((tuple(r) for r in dedup_paragraphs(df).collect()), key=repr)
    assert got == sorted([(None, 1, 1, [7], ""), (7, 1, 0, [], line), (7, 1, 0, [], line), (8, 2, 2, [7], ""), (9, 0, 0, [], "")], key=repr)
