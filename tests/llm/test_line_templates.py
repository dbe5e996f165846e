import random

import numpy as np

from gridloom.llm.line_templates import Lines, drop_recurring_lines, fold, merge_leaf


def brute(rows, min_docs=5, depth=4, similarity=0.85, min_tokens=3):
    """The template tree in plain Python: (doc_id, n_dropped, text)."""

    def tokens(line):
        found = line.lower().split()
        digits = [any(c in "0123456789" for c in t) for t in found]
        if len(found) < 3 or 2 * sum(digits) > len(found):
            return tuple(found)
        return tuple("<*>" if d else t for t, d in zip(found, digits, strict=True))

    seen = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = tokens(line)
            if len(k) >= min_tokens:
                seen.setdefault(k, []).append((i, t))
    leaves = {}
    for k in seen:
        leaves.setdefault((len(k), k[:depth]), []).append(k)
    template = {}
    for leaf, lines in leaves.items():
        if len(lines) == 1 or sum(len({t for _, t in seen[k]}) for k in lines) < min_docs:
            template |= {k: k for k in lines}
            continue
        template |= {k: (leaf, n) for k, n in zip(lines, groups(lines, similarity), strict=True)}
    members = {}
    for k, t in template.items():
        members.setdefault(t, []).append(k)
    first = {}
    for t, ks in members.items():
        held = [x for k in ks for x in seen[k]]
        if len({text for _, text in held}) >= min_docs:
            first |= {k: min(i for i, _ in held) for k in ks}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if tokens(x) not in first or first[tokens(x)] == i]
        out.append((i, len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else t))
    return sorted(out, key=repr)


def groups(lines, similarity):
    """Templates of a leaf where every line is like every other or like none (the test's lines)."""
    number, heads = [], []
    for k in lines:
        for n, h in enumerate(heads):
            if sum(a == b for a, b in zip(h, k, strict=True)) >= similarity * len(k):
                number.append(n)
                break
        else:
            heads.append(k)
            number.append(len(heads) - 1)
    return number


def rows_of(rng):
    rows = []
    for i in range(80):
        lines = [" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), f"Posted on {rng.randrange(30)} May {1990 + i} by the staff")
        if i % 4 == 0:
            lines.append("All  rights reserved.")
        if i % 2 == 0:
            lines.append(f"{i} 7 {i * i} of 9 {i % 4}")
        if i % 7 == 0:
            lines.append(f"The whole team of reporters in the north wishes you a very fine {lines[0].split()[0]} today")
        if i % 5 == 0:
            lines.append("rare line that only copies repeat here")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + k, rows[0][1]) for k in range(9)] + [(200, None), (201, ""), (202, "\n\n"), (203, "two words")]
    return rows


def test_lines_keep_their_numbers():
    lines = Lines(["a b c\n\nd e f 1\nx", "", "\ng h i\x00j"], 3, 4)
    assert lines.owner.tolist() == [0, 0, 0, 2] and lines.number.tolist() == [0, 2, 3, 1] and lines.enough.tolist() == [True, True, False, True]
    again = Lines(["D  E f 22"], 3, 4)
    assert again.key[0] == lines.key[1] and again.leaf[0] == lines.leaf[1]


def test_merge_keeps_the_constant_part():
    line = np.arange(20, dtype=np.uint64)
    near = line.copy()
    near[3] = 99
    far = line.copy()
    far[:10] = 77
    assert merge_leaf([line, near, far, line], 0.85) == [0, 0, 1, 0]


def test_matches_brute_force(spark, make_docs):
    rows = rows_of(random.Random(4))
    got = drop_recurring_lines(make_docs([(i, t, "en", "s") for i, t in rows])).selectExpr("row.doc_id", "n_dropped", "text").collect()
    got = sorted(((r.doc_id, r.n_dropped, r.text) for r in got), key=repr)
    assert got == brute(rows)
    assert sum(g[1] for g in got) > 50


def test_crowded_leaves_still_drop_equal_lines(spark, make_docs):
    rows = rows_of(random.Random(6))
    got = drop_recurring_lines(make_docs([(i, t, "en", "s") for i, t in rows]), leaf_lines=1).collect()
    assert sum("rights reserved" in (r.text or "") for r in got) == 1


def test_fold_compares_all_that_could_share_a_template():
    rng = random.Random(8)
    for length in (7, 14, 20):
        lines = []
        for _ in range(150):
            line = np.arange(length, dtype=np.uint64)
            line[4 : 4 + rng.randrange(4)] += np.uint64(rng.randrange(5))
            line[length - 1] += np.uint64(rng.randrange(40))
            lines.append(line)
        number, templates = fold(lines, 0.85)
        variable = templates == np.uint64(0x5EED5EED5EED5EED)
        assert (variable.mean(axis=1) <= 0.15 + 1e-9).all()
        assert all(((templates[n] == x) | variable[n]).all() for n, x in zip(number, lines, strict=True))
        for a in range(len(templates)):
            for b in range(a):
                assert ((templates[a] != templates[b]) | variable[a] | variable[b]).mean() > 0.15


def test_crowded_leaves_merge_like_small_ones(spark, make_docs):
    rows = rows_of(random.Random(7))
    rows += [(300 + k, f"The whole team of reporters in the north wishes you a very fine q{chr(97 + k % 26)}{chr(97 + k // 26)} today") for k in range(60)]
    for leaf_lines in (1, 7, 2000):
        got = drop_recurring_lines(make_docs([(i, t, "en", "s") for i, t in rows]), leaf_lines=leaf_lines).selectExpr("row.doc_id", "n_dropped", "text").collect()
        assert sorted(((r.doc_id, r.n_dropped, r.text) for r in got), key=repr) == brute(rows)
        assert sum("very fine" in (r.text or "") for r in got) == 1


def test_short_lines_take_part(spark, make_docs):
    rows = rows_of(random.Random(9))
    rows = [(i, f"{t}\nles.\n\nand ornd." if t and i < 80 and i % 9 == 0 else t) for i, t in rows]
    got = drop_recurring_lines(make_docs([(i, t, "en", "s") for i, t in rows])).selectExpr("row.doc_id", "n_dropped", "text").collect()
    assert sorted(((r.doc_id, r.n_dropped, r.text) for r in got), key=repr) == brute(rows, min_tokens=1)
    pages = drop_recurring_lines(make_docs([f"page {i}\npage 7\nown w{i}x here" for i in range(6)])).collect()
    assert sorted(r.text.split("\n")[0] for r in pages) == [f"page {i}" for i in range(6)] and sum("page 7" in r.text for r in pages) == 1
    assert [r.doc_id for r in got if "and ornd." in (r.text or "")] == [0] == [r.doc_id for r in got if "les." in (r.text or "")]


def test_edges(spark, make_docs):
    assert drop_recurring_lines(make_docs([])).count() == 0
    df = make_docs([(i, f"same old line here\nown w{i}x", None, None) for i in range(6)] + [(None, "same old line here", None, None)]).selectExpr("*", "1 as id", "2 as lines", "3 as n_dropped", "4 as key_id")
    out = drop_recurring_lines(df)
    assert set(out.select("row.*").columns) == set(df.columns) - {"text"}
    got = {r["row"].doc_id: r.text for r in out.collect()}
    assert got == {0: "same old line here\nown w0x", None: "", **{i: f"own w{i}x" for i in range(1, 6)}}


def test_rows_without_an_id_or_with_a_repeated_one_are_documents_of_their_own(spark, make_docs):
    rows = [(None, f"the same old line here\nown n{chr(97 + i)}x words", "en", "s") for i in range(9)] + [(7, f"another old line there\nown m{chr(97 + i)}x words", "en", "s") for i in range(6)]
    rows += [(8, "the same old line here\nwith an id", "en", "s")] * 2
    left = [(r["row"].doc_id, r.text) for r in drop_recurring_lines(make_docs(rows)).collect()]
    assert sum("same old" in t for _, t in left) == 2 == sum("same old" in t for i, t in left if i == 8)
    assert sum("another old" in t for _, t in left) == 1
    assert sorted(t.split("\n")[-1] for _, t in left) == sorted(r[1].split("\n")[-1] for r in rows)


def test_very_long_texts(spark, make_docs):
    long = "\n".join(f"line of its own kind w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(15_000)) + "\nAll rights reserved here"
    got = {r["row"].doc_id: (r.n_lines, r.n_dropped) for r in drop_recurring_lines(make_docs([long, *[f"w{chr(97 + k)}\nAll rights reserved here" for k in range(6)]]), similarity=1.0).collect()}
    assert got[0] == (15_001, 0) and all(got[k] == (2, 1) for k in range(1, 7))
