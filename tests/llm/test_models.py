import random
import zlib

import numpy as np

from gridloom.llm.language import fit_language, predict_language
from gridloom.llm.toxicity import GramTable, drop_toxic, fit_toxicity, packed, score_toxicity

LABELS = "doc_id long, quality int, toxic int"


def syllables(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


EN, DE = ["the", "ing", "er", "on", "st"], ["sch", "ung", "ei", "ch", "ö"]


def toxic_corpus(rng, n=900):
    rows, labels = [], []
    for i in range(n):
        w = syllables(rng, EN, rng.randrange(4, 200)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["zorg", "blarg"]) + rng.choice(["", "er", "st"])
        rows.append((i, " ".join(w).capitalize(), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, make_docs):
    rows, labels = toxic_corpus(random.Random(1))
    rows += [(5000, None, None, None), (5001, "", None, None), (5002, "?!", None, None), (None, "zorg", None, None), (5003, "x" * 300_000, None, None), (6, rows[6][1], "en", "s")]
    labels += [(6, 1, 0), (7, None, None), (None, 1, 1)]
    docs = make_docs(rows).selectExpr("*", "1 as y", "2 as toxic", "3 as score", "4 as i")
    model = fit_toxicity(docs, spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' as text"))
    out = score_toxicity(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held) and len(held) > 100
    assert {r.doc_id: r.predicted for r in out}[5000] == 0
    left = drop_toxic(docs, model)
    assert left.columns == docs.columns and left.count() == sum(not r.predicted for r in out)


def test_toxicity_with_nothing_to_learn(spark, make_docs):
    docs = make_docs(["one two", None])
    for labels in ([], [(0, 1, 0)], [(0, 1, 1), (1, 1, 1)]):
        model = fit_toxicity(docs, spark.createDataFrame(labels, LABELS))
        assert all(0 <= r.score <= 1 for r in score_toxicity(docs, model).collect())
    assert score_toxicity(make_docs([]), model).count() == 0


def test_toxicity_counts_all_rows_that_the_regression_leaves(spark, make_docs):
    rows, labels = toxic_corpus(random.Random(3))
    fours = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 4]
    known = {i: f"qq{chr(97 + k % 26)}{chr(97 + k // 26)}" for k, i in enumerate(fours)}  # a word of each such row alone
    rows = [(i, f"{t} {known.get(i, '')}", *r) for i, t, *r in rows]
    labels = [(i, q, int(y or i in known)) for i, q, y in labels]
    labelled = spark.createDataFrame(labels, LABELS)
    for fit_rows in (20, 20_000):
        model = fit_toxicity(make_docs(rows), labelled, fit_rows=fit_rows)
        grams = np.array([[ord(c) for c in word + " "] for word in known.values()], dtype=np.uint32).T
        assert (~np.isnan(model.gram_ratio.get(*packed(grams)))).sum() == max(len(fours) - fit_rows, 0)


def test_grams_never_share_a_number():
    rng = np.random.default_rng(3)
    for size in (4, 5):
        grams = np.unique(rng.integers(32, 0x110000, (300_000, size)).astype(np.uint32), axis=0)
        known, other = grams[::2].T, grams[1::2].T
        value = np.arange(known.shape[1], dtype=np.float32)
        table = GramTable(*packed(known), value)
        assert (table.get(*packed(known)) == value).all() and np.isnan(table.get(*packed(other))).all()


def test_language_on_held_out_rows(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, syllables(rng, EN if i % 2 else DE, rng.randrange(3, 120)), "en" if i % 2 else "de", "s") for i in range(400)]
    train = make_docs([r for r in rows if r[0] % 5] + [(9999, "the the the", None, "s"), (9998, None, "fr", "s")])
    model = fit_language(train)
    extra = [(500, None, None, None), (501, "", "en", "s"), (502, "12 %$ 3", "en", "s"), (503, "ö" * 200_000, "en", "s"), (504, "漢字かな", "en", "s"), (None, "the ing", "en", "s")]
    out = predict_language(make_docs([r for r in rows if r[0] % 5 == 0] + extra).selectExpr("*", "1 as lang_pred", "2 as score"), model)
    got = {r.doc_id: r for r in out.collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in rows if r[0] % 5 == 0) >= 79
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0
    assert got[504].rejected and got[504].lang_pred in ("en", "de") and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_with_nothing_to_learn(spark, make_docs):
    model = fit_language(make_docs([]))
    assert [r.lang_pred for r in predict_language(make_docs(["some text"]), model).collect()] == ["und"]
    assert predict_language(make_docs([]), model).count() == 0
