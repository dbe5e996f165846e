import random

import corpus_pipeline
import public_tokenizers

from .test_line_templates import brute as brute_lines
from .test_similarity import classes, shingles


def test_stages_hold_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["the", "ing", "er", "on", "st", "la", "qu"]) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zorgblat", "zorgblatting"])
        text = " ".join(w[:40]) + "\n" + " ".join(w[40:])
        if i % 9 == 0:
            text += f"\nShared by page {i} of the north gazette"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1], "en", "s0", rows[i][4]) for i in range(1, 30, 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        if name != "best-fit packing":
            assert docs.columns == columns
        seen[name] = docs.collect()
    clean = {r.doc_id: r.text for r in seen["toxicity"]}
    wrong = [i for i in range(400) if (i in clean) == (i % 8 == 0)]
    assert len(wrong) <= 8
    lines = {r.doc_id: r.text for r in seen["line dedup"]}
    assert lines == {i: t for i, n, t in brute_lines(sorted(clean.items())) if not n or t.strip()}
    assert all(r.n_chars == len(r.text) for r in seen["line dedup"])
    ids = sorted(lines)
    want = {c[0] for c in classes([shingles(lines[i]) for i in ids], ids) if c[0] == c[1]}
    assert {r.doc_id for r in seen["n-gram Jaccard join"]} == want and len(seen["n-gram Jaccard join"]) == len(want)
    mixed = seen["mixing sources to target weights"]
    assert {r.doc_id for r in mixed} <= want and len(mixed) > 0.5 * len(want)
    pieces = seen["best-fit packing"]
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    assert sorted(r.doc_id for r in pieces if r.piece == 0) == sorted(r.doc_id for r in mixed)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5 and public_tokenizers


def test_stages_take_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    own = [" ".join("u" + "".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(30)) for _ in range(8)]
    rows = [(1, own[0], None, None, None), (None, own[1], "en", "a", 3), (None, own[2], "en", "a", 3), (None, own[2], "en", "a", 3), (7, own[3], "en", "a", 3), (7, own[4], "en", "b", 3)]
    rows += [(8, None, None, None, None), (9, "", "en", "a", 0), (10, " ".join(own[5:] * 900), "en", None, 5), (11, own[0].upper(), "en", "b", 3)]
    rows = [(*r, f"x{k}", k, "y", None) for k, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `doc` int, `gone_id` string, `n_dropped` int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, None, None), (None, 1, 1), (7, 0, 0), (8, 1, 0), (9, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, {}
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        docs = function(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns
    assert len(left["line dedup"]) == 10
    kept = {r.text for r in left["n-gram Jaccard join"]}
    assert {own[0], own[1], own[2], own[3], own[4], None, ""} < kept and len(left["n-gram Jaccard join"]) == 8
    assert len(left["best-fit packing"]) >= len(left["mixing sources to target weights"]) > 0
