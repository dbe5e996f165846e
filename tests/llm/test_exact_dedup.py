import hashlib
import random

from gridloom.llm.exact_dedup import CuckooIndex, exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        normal = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        groups.setdefault(hashlib.sha256(normal.encode()).hexdigest(), []).append(doc_id)
    out = []
    for digest, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=repr)


def test_index_inserts_deletes_and_resizes():
    rng = random.Random(1)
    index, held = CuckooIndex(2), {}
    for step in range(5000):
        key = hashlib.sha256(str(rng.randrange(1500)).encode()).digest()
        if key in held and rng.random() < 0.4:
            assert index.delete(key)
            del held[key]
        elif key not in held:
            index.insert(key, (step, 1))
            held[key] = (step, 1)
        assert index.live == len(held)
    assert index.resizes > 3
    assert dict(index.items()) == held
    assert all(index.find(k) == v for k, v in held.items())
    assert index.find(b"\0" * 32) is None and not index.delete(b"\0" * 32)


def test_matches_brute_force(spark, make_docs, corpus):
    rows = [(i, t, "en", "s") for i, t in enumerate(corpus)]
    rows += [(None, corpus[0], "en", "s"), (0, corpus[0], "en", "s"), (3, corpus[3], "en", "s"), (None, "lonely", "en", None), (900, "É ABC", "x", None), (901, "É abc", "x", None), (902, "é abc", "x", None)]
    got = exact_dedup(make_docs(rows), max_live=5).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r[0], r[1]) for r in rows])


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert exact_dedup(make_docs([])).count() == 0
    df = make_docs(["a", "A"]).selectExpr("*", "1 as digest", "2 as kept", "3 as rows", "4 as keep_id", "5 as copy")
    assert [(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(df).orderBy("doc_id").collect()] == [(0, 1, False), (1, 1, True)]
