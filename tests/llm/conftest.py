import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source) tuples."""

    def make(rows, extra=None):
        full = [(i, r, "en", "s0", len(r) if r else 0) if not isinstance(r, tuple) else (*r, len(r[1]) if r[1] else 0) for i, r in enumerate(rows)]
        df = spark.createDataFrame(full, DOC_SCHEMA).repartition(3)
        return df

    return make


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Originals, exact and near copies, shared passages, short, empty and null texts."""
    rng = random.Random(5)
    texts: list[str | None] = []
    for i in range(60):
        w = words(rng, rng.choice([3, 8, 30, 120, 300]))
        base = "\n".join(" ".join(w[k : k + 25]) for k in range(0, len(w), 25))
        texts.append(base)
        if i % 6 == 0:
            texts += [base, base.upper()]
        if i % 4 == 0:
            for _ in range(3):
                v = list(w)
                for _ in range(max(1, len(v) // 60)):
                    v[rng.randrange(len(v))] = f"x{rng.randrange(10**6)}"
                texts.append(" ".join(v))
    texts += [None, "", "   \n ", "...", "one", "one"]
    return texts
