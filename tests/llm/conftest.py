import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string, v string, n string, base string, kept string"


def docs_of(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    made = [(i, t, lang, source, None if t is None else len(t), "x", "y", "z", "n", "b", "k") for i, t, lang, source in rows]
    return spark.createDataFrame(made, DOCS)


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls, empty and short texts, a very long one, exact and near copies, shared passages, repeated rows, rows without id or source."""
    rng = random.Random(5)
    passage, base = words(rng, 60, 9000), words(rng, 150, 9000)
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, "one", "en", "a"), (4, "ONE", "de", "b"), (5, "a b c d", None, "b"), (6, words(rng, 30000, 50), "en", "a")]
    rows += [(10 + i, base, "en", "a") for i in range(6)]
    for i in range(12):
        w = base.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((30 + i, " ".join(w), "fr", ("a", "b", "c", None)[i % 4]))
    rows += [(60 + i, f"{words(rng, 40, 9000)} {passage} {words(rng, 30, 9000)}", "en", ("a", "c")[i % 2]) for i in range(10)]
    rows += [(100 + i, words(rng, rng.randrange(1, 300), 9000), rng.choice(["en", "fr"]), rng.choice("abc")) for i in range(60)]
    rows += [(60, rows[25][1], "en", "a")] * 2
    return rows
