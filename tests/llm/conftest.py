"""Small tables for the llm operators: nulls, blanks, ties, repeated rows, long texts, extra columns."""

import random

import pytest

from stormcell.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("llm-tests", cpus=4, shuffle_partitions=4, driver_memory="4g")


@pytest.fixture(autouse=True)
def nothing_cached(spark):
    """What a test caches goes with it: the session is shared by all tests of a run."""
    yield
    spark.catalog.clearCache()


def make_rows(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnrst") + str(k % 7) for k in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows = [(i, text(rng.randint(1, 160))) for i in range(n)]
    passage = text(70)
    base = text(120).split()
    for k in range(12):  # near copies of one text, one outlier among them
        words = list(base)
        for _ in range(2 if k else 14):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append((n + k, " ".join(words)))
    for k in range(6):   # a passage that several documents share
        rows.append((n + 20 + k, f"{text(30)}\n{passage}\t{text(20)}"))
    rows += [(n + 30, rows[3][1]), (n + 31, rows[3][1]), (n + 32, rows[70][1].upper())]   # exact copies, and another case
    rows += [(n + 40, None), (n + 41, ""), (n + 42, " \t\n "), (n + 43, "one"), (n + 44, "one"), (n + 45, "one two three four"),
             (n + 46, "la la " * 3000), (n + 47, "naïve  café\u00a0x\n\nline\nline"), (n + 48, text(9000))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    out = [(i, t, "en", "hot" if i % 3 else None, len(t or ""), "x", i) for i, t in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, key string, n long")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows and a row without doc_id."""
    return spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None)],
                                 "doc_id long, text string")
