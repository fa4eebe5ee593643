import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _h string, key string, score string"


def words(rng, n, base="lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()):
    return [rng.choice(base) + rng.choice(["", "a", "us", "or", "ing", "en"]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Small corpus with copies, near copies, shared passages, odd rows and clashing extra columns."""
    rng = random.Random(4)
    out, shared = [], " ".join(words(rng, 60))
    for i in range(120):
        w = words(rng, rng.choice([3, 15, 40, 90]))
        t = " ".join(w)
        if i % 5 == 0:
            t = f"{t} {shared} {' '.join(words(rng, 7))}"
        if i % 7 == 0 and out:
            t = rng.choice(out)[1] or ""
        if i % 11 == 0 and out:
            t = (rng.choice(out)[1] or "").replace(" ", "\t\n", 2)
        if i % 13 == 0:
            t = "De " * 45 + t
        out.append((i * 3 + 1, t))
    out += [(700, None), (701, ""), (702, " \n "), (703, "one two three"), (704, "x " * 30_000), (None, "row without id " * 12), (None, None)]
    out.append(out[3])  # a repeated row
    return [(d, t, ["en", "fr", None][k % 3], ["web", "book", None][k % 3], len(t or ""), "h", "k", "s") for k, (d, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
