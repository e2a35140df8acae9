import random

import pytest

#: Texts that every operator must take: null, empty, blank, one word, very long, repeats.
ODD = [None, "", " \n\t ", "one", "a b", "Same text here", "Same text here", "ß\u0085é \U0001f600 ok", "x" * 70_000, ("word " * 3000).strip(), "tab\tand\x0bvt\x0cff\rcr\nnl"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, _q_x string, size string"


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_rows(seed=0, plain=60):
    rng = random.Random(seed)
    texts = ODD + [prose(rng, rng.randrange(5, 120)) + "\n" + prose(rng, 9) for _ in range(plain)]
    texts += [t + " extra" for t in texts[-5:]] + texts[-5:]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", None if t is None else len(t), 1, "clash", "clash") for i, t in enumerate(texts)]
    rows.append((None, "null id " + prose(rng, 60), "en", "s0", 1, 1, "", ""))
    rows.append(rows[20])  # a row twice
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(12, 70)] + [(None, 1, 1), (20, 1, 0)], "doc_id long, quality int, toxic int")
