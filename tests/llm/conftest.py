import random

import pytest


@pytest.fixture(scope="session")
def hard_rows():
    """Null and repeated ids, null, empty, blank and long texts, copies and near copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopq") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, " ".join(rng.choice(words) for _ in range(6000))), (4, "another text under the same id"), (None, "a row without an id stays a row"), (None, None)]
    rows += [(10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base)), (12, " ".join(base)), (13, " ".join(base).upper()), (14, "né " * 40), (15, "Ünïcödé … ▁ <|endoftext|> 漢字"), (16, "x" * 5000), (17, "few words here")]
    return rows


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """The rows with extra columns whose names clash with those that operators use."""
    rows = [(i, t, "h" + str(k % 3), k, k, "z", k) for k, (i, t) in enumerate(hard_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key long, n long, _doc string, name long").repartition(3)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.limit(0)


@pytest.fixture(scope="session")
def plain(spark, hard_rows):
    """Rows with unique ids."""
    return [(k, t) for k, (_, t) in enumerate(hard_rows)]


@pytest.fixture(scope="session")
def plain_df(spark, plain):
    return spark.createDataFrame(plain, "doc_id long, text string").repartition(3)
