import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, run long, tag long, anchor string, rep long, key string, score double, block int, epoch int, position string, id long, fp string, runs string"


def table(spark, rows):
    """(doc_id, text) rows as a table with many clashing columns."""
    full = [(i, t, "en", ("hot" if (i or 0) % 3 else None), None, 1, 2, "a", 3, "k", 0.5, 1, 2, "p", 4, "f", "r") for i, t in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, blank and very long texts, repeated rows, ties."""
    r = random.Random(5)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(900)) for _ in range(30_000))
    line = "Ein langer Satz, der mehrfach vorkommt, damit er als Wiederholung gilt und nicht nur einmal im ganzen Bestand zu finden ist, heute und morgen."
    return [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, line), (6, line), (6, line), (7, line + " Nachtrag"), (None, "no id"), (8, "é 漢字 🙂"), (9, "x"), (9, "y"), (10, "a\x1cb \x00 <|endoftext|>"), (11, long + " end")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


SF = "/root/testdata/sf0.001"
