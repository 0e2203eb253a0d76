import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names are also an operator's own.
CLASH = ("size", "key", "fp", "row", "kept", "_row", "part", "sk", "cluster", "bin_id", "root", "place", "_nth", "words", "target", "label", "block", "shard")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.paretovariate(0.8)), vocabulary)}" + ("." if k % 11 == 10 else "") for k in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, equal texts, near copies."""
    rng = random.Random(5)
    text = prose(rng, 120)
    changed = text.split()
    changed[60] = "other"
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, "en", None, None), (3, " ".join(changed), None, "a", 1), (4, None, "en", "b", 0), (5, "", "en", "b", 0),
        (6, " \t\r\n\x0b\x0c ", "en", "b", 0), (7, prose(rng, 30_000), "de", "c", 9), (None, prose(rng, 80), "en", "a", 1), (None, None, None, None, None), (None, prose(rng, 80), "en", "a", 1),
        (8, "É À ça\nun deux\nun deux\n", "fr", "a", 1), (9, "x", "en", "a", 1), (10, "one two three four", "en", "d", 1),
    ]
    rows += [(100 + k, prose(rng, rng.randint(1, 200)), "en", f"s{k % 7}" if k % 3 else "hot", 1) for k in range(150)]
    rows += [(300 + k, text, "en", "hot", 1) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def wide_docs(odd_docs):
    """The same with clashing columns."""
    from pyspark.sql import functions as F

    return odd_docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    rows = [(r[0], 1, 0) for r in odd_rows if r[0] is not None and r[0] % 2] + [(4, None, 1), (None, 1, 0), (6, 0, None), (8, 0, 0), (2, 0, 0), (2, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
