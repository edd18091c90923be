import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


BASE = " ".join(f"word{i}" for i in range(80))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, near copies, clashing extra columns."""
    rows = [
        (1, BASE, "x"),
        (1, BASE, "x"),
        (2, BASE + " tail", "x"),
        (3, "other " + BASE, None),
        (4, None, "x"),
        (5, "", "x"),
        (None, "word1 word2", "x"),
        (None, None, None),
        (6, " \t\n ", "x"),
        (7, "A" * 5000 + " " + "b" * 3000, "x"),
        (8, "Once  upon\ta\ntime… ñandú 中文 🙂", "x"),
        (9, "one two", "x"),
        (10, " ".join(f"long{i % 977}" for i in range(30_000)), "x"),
        (11, BASE + " " + BASE, "x"),
    ]
    return spark.createDataFrame([(a, b, c, 1, "k", 2) for a, b, c in rows], "doc_id long, text string, source string, piece int, key string, n long")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
