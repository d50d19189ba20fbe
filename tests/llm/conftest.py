import pytest


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that try an operator: nulls, empty and blank texts, repeated rows,
    a long text, and further columns with names that operators might use."""
    rows = [
        (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b  c\td e f g"), (None, "a b c d e f g"), (3, None), (4, ""), (5, "   "), (None, None),
        (6, "x" * 50_000), (7, "word " * 3_000), (8, "Ünï 中文 😀 mail me@a.example.com now"),
    ]
    names = "text_sha256 group_size key band words root label length bucket n spans score entity term digest shard offset block"
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names.split())
    return spark.createDataFrame([(*r, *["q"] * len(names.split())) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
