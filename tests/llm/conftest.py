import pytest

AWKWARD = [
    None, "", " ", "\n\n", "a", "one two", "Ünïcode ŒUVRE №5 ②", "x" * 3000, "the end.\n" * 400,
    "<|endoftext|> inside", "tab\x1cbed\x1fwords", "ΑΣ ΟΔΟΣ.", "étude café",
    "it's they'll don't 'tis", "a,b;c:d!? 12345 #$%", "日本語 テキスト", "same text here", "same text here",
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empties, odd characters, repeated rows, clashing extra columns."""
    rows = [(k, t, None if k % 3 else "en") for k, t in enumerate(AWKWARD)]
    rows += [(None, "no id", "en"), (None, None, None), (5, "one two", "en"), (5, "one two", "en")]
    return spark.createDataFrame(
        [(i, t, l, 1, "x", 2, 3.0) for i, t, l in rows],
        "doc_id long, text string, lang string, size int, shard string, part_ int, score double",
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
