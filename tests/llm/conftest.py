import pytest

SF = "/root/testdata/sf0.001"
TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from caseflow.session import ship_package
    ship_package(spark)


@pytest.fixture
def make(spark):
    """make(rows): a documents frame of (doc_id, text[, lang[, source]]) rows."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
        return spark.createDataFrame(full, TABLE)
    return build


@pytest.fixture
def stored(tmp_path, make):
    """stored(rows): a folder that holds the rows as its documents table."""
    def build(rows, partitions=2):
        make(rows).repartition(partitions).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)
    return build


#: Nulls, empty texts, ties, repeated rows and a long text.
ODD_ROWS = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"),
    (6, "One  two three\nfour five six"), (None, "no id here at all, none"), (7, "x"), (8, "word " * 30000), (9, "a" * 50000),
    (10, "12345 " * 3000), (11, "é ß 中文 😀     end"), (12, "two words"), (13, "Two Words"),
]
