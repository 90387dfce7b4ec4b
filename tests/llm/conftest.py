import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, run string, spans string, size string, fp string, n string, t string, _key string, _id string, _text string, digest string, path string"
EXTRA = tuple("x" for _ in range(13))


@pytest.fixture()
def docs(spark):
    """Documents from (id, text[, lang, source]) rows, with columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "src0")), 1, *EXTRA) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties, repeated rows, null ids, and a long text."""
    return [(1, None), (2, ""), (3, " \n\t"), (4, "Same text here"), (5, "SAME text here"), (5, "SAME text here"), (None, "same text here"), (6, "é Ü 日本 x"), (7, "word " * 20_000), (None, None)]


@pytest.fixture()
def small_records(spark):
    """Arrow batches of seven rows, so that small partitions have several."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    yield
    spark.conf.set(name, before)
