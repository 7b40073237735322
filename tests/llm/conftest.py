import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, with ids from 0; extra columns have names that operators use themselves."""

    def build(texts, ids=None, lang=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def clashing():
    def add(df):
        from pyspark.sql import functions as F

        for name in ("score", "kept", "slot", "shard", "node", "n_words", "words", "hashes", "ids", "row", "class_id"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return add
