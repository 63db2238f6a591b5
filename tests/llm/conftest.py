import pytest
from pyspark.sql import functions as F

#: Documents with nulls in every column, empty and very long texts, ties, repeated rows.
LONG = "lorem ipsum dolor sit amet " * 8000 + "Tail " * 500
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from the angry bear tonight", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from the angry bear tonight", None),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from the angry bear tonight", None),
    (3, "", "en"),
    (4, None, None),
    (5, " \n\t ", "de"),
    (None, "a text without an id, long enough to hold more than fifty bytes of its own content", "fr"),
    (None, None, None),
    (6, LONG, "la"),
    (7, LONG + "end", "la"),
    (8, "Émile naïve ŒUVRE — déjà vu, ça va? 日本語のテキスト \U0001f600 done", "fr"),
    (9, "ends with a backslash \\ and [INST] odd </s> marks <s>", "en"),
    (10, "a text without an id, long enough to hold more than fifty bytes of its own content", "fr"),
    (11, "x" * 400, "en"),
    (12, "x" * 300 + "y" * 60, "en"),
]


def documents(spark, rows=ROWS, clash=()):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("src0"), "n_chars": F.length("text").cast("long")})
    for name in clash:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    return documents(spark, clash=("row_id", "digest", "fp", "key", "shard", "score", "stats", "doc", "at", "block", "cell", "spans", "items", "locator", "kept", "content", "low", "first", "root", "node"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark).limit(0)


def plain(df, *columns):
    """Rows as sorted tuples, nulls last."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((v is None, v) for v in r))
