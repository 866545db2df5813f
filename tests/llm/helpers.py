"""Small tables with the awkward rows that every operator must take."""

AWKWARD = [
    (1, "one two three four five six seven", "en", "a", 33),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "one two three four five six seven", "en", "b", 33),
    (4, "one two three four five six seven", "en", "b", 33),
    (None, "a document without id", "de", "b", 21),
    (5, "word " * 30_000, "en", "a", 150_000),
    (6, "   \t\n  ", "en", "", 7),
    (7, "ünïcödé 日本語 text \U0001f600 end", "xx", "c", 24),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """With extra columns whose names could clash with an operator's own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("chunk", "node", "n", "root", "token", "part", "rank", "score", "_row", "_source", "slot")})


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def key(row):
    return tuple((v is not None, str(v)) for v in row)
