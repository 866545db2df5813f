"""Full-text search: analysis, term match, BM25, highlighting; all in Column arithmetic, statistics from one aggregate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..semantics import Value, text

# BM25 parameters, and the endings that stemming takes off, tried in this order.
K1, B = 1.2, 0.75
ENDINGS = ("mente", "ções", "ção", "ing", "es", "os", "as", "s")


def _stem(w: Column) -> Column:
    out = None
    for end in ENDINGS:
        test, cut = w.endswith(end) & (F.char_length(w) > len(end) + 2), F.substring(w, F.lit(1), F.char_length(w) - len(end))
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return out.otherwise(w)


def analyze(value: Column, lowercase: bool = True, stopwords: tuple[str, ...] = (), stemming: bool = False) -> Column:
    """Terms of a text, in order."""
    words = F.split(F.lower(value) if lowercase else value, r"[^\p{L}\p{N}_]+")
    words = F.filter(words, lambda w: (w != "") & (~w.isin(*stopwords) if stopwords else F.lit(True)))
    return F.transform(words, _stem) if stemming else words


def analyze_query(query: str, lowercase: bool = True, stopwords: tuple[str, ...] = (), stemming: bool = False) -> list[str]:
    """The same on the driver, for the words of a query; distinct, in order."""
    out = []
    for w in re.split(r"[^\w]+", query.lower() if lowercase else query):
        if not w or w in stopwords:
            continue
        if stemming:
            w = next((w[: -len(e)] for e in ENDINGS if w.endswith(e) and len(w) > len(e) + 2), w)
        out.append(w)
    return list(dict.fromkeys(out))


def frequency(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == term))


def postings(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, key, len, tf, first): how often each term stands in each row, the row's terms in all, and for one term of each row
    that it is the first, so that rows can be counted from postings alone."""
    words = df.select(F.col(f"`{key}`").alias("key"), terms.alias("w"))
    flat = words.select("key", F.size("w").alias("len"), F.posexplode("w").alias("pos", "term"))
    return flat.groupBy("term", "key", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"), (F.min("pos") == 0).alias("first"))


def write_postings(found: DataFrame, path: str) -> DataFrame:
    """Postings as a table sorted by term, so that a search reads the row groups of its terms. A frequent term's list is cut over
    several files, as the range exchange goes by term and key."""
    found.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.option("parquet.block.size", 8 << 20).parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def totals(found: DataFrame) -> DataFrame:
    """One row: rows with terms, and terms in all."""
    return found.agg(F.sum(F.col("first").cast("int")).alias("__n"), F.sum("tf").alias("__all"))


def indexed(found: DataFrame, query: list[str], name: str | None, whole: DataFrame) -> DataFrame:
    """(key, score) of the rows that hold all terms of the query; score is named name, or left out. whole: the one row of totals."""
    if not query:
        return found.where(F.lit(False)).select("key", *([F.lit(0.0).alias(name)] if name else []))
    mine = found.where(F.col("term").isin(*query))
    tf = [F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"__tf{i}") for i, t in enumerate(query)]
    hits = mine.groupBy("key", "len").agg(*tf).dropna(subset=[f"__tf{i}" for i in range(len(query))])
    if name is None:
        return hits.select("key")
    known = mine.agg(*(F.sum(F.when(F.col("term") == t, 1).otherwise(0)).alias(f"__df{i}") for i, t in enumerate(query)))
    hits = hits.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(whole))  # one row each
    score, ratio = F.lit(0.0), F.col("len") / (F.col("__all") / F.col("__n"))
    for i in range(len(query)):
        score = score + _weight(F.col("__n"), F.col(f"__df{i}"), F.col(f"__tf{i}").cast("double"), ratio)
    return hits.select("key", F.coalesce(score, F.lit(0.0)).alias(name))


def _weight(n: Column, df: Column, tf: Column, ratio: Column) -> Column:
    """BM25 of one term: rows n, df of them with the term, tf times in this one, whose length is ratio times the mean."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * ratio))


def holding(df: DataFrame, value: Column, terms: Column, query: list[str], lowercase: bool = True) -> DataFrame:
    """Rows that hold all terms of the query. A term is part of the text it comes from, so plain substring tests go first and
    spare most texts their analysis."""
    if not query:
        return df.where(F.lit(False))
    for t in query:
        df = df.where(F.contains(F.lower(value) if lowercase else value, F.lit(t)))
    return df.where(F.forall(F.array(*map(F.lit, query)), lambda t: F.array_contains(terms, t)))


def bm25(df: DataFrame, terms: Column, query: list[str], name: str, scored: DataFrame | None = None) -> DataFrame:
    """``scored`` (rows of df, default all) with a column of BM25 scores. Statistics are over all rows of df: one aggregate, whose
    single row joins as a broadcast."""
    n = F.size("__terms")
    stats = [F.sum(F.when(n > 0, 1).otherwise(0)).alias("__n"), F.avg(F.when(n > 0, n)).alias("__avg")]
    stats += [F.sum(F.when(F.array_contains("__terms", t), 1).otherwise(0)).alias(f"__df{i}") for i, t in enumerate(query)]
    whole = df.select(terms.alias("__terms")).agg(*stats)
    joined = (df if scored is None else scored).withColumn("__terms", terms).crossJoin(F.broadcast(whole))  # one row
    score = F.lit(0.0)
    for i, t in enumerate(query):
        tf, d = frequency(F.col("__terms"), t).cast("double"), F.col(f"__df{i}")
        ratio = F.when(F.col("__avg") > 0, n / F.col("__avg")).otherwise(1.0)
        score = score + F.when(tf > 0, _weight(F.col("__n"), d, tf, ratio)).otherwise(0.0)
    return joined.withColumn(name, F.coalesce(score, F.lit(0.0))).drop("__n", "__avg", "__terms", *(f"__df{i}" for i in range(len(query))))


def normalised(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with column scaled to 0..1 over all rows; 0.5 where all are equal."""
    low, high = F.col("__low"), F.col("__high")
    joined = df.crossJoin(F.broadcast(df.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))))  # one row
    return joined.withColumn(name, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(0.5)).drop("__low", "__high")


def highlight(v: Value, terms: list[str], *marks: Value) -> Value:
    """Each occurrence of a term, whatever its case, between marks."""
    out, kind = text(v), T.StringType()
    opened, closed = (marks[0].col, marks[1].col) if len(marks) > 1 else (F.lit("<em>"), F.lit("</em>"))
    if terms:
        pattern = "(?iu)(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + ")"
        out = F.regexp_replace(out, F.lit(pattern), F.concat(opened, F.lit("$1"), closed))
    return Value(out, kind)
