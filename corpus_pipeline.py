"""The corpus pipeline: from documents to mixed, encoded training data in five stages.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame that is written as
Parquet and read again for the next one. All but the last return the columns of docs; the last returns the documents' places in
the token files. An empty table passes through every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm import common, decontaminate, mixing, similarity, token_output, toxicity
from mosaica.sources import storage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model is fitted on labelled documents of this stage's input.

    Null and empty texts hold no toxic word and stay; repeated rows are judged alike; all columns stay, whatever their names; without
    labels nothing goes."""
    model = toxicity.fit(*toxicity.labelled_sample(docs, common.table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity, the one with the smallest doc_id stays.

    doc_ids that several rows share, or that are null, do not name a row: such rows are told apart by a number of their own,
    in a second pass over those that the first one kept."""
    found = similarity.near_duplicates(docs)
    kept = common.stored(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").count(), "kept")
    once = kept.where("doc_id IS NOT NULL AND count = 1").select("doc_id")
    again = kept.where("doc_id IS NULL OR count > 1").select(F.col("doc_id").alias("_again"))
    first = docs.join(once.hint("merge"), "doc_id", "left_semi").select(*docs.columns)  # at every size: ids grow with the documents
    if again.isEmpty():
        return first
    rows = docs.join(again, docs["doc_id"].eqNullSafe(again["_again"]), "left_semi").select(*docs.columns)
    number = common.fresh("row", docs.columns)
    rows = common.stored(rows.withColumn(number, F.monotonically_increasing_id()), "rows")
    apart = similarity.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias(number))
    return first.union(rows.join(apart, number, "left_semi").select(*docs.columns))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist of them for the most part go.

    Null and empty texts stay; repeated rows are cut alike; all columns stay; without items nothing is cut."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix, at the sources' natural weights.

    Null sources are a source; null and empty texts have no length; rows that repeat a doc_id stand together; all columns stay."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents in the order of docs' files, which is the mix's; returns doc_id, start, n_tokens, ids_crc32 as
    read back from them. Null and empty texts have the end id alone; repeated rows stay; extra columns go; no rows give no files."""
    shards = token_output.write_tokens(docs, common.new_path(spark, "tokens"), as_stored=True)
    return token_output.read_tokens(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: A fitted model decides the first stage, so no SQL gives run()'s rows; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents. What a stage has written beside its result goes when the next one begins."""
    docs, earlier = common.table(spark, sf_dir, "documents"), set(storage.written(spark))
    for name, stage in STAGES:
        spent = [p for p in storage.written(spark)[:-1] if p not in earlier]
        if spent:
            storage.release(spark, *spent)
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
