"""A training-corpus pipeline over ``documents``: five stages, each one of the operators in lamina.llm.

Every stage takes all that the stage before it kept. Where a stage decides about rows in one reading and leaves them out in
another, a row is known by digests of its columns, never by its place in a file: file splits, and with them row numbers,
change with the number of cores. Rows that are equal in all columns are interchangeable.

Defined results, all stages: a null text counts as empty; null values of other columns are kept; texts are read whole,
however long; columns beyond those of ``documents`` are dropped; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm import bpe_codec, decontaminate, knn_quality, simhash_dedup, toxic_cnn
from lamina.llm.queries import shared_folder
from lamina.session import cut_lineage, remove_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Row digests (16 bytes each) that are broadcast to leave rows out; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with ``row``: two 64-bit digests of all their columns, which say which of them are null, too."""
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in COLUMNS])
    return docs.select(*COLUMNS).withColumn("row", F.struct(F.xxhash64(nulls, *COLUMNS).alias("a"), F.xxhash64(F.lit("row"), nulls, *COLUMNS).alias("b")))


def _without(keyed: DataFrame, rows: DataFrame, kind: str = "left_anti") -> DataFrame:
    """keyed(row, ...) without the rows(row), or with kind left_semi only those."""
    few = rows.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(rows) if few else rows, "row", kind)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the convolutional classifier calls toxic; repeated rows share their fate."""
    scored = toxic_cnn.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the nearest labelled neighbours vote to be of low quality; repeated rows share their fate."""
    scored = knn_quality.score_quality(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near-duplicates by five-word shingles.

    It is the one with the smallest doc_id (no doc_id comes last); ties fall to the smaller digest, and of rows that are
    equal in all columns one is left.
    """
    keyed = _keyed(docs)
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = simhash_dedup.similar_documents(keyed.select(named.alias("doc_id"), "text"), words=5, similarity=0.8)
    found = found.select("doc_id.row", (F.col("doc_id") != F.col("component_id")).alias("goes")).groupBy("row").agg(F.first("goes").alias("goes"), F.count("*").alias("n"))
    marked = cut_lineage(found.filter("goes or n > 1"))
    single = _without(keyed, marked.select("row")).select(*COLUMNS)
    repeated = cut_lineage(marked.filter("not goes").select("row"))
    if repeated.isEmpty():
        return single
    one = _without(keyed, repeated, "left_semi").groupBy("row").agg(F.first(F.struct(*COLUMNS)).alias("d"))
    return single.unionByName(one.select("d.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a copy of a benchmark item, edited or not; repeated rows share their fate."""
    keyed = _keyed(docs)
    found = decontaminate.contaminated(keyed.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(keyed, cut_lineage(found.select(F.col("doc_id").alias("row")).distinct())).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit), and whether decoding them gives the text back; repeated rows come out as often."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe_codec.encode(docs, path, pattern, keep=("doc_id", "lang", "source"), with_check=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("byte_bpe", byte_bpe),
]

#: The classifiers, links and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again, and removed when the next one is written."""
    folder, before = shared_folder(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
