"""Documents to training tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import bpe, decontaminate, jaccard, langid, toxicity
from redactlake.llm.queries import fold, scratch
from redactlake.llm.shipping import ship
from redactlake.llm.vocabularies import BYTE_BPE, vocabulary_path
from redactlake.sources.tables import spread


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


#: Bytes of a batch that Spark hands to Python; whole texts fill large ones, which JVM and Python hold at once.
DEFAULT_BATCH_BYTES, BATCH_BYTES = "67108864b", "4m"


def _prepare(spark: SparkSession) -> None:
    """The package on the executors, and smaller batches than Spark's default, unless the session sets its own."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough confidence; learned from their own labels."""
    _prepare(spark)
    docs = spread(docs, "doc_id")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = langid.train(docs.filter(~held_out), "doc_id", "text", "lang")
    return langid.predict(docs, model).filter(~F.col("lang_rejected")).select(*_names(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    _prepare(spark)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out)
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    return toxicity.score(docs, model).filter("toxic = 0").select(*_names(docs))


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """With a number for each row, stored once.

    The number depends on how Spark splits the files, which may differ from scan to scan, so rows
    are told apart only by numbers read from this one table.
    """
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    numbered, path = docs.withColumn(name, F.monotonically_increasing_id()), f"{scratch(spark)}/numbered"
    numbered.write.parquet(path)
    return spark.read.schema(numbered.schema).parquet(path), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents: that with the least id, then the first of them.

    Texts without words are in no group and stay; so does one of a group without ids.
    """
    _prepare(spark)
    numbered, row = _numbered(spark, docs)
    # Null ids rank last.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(row).alias("row"))
    grouped = jaccard.group_similar(numbered.select(key.alias("key"), "text"), "key", "text", scratch(spark))
    extra = grouped.filter(F.col("key") != F.col("component_id")).select(F.col("key.row").alias(row))
    return numbered.join(extra, row, "left_anti").select(*_names(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    numbered, row = _numbered(spark, docs)
    hits = decontaminate.find_hits(numbered.select(row, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return numbered.join(hits.filter(F.size("spans") > 0).select(row), row, "left_anti").select(*_names(docs))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text decoded from them."""
    _prepare(spark)
    path = vocabulary_path(BYTE_BPE)
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.round_trip_documents(docs.select(*kept, "text"), path).select(
        *kept,
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_tokens),
]

#: Trained models, similarity groups and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is stored in the shared folder before the next one starts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch(spark)}/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
