"""The training-data operators as queries over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ensure_checkpoint_dir
from ..sources.tables import spread
from . import bpe, chat, conversation_repair, decontaminate, hmm, html_text, jaccard, langid, phrases, quality, token_counts, toxicity, warc
from .shipping import ship
from .vocabularies import BYTE_BPE, vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return f(spark, sf)

    QUERIES[f.__name__] = run
    return run


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return spread(_table(spark, sf, "documents").select("doc_id", "text", *more), "doc_id")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


@query
def op10_bpe(spark, sf):
    """Every text to token ids and back."""
    return bpe.round_trip_documents(_documents(spark, sf), vocabulary_path(BYTE_BPE)).select(
        "doc_id",
        F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op5_langid(spark, sf):
    """The language of every text, learned from the folds other than 0."""
    docs = _documents(spark, sf, "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = langid.train(docs.filter(~held_out), "doc_id", "text", "lang")
    scored = langid.predict(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected")
    )


@query
def op2_toxicity(spark, sf):
    """The toxicity of every text, learned from labels outside fold 1."""
    docs = _documents(spark, sf)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = _table(spark, sf, "labels").select("doc_id", "toxic").filter(~held_out)
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted")
    )


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"


@query
def op4_arc_to_warc(spark, sf):
    """Pages as legacy archives, converted to WARC files, and the files read back."""
    pages = spread(_table(spark, sf, "pages").select("page_id", "url", "html"), "page_id")
    records = warc.mark_revisits(warc.convert(warc.to_arc(pages, "page_id", "url", "html")))
    folder = scratch(spark)
    warc.write_warc(records, folder)
    return warc.read_warc(spark, folder, with_payload=False).select(
        F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op8_quality(spark, sf):
    """Statistics of every text, the fixed rules and the trees' verdict."""
    docs = _documents(spark, sf)
    model = quality.train(docs, _table(spark, sf, "labels"), "doc_id", "text", "quality")
    judged = quality.judge(quality.add_statistics(docs), model)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


@query
def op9_chat_format(spark, sf):
    """Conversations formatted as token ids, and what can be read back from those."""
    turns = _table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    path = vocabulary_path(BYTE_BPE)
    return chat.read_back(chat.format_conversations(turns.unionByName(more), path), path)


@query
def op6_lm(spark, sf):
    """The log10 probability of every text, learned from the folds other than 1."""
    docs = _documents(spark, sf)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    scored = hmm.score_documents(docs.withColumn("learn", ~held_out), "doc_id", "text", "learn", scratch(spark))
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def contamination(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item, and the items' ids as a digest."""
    hits = decontaminate.find_hits(docs, _table(spark, sf, "benchmark"))
    n_hit = decontaminate.covered(F.col("spans")).cast("bigint")
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != "text"],
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op1_decontaminate(spark, sf):
    """Which words of every text some benchmark item holds."""
    return contamination(spark, _table(spark, sf, "documents").select("doc_id", "text"), sf)


@query
def op7_jaccard_join(spark, sf):
    """Groups of texts whose shingle sets are at least 75 % alike."""
    grouped = jaccard.group_similar(_documents(spark, sf), "doc_id", "text", scratch(spark))
    return grouped.select("doc_id", "n_shingles", "component_id")


@query
def op3_html_text(spark, sf):
    """The main text of every page."""
    pages = spread(_table(spark, sf, "pages").select("page_id", "url", "html"), "page_id")
    texts = html_text.extract(pages, html_text.train(pages, "page_id", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query
def op13_token_counts(spark, sf):
    """How many tokens every text has, and whether those are more than 512."""
    counted = token_counts.count_tokens(_documents(spark, sf), vocabulary_path(BYTE_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op12_phrases(spark, sf):
    """The best phrases of two to four words of every language."""
    return phrases.mine(spread(_table(spark, sf, "documents").select("text", "lang")), scratch(spark))


@query
def op11_conversation_repair(spark, sf):
    """Damaged conversations, what is wrong with them, and the cheapest edits that give them a proper form."""
    conversations = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    edits = conversation_repair.repair(conversation_repair.damage(conversations), scratch(spark))
    return conversation_repair.report(edits, conversations)
