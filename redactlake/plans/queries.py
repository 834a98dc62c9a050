"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import badges as B
from ..operators import inventory as I
from ..operators import matching as M
from ..operators import propose as P
from ..operators import redact as R
from ..operators import restore as S
from ..operators.numbering import number_rows
from ..operators.segments import mask_documents, segment_documents
from ..operators.spans import select_spans as select_spans_of
from ..runtime import ensure_checkpoint_dir, materialize
from ..sources import corpus, store
from ..sources.tables import read_documents, read_table, spread
from . import derived, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def _derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    tables = {t: _table(spark, sf, t) for t in derived.tables_of(name)}
    if name in ("markdown", "tagged"):  # texts are made of these rows
        tables = {t: spread(df) for t, df in tables.items()}
    df = spark.sql(derived.DERIVED[name], **tables)
    return df.withColumnRenamed("descr", "desc") if "descr" in df.columns else df


def _inventory(spark: SparkSession, sf: str, items: str, aliases: str) -> I.Inventory:
    return I.Inventory(_derived(spark, sf, items), _derived(spark, sf, aliases))


def _wide(df: DataFrame) -> DataFrame:
    """Integers as bigint, so that both engines show the same type."""
    return df.select(
        *[F.col(n).cast("bigint").alias(n) if t in ("int", "smallint") else F.col(n) for n, t in df.dtypes]
    )


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_documents(spark, f"{sf}/documents.parquet", ["doc_id"], schema="doc_id bigint, text string")


def _document_badges(spark: SparkSession, sf: str) -> DataFrame:
    raw = P.propose_by_rules(_documents(spark, sf), ["doc_id"])
    return P.parse_proposals(raw, ["doc_id"]).withColumn("ord", F.struct("doc_id", "line_no"))


def _document_inventory(spark: SparkSession, sf: str) -> I.Inventory:
    """The inventory the rule proposer finds in the documents."""
    inv = I.merge_badges(I.empty_inventory(spark), _document_badges(spark, sf)).inventory
    return inv


def _document_matcher(spark: SparkSession, sf: str) -> tuple[I.Inventory, M.Matcher]:
    inv = _document_inventory(spark, sf)
    return inv, R.matcher_for(inv)


def _customer_inventory(spark: SparkSession, sf: str) -> I.Inventory:
    return _inventory(spark, sf, "customer_items", "customer_aliases")


def _word_inventory(spark: SparkSession, sf: str) -> I.Inventory:
    """All long words of the turns in order of first use, with their lower-case forms as alias 1."""
    turns = _table(spark, sf, "conversations")
    found = turns.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("place", "word"))
    first = found.groupBy("word").agg(F.min(F.struct("conv_id", "turn", "place")).alias("first"))
    words = number_rows(first, ["first"], name="item_pos").select("item_pos", "word")
    items = words.select(
        "item_pos",
        (F.col("item_pos") + 1).alias("id"),
        F.lit("(1)(A)(b)").alias("code"),
        F.lit("word").alias("desc"),
        F.col("word").alias("surface"),
        F.lit("global").alias("scope"),
    )
    aliases = words.select(
        "item_pos",
        (F.col("item_pos") + 1).alias("item_id"),
        F.lit(0).cast("bigint").alias("alias_pos"),
        F.lit(1).cast("bigint").alias("alias_id"),
        F.lower("word").alias("surface"),
    )
    return I.Inventory(items, aliases)


def _host_inventory(spark: SparkSession, sf: str) -> I.Inventory:
    items = _derived(spark, sf, "hosts").select(
        "item_pos",
        (F.col("item_pos") + 1).alias("id"),
        F.lit("(3)(B)(c)").alias("code"),
        F.lit("host name").alias("desc"),
        F.col("host").alias("surface"),
        F.lit("global").alias("scope"),
    )
    return I.Inventory(items, I.empty_inventory(spark).aliases)


# --- badges -----------------------------------------------------------------


@query
def badge_parse_arrow(spark, sf):
    parsed = B.parse_badges(_derived(spark, sf, "arrow_lines"))
    return parsed.select("line_no", "kind", "code", "desc", "surface")


@query
def badge_parse_pipe(spark, sf):
    parsed = B.parse_badges(_derived(spark, sf, "pipe_lines"))
    return parsed.select("line_no", "kind", "code", "desc", "surface")


def _all_lines(spark, sf):
    return _derived(spark, sf, "arrow_lines").unionByName(_derived(spark, sf, "pipe_lines"))


@query
def badge_errors(spark, sf):
    return B.invalid_badges(B.parse_badges(_all_lines(spark, sf))).select("src", "line_no", "error")


@query
def badge_validate_counts(spark, sf):
    counts = B.validation_counts(B.parse_badges(_derived(spark, sf, "arrow_lines")), ["src"])
    return _wide(counts)


@query
def code_filter(spark, sf):
    code = F.col("code")
    parts = [v.alias(k) for k, v in T.code_parts(code).items()]
    return _derived(spark, sf, "codes").filter(T.is_code(code)).select("c_custkey", "code", *parts)


@query
def split_lines(spark, sf):
    lines = B.badge_lines(_documents(spark, sf), "text", ["doc_id"])
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.md5("raw").alias("line_md5"))


# --- proposals and inventory ----------------------------------------------------


@query
def propose_badges(spark, sf):
    return _wide(_document_badges(spark, sf).drop("ord"))


@query
def propose_with_hook(spark, sf):
    """A user-supplied proposer over prompts; here it looks for mail addresses in the text section."""
    docs = _documents(spark, sf)
    prompts = P.build_prompts(docs, I.empty_inventory(spark), "Mail addresses are (1)(A)(c).", ["doc_id"])

    def proposer(batch):
        text = batch["user"].str.split("--- Text ---", n=1).str[1].str.rsplit("--- Task ---", n=1).str[0]
        hits = text.str.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
        return hits.map(lambda h: "\n\n".join(f"(1)(A)(c) | email address | {s}" for s in h))

    raw = P.propose(prompts, proposer, ["doc_id"])
    return _wide(P.parse_proposals(raw, ["doc_id"]))


@query
def import_inventory(spark, sf):
    return _document_inventory(spark, sf).items.select("item_pos", "id", "code", "desc", "surface", "scope")


@query
def merge_existing(spark, sf):
    """Customers' badges merged into the suppliers' inventory: the item of each badge."""
    inv = _inventory(spark, sf, "supplier_items", "supplier_aliases")
    badges = _derived(spark, sf, "customer_badges")
    result = I.merge_badges(inv, badges)
    return I.assign_badges(result, badges).select("ord", "code", "desc", "surface", "item_id", "is_new")


@query
def merge_upsert(spark, sf):
    """The inventory after that merge."""
    inv = _inventory(spark, sf, "supplier_items", "supplier_aliases")
    merged = I.merge_badges(inv, _derived(spark, sf, "customer_badges")).inventory
    return merged.items.select("item_pos", "id", "code", "desc", "surface", "scope")


@query
def next_id(spark, sf):
    following = I.next_item_id(_derived(spark, sf, "customer_items"))
    return spark.range(1).select(F.lit(following).cast("bigint").alias("next_id"))


@query
def alias_add(spark, sf):
    _, results = I.add_aliases(_customer_inventory(spark, sf), _derived(spark, sf, "alias_requests"))
    return results.select("ord", "item_id", "surface", "alias_id")


@query
def alias_append(spark, sf):
    inv, _ = I.add_aliases(_customer_inventory(spark, sf), _derived(spark, sf, "alias_requests"))
    return inv.aliases.select("item_pos", "item_id", "alias_pos", "alias_id", "surface")


@query
def item_lookup(spark, sf):
    found = I.find_items(_customer_inventory(spark, sf), _derived(spark, sf, "alias_keys").drop("alias_id"))
    return found.select("o_orderkey", "item_id", "code", "desc", "surface")


@query
def alias_lookup(spark, sf):
    return I.find_aliases(_customer_inventory(spark, sf), _derived(spark, sf, "alias_keys")).select(
        "o_orderkey", "item_id", "alias_id", "surface"
    )


@query
def pattern_set(spark, sf):
    return I.pattern_set(_inventory(spark, sf, "equal_items", "equal_aliases"))


@query
def list_items(spark, sf):
    return I.list_items(_customer_inventory(spark, sf))


@query
def alias_list(spark, sf):
    """The aliases of the item with the highest id."""
    inv = _customer_inventory(spark, sf)
    return I.list_aliases(inv, I.next_item_id(inv.items) - 1)


@query
def inventory_snapshot(spark, sf):
    return I.snapshot(_customer_inventory(spark, sf))


@query
def inventory_json(spark, sf):
    """Saved as a JSON file and loaded again."""
    path = f"{_scratch(spark)}/inventory.json"
    store.save_json(_customer_inventory(spark, sf), path)
    back = store.load_json(spark, path)
    items = back.items.select("item_pos", "id", "surface", F.lit(-1).cast("bigint").alias("alias_pos"), "code", "desc")
    none = F.lit(None).cast("string")
    aliases = back.aliases.select(
        "item_pos", F.col("alias_id").alias("id"), "surface", "alias_pos", none.alias("code"), none.alias("desc")
    )
    return items.unionByName(aliases)


@query
def inventory_store(spark, sf):
    """The table form written and read back."""
    path = _scratch(spark)
    store.save_tables(_customer_inventory(spark, sf), path)
    inv = store.load_tables(spark, path)
    return I.pattern_set(inv)


@query
def build_prompts(spark, sf):
    inv = _customer_inventory(spark, sf)
    prompts = P.build_prompts(_documents(spark, sf), inv, "The policy.", ["doc_id"])
    return prompts.select("doc_id", F.length("user").cast("bigint").alias("n_chars"), F.md5("user").alias("user_md5"))


# --- segments, matching, redaction ---------------------------------------------


@query
def segment_markdown(spark, sf):
    docs = _derived(spark, sf, "markdown")
    return _wide(segment_documents(docs, ["doc_id"]))


@query
def mask_tags(spark, sf):
    docs = _derived(spark, sf, "tagged")
    return mask_documents(docs).select("doc_id", "masked")


@query
def match_all(spark, sf):
    _, matcher = _document_matcher(spark, sf)
    return _match_rows(M.match_all(_documents(spark, sf), matcher, ["doc_id"]))


def _match_rows(df):
    return _wide(df.select("doc_id", "doc_start", "start", "end", "seg_no", "item_id", "variant", "alias_id", "surface"))


@query
def match_all_large_inventory(spark, sf):
    """The same through the bitmap screen and the salted join, as for an inventory beyond broadcast size."""
    matcher = R.matcher_for(_document_inventory(spark, sf), max_broadcast_bytes=0)
    return _match_rows(M.match_all(_documents(spark, sf), matcher, ["doc_id"]))


@query
def match_markdown(spark, sf):
    docs = _derived(spark, sf, "markdown")
    matcher = R.matcher_for(_customer_inventory(spark, sf))
    return _match_rows(M.match_all(docs, matcher, ["doc_id"]))


@query
def select_spans(spark, sf):
    spans = _derived(spark, sf, "spans")
    return select_spans_of(spans, ["doc_id"], "start", "stop").select("doc_id", "start", "stop")


@query
def select_spans_null_key(spark, sf):
    """The spans of supplier 1 without a key."""
    spans = _derived(spark, sf, "spans").withColumn("doc_id", F.expr("nullif(doc_id, 1)"))
    return select_spans_of(spans, ["doc_id"], "start", "stop").select("doc_id", "start", "stop")


@query
def select_matches(spark, sf):
    """Overlapping word matches of the conversations, resolved."""
    docs = _conversations(spark, sf)
    rows = M.match_all(docs, R.matcher_for(_word_inventory(spark, sf)), ["doc_id"], select=True)
    return _match_rows(rows)


def _redacted(df: DataFrame, *keys: str) -> DataFrame:
    return _wide(df.select(*keys, "n_matches", "redacted"))


@query
def redact_documents(spark, sf):
    _, matcher = _document_matcher(spark, sf)
    return _redacted(R.redact_documents(_documents(spark, sf), matcher, ["doc_id"]), "doc_id")


@query
def redact_documents_large_inventory(spark, sf):
    matcher = R.matcher_for(_document_inventory(spark, sf), max_broadcast_bytes=0)
    return _redacted(R.redact_documents(_documents(spark, sf), matcher, ["doc_id"]), "doc_id")


@query
def redact_markdown(spark, sf):
    matcher = R.matcher_for(_customer_inventory(spark, sf))
    return _redacted(R.redact_documents(_derived(spark, sf, "markdown"), matcher, ["doc_id"]), "doc_id")


def _conversations(spark, sf):
    docs = read_documents(spark, f"{sf}/conversations.parquet", ["conv_id", "turn"], schema="conv_id bigint, turn bigint, text string")
    return docs.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")


@query
def redact_conversations(spark, sf):
    matcher = R.matcher_for(_word_inventory(spark, sf))
    return _redacted(R.redact_documents(_conversations(spark, sf), matcher, ["doc_id"]), "doc_id")


def _pages(spark, sf):
    return read_documents(spark, f"{sf}/pages.parquet", ["page_id"], "html", "page_id bigint, html string")


@query
def redact_pages(spark, sf):
    matcher = R.matcher_for(_host_inventory(spark, sf))
    return _redacted(R.redact_documents(_pages(spark, sf), matcher, ["page_id"], "html"), "page_id")


def _benchmark(spark, sf):
    return read_documents(spark, f"{sf}/benchmark.parquet", ["item_id"], schema="item_id bigint, text string")


@query
def redact_benchmark(spark, sf):
    """A key called like a column of the matches."""
    _, matcher = _document_matcher(spark, sf)
    return _redacted(R.redact_documents(_benchmark(spark, sf), matcher, ["item_id"]), "item_id")


@query
def redact_benchmark_large_inventory(spark, sf):
    matcher = R.matcher_for(_document_inventory(spark, sf), max_broadcast_bytes=0)
    return _redacted(R.redact_documents(_benchmark(spark, sf), matcher, ["item_id"]), "item_id")


@query
def redact_null_keys_large_inventory(spark, sf):
    """Documents half of which have no key."""
    matcher = R.matcher_for(_document_inventory(spark, sf), max_broadcast_bytes=0)
    docs = _documents(spark, sf).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 1, F.col("doc_id")))
    return _redacted(R.redact_documents(docs, matcher, ["doc_id"]), "doc_id")


@query
def redact_empty_inventory(spark, sf):
    matcher = R.matcher_for(I.empty_inventory(spark))
    return _redacted(R.redact_documents(_documents(spark, sf), matcher, ["doc_id"]), "doc_id")


@query
def match_counts(spark, sf):
    _, matcher = _document_matcher(spark, sf)
    return _wide(R.match_counts(R.redact_documents(_documents(spark, sf), matcher, ["doc_id"]), ["doc_id"]))


@query
def match_total(spark, sf):
    _, matcher = _document_matcher(spark, sf)
    return R.match_totals(R.redact_documents(_documents(spark, sf), matcher, ["doc_id"]))


# --- restoring and audits ----------------------------------------------------------


@query
def parse_tags(spark, sf):
    return _wide(S.parse_tags(_derived(spark, sf, "tagged"), ["doc_id"]))


@query
def restore_tagged(spark, sf):
    docs = _derived(spark, sf, "tagged")
    restored = S.restore_documents(docs, _customer_inventory(spark, sf), ["doc_id"])
    return _wide(restored.select("doc_id", "n_tags", "restored"))


@query
def restore_tagged_large_inventory(spark, sf):
    docs = _derived(spark, sf, "tagged")
    restored = S.restore_documents(docs, _customer_inventory(spark, sf), ["doc_id"], max_broadcast_bytes=0)
    return _wide(restored.select("doc_id", "n_tags", "restored"))


@query
def restore_shared_keys_large_inventory(spark, sf):
    """Many documents with the same key stay apart."""
    docs = _derived(spark, sf, "tagged").withColumn("doc_id", F.col("doc_id") % 5)
    restored = S.restore_documents(docs, _customer_inventory(spark, sf), ["doc_id"], max_broadcast_bytes=0)
    return _wide(restored.select("doc_id", "n_tags", "restored"))


@query
def unredact_documents(spark, sf):
    inv, matcher = _document_matcher(spark, sf)
    redacted = R.redact_documents(_documents(spark, sf), matcher, ["doc_id"]).select("doc_id", "redacted")
    return _wide(S.restore_documents(redacted, inv, ["doc_id"], "redacted").select("doc_id", "n_tags", "restored"))


@query
def roundtrip_audit(spark, sf):
    inv, matcher = _document_matcher(spark, sf)
    return _wide(A.roundtrip(_documents(spark, sf), inv, matcher, ["doc_id"]))


@query
def roundtrip_audit_markdown(spark, sf):
    """Texts that already hold tags of known items do not come back equal, and the audit says so."""
    inv = _customer_inventory(spark, sf)
    return _wide(A.roundtrip(_derived(spark, sf, "markdown"), inv, R.matcher_for(inv), ["doc_id"]))


@query
def idempotency_audit(spark, sf):
    _, matcher = _document_matcher(spark, sf)
    return _wide(A.idempotency(_documents(spark, sf), matcher, ["doc_id"]))


# --- runs, files -----------------------------------------------------------------


def _autoredact(spark, sf):
    docs = _documents(spark, sf)
    raw = materialize(P.propose_by_rules(docs, ["doc_id"]))
    return jobs.autoredact_documents(docs, I.empty_inventory(spark), raw, ["doc_id"], ["doc_id"])


@query
def autoredact_stats(spark, sf):
    return _autoredact(spark, sf).stats


@query
def autoredact_documents(spark, sf):
    return _redacted(_autoredact(spark, sf).redacted, "doc_id")


@query
def output_names(spark, sf):
    """Text files among the paths, in component order, with the name of their redacted copy."""
    path = F.col("rel_path")
    paths = _derived(spark, sf, "paths").filter(corpus.has_text_extension(path))
    numbered = number_rows(paths.withColumn("parts", corpus.path_order(path)), ["parts"], name="path_no")
    return numbered.select("rel_path", corpus.output_name(path).alias("out_path"), "path_no")


def _scratch(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


#: How the pages are named as files; some names are of the kind Spark's file index passes over.
PAGE_PATH = "concat('p', page_id % 16, CASE page_id % 5 WHEN 0 THEN '/_' WHEN 1 THEN '/.x' ELSE '/' END, page_id, '.md')"


def _page_files(spark, sf, root):
    docs = _pages(spark, sf).select(F.expr(PAGE_PATH).alias("rel_path"), "html")
    return corpus.write_files(docs, root, text="html")


@query
def corpus_files(spark, sf):
    """Pages written as one file each and scanned back."""
    root = _scratch(spark)
    _page_files(spark, sf, root)
    return corpus.read_markdown(spark, root).select("rel_path", F.md5("text").alias("text_md5"))


@query
def text_files(spark, sf):
    """The same through the scan for text files of any kind."""
    root = _scratch(spark)
    _page_files(spark, sf, root)
    return corpus.read_text_files(spark, root).select("rel_path", F.md5("text").alias("text_md5"))


def _saved_customers(spark, sf, path):
    store.save(_customer_inventory(spark, sf), path)
    return path


def _customer_files(spark, sf, root):
    docs = _derived(spark, sf, "markdown").select(F.expr("concat(doc_id, '.md')").alias("rel_path"), "text")
    corpus.write_files(docs, root)
    return root


@query
def redact_folder(spark, sf):
    """The counts of a folder redacted with an inventory file."""
    root = _scratch(spark)
    src, inv = _customer_files(spark, sf, f"{root}/src"), _saved_customers(spark, sf, f"{root}/inventory.json")
    run = jobs.redact_folder(spark, src, f"{root}/redacted", inv)
    return _wide(run.counts.select(F.expr("cast(replace(rel_path, '.md', '') as bigint)").alias("doc_id"), "n_matches"))


@query
def redact_folder_files(spark, sf):
    """The files such a run leaves."""
    root = _scratch(spark)
    src, inv = _customer_files(spark, sf, f"{root}/src"), _saved_customers(spark, sf, f"{root}/inventory.json")
    jobs.redact_folder(spark, src, f"{root}/redacted", inv)
    files = corpus.read_markdown(spark, f"{root}/redacted")
    return files.select(F.expr("cast(replace(rel_path, '.md', '') as bigint)").alias("doc_id"), F.col("text").alias("redacted"))


#: Documents of a lot that lies as files at once, until there are ``MOST_LOTS`` lots; from then on lots grow.
LOT_FILES, MOST_LOTS = 100_000, 96


def _in_lots(docs: DataFrame, root: str, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """All rows of ``run(lot, folder)`` over lots of ``docs`` (rel_path, text), dealt by path so that equal ones are together.

    A file takes a block of disk however short it is. What ``run`` leaves in a lot's folder is removed when its rows are stored.
    """
    spark, rows = docs.sparkSession, docs.count()
    lots = min(MOST_LOTS, max(1, -(-rows // LOT_FILES)))
    dealt = docs.withColumn("lot", F.pmod(F.xxhash64("rel_path"), F.lit(lots)))
    dealt.write.partitionBy("lot").parquet(f"{root}/lots")
    stored = spark.read.schema(dealt.schema).parquet(f"{root}/lots")
    cores = spark.sparkContext.defaultParallelism
    for lot in sorted(r[0] for r in stored.select("lot").distinct().collect()) or [0]:
        folder = f"{root}/lot-{lot}"
        done = run(stored.filter(F.col("lot") == lot).drop("lot").repartition(cores), folder)
        done.write.mode("append").parquet(f"{root}/done")
        corpus.remove_folder(spark, folder)
    return spark.read.schema(done.schema).parquet(f"{root}/done")


@query
def restore_folder(spark, sf):
    """Tagged orders as files, restored by the job; large tables in lots."""
    root = _scratch(spark)
    docs = _derived(spark, sf, "tagged").select(F.expr("concat(doc_id % 8, '/', doc_id, '.md')").alias("rel_path"), "text")
    # The file is read once, not once for each lot. What lots look up in the tables made of it is kept: Spark knows it by its plan.
    inv = f"{root}/inventory"
    store.save(store.load(spark, _saved_customers(spark, sf, f"{root}/inventory.json")), inv)
    tables = store.load(spark, inv)
    kept = [I.by_id(tables).persist(), I.alias_surfaces(tables).persist()]

    def restored(lot, folder):
        corpus.write_files(lot, f"{folder}/src")
        counts = jobs.restore_folder(spark, f"{folder}/src", f"{folder}/restored", inv)
        texts = corpus.read_markdown(spark, f"{folder}/restored")
        doc_id = F.expr("cast(split(replace(rel_path, '.md', ''), '/')[1] as bigint)").alias("doc_id")
        return _wide(counts.join(texts, "rel_path").select(doc_id, "n_tags", F.col("text").alias("restored")))

    try:
        return _in_lots(docs, root, restored)
    finally:
        for table in kept:
            table.unpersist()


def _rule_proposer():
    """A proposer that answers a prompt with the badge lines that the default rules find in it."""
    rules = [(f"[REDACTED: {r.code}, {r.desc}] => ", r.pattern) for r in P.DEFAULT_RULES]

    def propose(batch):
        import re

        found = ([head + s for head, pattern in rules for s in dict.fromkeys(re.findall(pattern, user))] for user in batch["user"])
        return ["\n".join(lines) for lines in found]

    return propose


@query
def autoredact_folder(spark, sf):
    """Documents as text files, badges proposed inside the tasks, and the redacted files that the job leaves."""
    root = _scratch(spark)
    docs = _documents(spark, sf).select(F.expr("concat(lpad(doc_id, 12, '0'), '.txt')").alias("rel_path"), "text")
    corpus.write_files(docs, f"{root}/src")
    policy = spark.createDataFrame([("Hide what tells who or where somebody is.",)], "value string")
    policy.coalesce(1).write.text(f"{root}/policy")
    jobs.autoredact_folder(spark, f"{root}/policy", f"{root}/src", f"{root}/out", _rule_proposer())
    found = corpus.read_text_files(spark, f"{root}/out/redacted")
    return found.select(F.expr("cast(substring_index(rel_path, '.', 1) as bigint)").alias("doc_id"), F.col("text").alias("redacted"))


@query
def import_badges_job(spark, sf):
    """A new inventory, badge files imported into it, and what it then lists; the job tells how many badges it read."""
    root = _scratch(spark)
    raw = P.propose_by_rules(_documents(spark, sf), ["doc_id"]).filter("raw != ''")
    corpus.write_files(raw.select(F.expr("concat(lpad(doc_id, 12, '0'), '.txt')").alias("rel_path"), F.col("raw").alias("text")), f"{root}/badges")
    store.init(spark, f"{root}/inventory.json")
    n_badges = jobs.import_badges(spark, f"{root}/badges", f"{root}/inventory.json")
    items = store.load(spark, f"{root}/inventory.json").items
    return items.select("id", "code", "desc", "surface", F.lit(n_badges).cast("bigint").alias("n_badges"))


@query
def alias_add_job(spark, sf):
    """Alias requests on a stored inventory: their outcomes, with the alias that is stored afterwards."""
    path = f"{_scratch(spark)}/inventory"
    store.save(_customer_inventory(spark, sf), path)
    requests = _derived(spark, sf, "alias_requests")
    results = jobs.add_aliases(spark, path, requests)
    stored = store.load(spark, path).aliases.select("item_id", "alias_id", F.col("surface").alias("stored"))
    return results.join(stored, ["item_id", "alias_id"], "left").select("ord", "item_id", "surface", "alias_id", "stored")


def _badge_file(spark, sf, path):
    lines = _derived(spark, sf, "arrow_lines").orderBy("src", "line_no")
    lines.select(F.col("raw").alias("value")).write.text(path)
    return path


@query
def badge_files(spark, sf):
    """Badge lines written as text files and read back; every line is read or told why not."""
    path = _badge_file(spark, sf, f"{_scratch(spark)}/badges")
    parsed = B.parse_badges(corpus.read_badge_files(spark, path))
    return parsed.groupBy("kind", "code", "desc", "surface").agg(F.count("*").alias("n_lines"))


@query
def validate_badges_job(spark, sf):
    path = _badge_file(spark, sf, f"{_scratch(spark)}/badges")
    counts = jobs.validate_badges(spark, path)
    return counts.agg(F.sum("n_valid").cast("bigint").alias("n_valid"), F.sum("n_skipped").cast("bigint").alias("n_skipped"))


@query
def lenient_decode(spark, sf):
    """Bytes that are not UTF-8 are dropped; a replacement character that was in the text stays."""
    broken: Column = F.concat(F.unhex(F.lit("FFEFBFBD")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    docs = _documents(spark, sf).select("doc_id", corpus.decode_utf8(broken, "ignore").alias("text"))
    return docs.select("doc_id", F.md5("text").alias("text_md5"))
