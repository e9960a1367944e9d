"""The registered queries, one for each operator, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, linededup, packing, quality, simhash, spelling, substrings, tokencount, tokenfile, toxicity, urlfilter
from .common import read
from .sql import SQL

TOKEN_LIMIT = 4096
SITE_RULES = [urlfilter.SiteRule("net", "/", "block"), urlfilter.SiteRule("example.net", "/en/", "allow"),
              urlfilter.SiteRule("example.com", "/de/", "block"), urlfilter.SiteRule("org", "/fr/", "allow")]
PROBE_TEXT = "\\### Assistant: </turn> ok"


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.judge(read(spark, sf, "documents"))
    return out.drop("rejected_by")


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.scan(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = tokencount.token_counts(read(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), budget=TOKEN_LIMIT)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("fits") < F.col("n_chars")).alias("over_limit"), "prefix_counts")


def op4_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    back = chat.read_back(chat.format_conversations(rows.unionByName(probe)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def labelled_urls(spark: SparkSession, sf: str) -> DataFrame:
    """(url, block): pages whose document has a label; block if it is toxic or of low quality."""
    labels = read(spark, sf, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block"))
    labels = labels.filter("block is not null").groupBy("doc_id").agg(F.max("block").alias("block"))
    pages = read(spark, sf, "pages").select("url", urlfilter.document_number(F.col("url")).alias("doc_id"))
    return pages.filter("doc_id is not null").join(labels, "doc_id").select("url", "block")


def op5_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = urlfilter.mine(labelled_urls(spark, sf))
    return urlfilter.judge(read(spark, sf, "pages"), rules, SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = linededup.dedup(read(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").cast("long").alias("n_lines"), F.size("_ld_gone").cast("long").alias("n_removed"),
                      F.concat_ws(",", F.col("_ld_gone").cast("array<string>")).alias("removed_lines"), "text")


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack_documents(read(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = simhash.dedup_groups(read(spark, sf, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit_on(docs, read(spark, sf, "labels")))
    return scored.select("doc_id", (toxicity.fold_of("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    store = tokenfile.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_tokens(store, ids=False)


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(read(spark, sf, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substrings.dedup(read(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(read(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_token_counts, op4_chat_formatting, op5_url_filters,
                                   op6_line_dedup, op7_packing, op8_simhash_near_dedup, op9_toxicity, op10_token_files,
                                   op11_spelling_variants, op12_suffix_dedup, op13_collocations)}
ORACLES = {name: sql for name, sql in SQL.items() if name in QUERIES}
