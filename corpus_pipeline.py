"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination,
packing. Each stage takes what the one before it kept, written as Parquet and read again.

Stages keep all columns of their input; rows that a stage does not reject pass unchanged, but for
the texts that line dedup shortens. The last returns the pieces of the packed sequences.

* toxicity: documents with a score of 0.5 or more go.
* line_dedup: later similar lines go, and documents that lose all their lines with words.
* near_dedup: of documents reachable over fingerprints, one row stays: that with the smallest id,
  of those with that id the one whose text has the smallest hash. A row without an id is it only
  if no row of its group has one. Groups are told apart by fingerprint, never by id.
* decontamination: documents with any benchmark window go.
* packing: sequences of at most 2048 ids.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import decontaminate, linededup, packing, simhash, toxicity
from tabforge.llm.common import free_name, read, written

THRESHOLD = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on(docs, read(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "_cp_score")
    kept = docs.withColumn(score, toxicity.score_column(docs, model)).filter(F.col(score) < THRESHOLD)
    return kept.select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, gone = linededup.added_columns(docs)
    emptied = (F.size(gone) > 0) & (F.size(gone) == F.col(lines))
    return linededup.dedup(docs).filter(~emptied).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are named by id and text, so that rows without an id or with a repeated one keep apart: the
    name is the id (null last) and 128 bits of hashes of the text, and one name stays of each group, with the
    smallest row if several have that name (by JSON where a column is a map)."""
    names = docs.columns
    inner = [f"_c{i}" for i in range(len(names))]  # input columns may have any name
    d = docs.toDF(*inner)
    doc, text = inner[names.index("doc_id")], inner[names.index("text")]
    key = {"none": F.col(doc).isNull(), "id": F.col(doc), "hash": F.xxhash64(text), "more": F.xxhash64(F.lit(1), text)}
    d = d.withColumn("name", F.struct(*[c.alias(n) for n, c in key.items()]))
    groups = simhash.dedup_groups(d, id_col="name", text_col=text).filter("doc_id = component_id")
    stay = written(groups.groupBy("component_id").agg(F.count("*").alias("rows")).select("component_id.*", "rows"), "stay")
    same = [d.name[n].eqNullSafe(stay[n]) for n in key]
    kept = d.join(stay.filter("rows = 1"), same, "left_semi").select(inner)
    again = stay.filter("rows > 1")
    if not again.isEmpty():
        row = F.struct(*inner)
        # maps have no order, their JSON has
        least = F.min_by(row, F.to_json(row)) if "map<" in docs.schema.simpleString() else F.min(row)
        more = d.join(again, same, "left_semi").groupBy("name").agg(least.alias("r"))
        kept = kept.union(more.select(*[F.col("r")[c].alias(c) for c in inner]))
    return kept.toDF(*names)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: SQL can express neither the model nor the fingerprints; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; all but the last are written to the shared folder."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
