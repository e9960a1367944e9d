"""Named sample tables: a registry from a name to one of the given tables, with the target
renamed and its codes decoded by a literal map (no download, no copy)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path

# fixed values: the registry of sample tables offered by name
SAMPLE_TABLES = {
    "lineitem_returns": {"table": "lineitem", "target": "l_returnflag", "rename": "return_status",
                         "labels": {"A": "accepted", "N": "none", "R": "returned"}},
    "embedding_digits": {"table": "embeddings", "target": "label", "rename": "digit",
                         "labels": {0: "zero", 1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six",
                                    7: "seven", 8: "eight", 9: "nine"}},
    "document_labels": {"table": "labels", "target": "toxic", "rename": "is_toxic", "labels": {0: "no", 1: "yes"}},
}


def sample_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spec = SAMPLE_TABLES[name]
    df = spark.read.parquet(table_path(sf_dir, spec["table"]))
    m = F.create_map(*[x for k, v in spec["labels"].items() for x in (F.lit(k), F.lit(v))])
    return df.select(*[F.col(c) for c in df.columns if c != spec["target"]],
                     m[F.col(spec["target"])].alias(spec["rename"]))
