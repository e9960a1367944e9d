"""Input tables for the registered queries: the given parquet tables and a few derived views
(NULLs injected by a fixed rule so the missing-value operators have work; every row kept)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table_path, written


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return rebalance(spark.read.parquet(table_path(sf, name)))


SMALL_INPUT_BYTES = 1 << 30


#: Up to this estimate a table that several jobs scan is held in memory.
KEPT_BYTES = 128 << 20


def kept(df: DataFrame) -> DataFrame:
    """A derived frame that several fits will scan: persisted when Catalyst's size estimate is at most
    ``KEPT_BYTES``; a larger one is written once to the shared folder, so that the jobs neither compute it
    again nor hold it in memory, and read only the columns they use."""
    from ..functions.order_stats import estimated_bytes
    if estimated_bytes(df) <= KEPT_BYTES:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return written(df, "kept")


def rebalance(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than the cluster has cores (a file holding a
    single parquet row group is read by one task). Such an input whose Catalyst size estimate
    is at most ``SMALL_INPUT_BYTES`` is also kept (up to ``KEPT_BYTES`` in memory, beyond that on disk) since the
    fits pass over it several times; lost blocks are recomputed from the files. Scans of large
    inputs already have many splits and are returned untouched."""
    from ..functions.order_stats import estimated_bytes
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    spread = df.repartition(target)
    size = estimated_bytes(df)
    if size <= SMALL_INPUT_BYTES:
        spread = spread.persist(StorageLevel.MEMORY_AND_DISK if size <= KEPT_BYTES else StorageLevel.DISK_ONLY)
    return spread


def events_nulls(spark, sf) -> DataFrame:
    """events with value NULL where event_id % 10 = 3 and props NULL where event_id % 7 = 2."""
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 10 == 3, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
                    F.when(F.col("event_id") % 7 == 2, F.lit(None).cast("string")).otherwise(F.col("props")).alias("props"))


def lineitem_nulls(spark, sf) -> DataFrame:
    """lineitem with l_quantity NULL where l_orderkey % 10 = 3."""
    li = table(spark, sf, "lineitem")
    return li.select(*[F.when(F.col("l_orderkey") % 10 == 3, F.lit(None).cast("double")).otherwise(F.col(c)).alias(c)
                       if c == "l_quantity" else F.col(c) for c in li.columns])


def customer_nulls(spark, sf) -> DataFrame:
    """customer with c_acctbal NULL where c_custkey % 10 = 3."""
    c = table(spark, sf, "customer")
    return c.select(*[F.when(F.col("c_custkey") % 10 == 3, F.lit(None).cast("double")).otherwise(F.col(k)).alias(k)
                      if k == "c_acctbal" else F.col(k) for k in c.columns])


def lineitem_keyed(spark, sf) -> DataFrame:
    """lineitem plus ``l_key``, a text key unique per row (ids and the price in cents)."""
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_key", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                              F.round(F.col("l_extendedprice") * 100).cast("long")))


def orders_flags(spark, sf) -> DataFrame:
    """orders plus two columns derived from it that happen to be constant on the data."""
    o = table(spark, sf, "orders")
    return o.withColumn("o_after_1990", (F.col("o_orderdate") >= F.lit("1990-01-01").cast("timestamp_ntz")).cast("int")) \
            .withColumn("o_neg_priority", F.when(F.col("o_totalprice") < 0, F.col("o_orderpriority")))


def labelled_documents(spark, sf) -> DataFrame:
    """documents joined to their quality / toxicity labels (numeric features + target)."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id")


# DuckDB text of the same derived views
EV_SQL = ("(SELECT event_id, ts, user_id, event_type, "
          "CASE WHEN event_id % 10 = 3 THEN NULL ELSE value END AS value, "
          "CASE WHEN event_id % 7 = 2 THEN NULL ELSE props END AS props FROM events)")
LQ_SQL = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, "
          "CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE l_quantity END AS l_quantity, "
          "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)")
CU_SQL = ("(SELECT c_custkey, c_name, c_nationkey, "
          "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer)")
LK_SQL = ("(SELECT *, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
          "CAST(round(l_extendedprice * 100) AS BIGINT)) AS l_key FROM lineitem)")
OF_SQL = ("(SELECT *, CAST(o_orderdate >= TIMESTAMP '1990-01-01' AS INTEGER) AS o_after_1990, "
          "CASE WHEN o_totalprice < 0 THEN o_orderpriority END AS o_neg_priority FROM orders)")
LD_SQL = "(SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def add_lineitem_key_and_nulls(li: DataFrame) -> DataFrame:
    """Row-wise (stream-safe) form of ``lineitem_keyed_nulls`` applied to any lineitem frame."""
    out = li.select(*[F.when(F.col("l_orderkey") % 10 == 3, F.lit(None).cast("double")).otherwise(F.col(c)).alias(c)
                      if c == "l_quantity" else F.col(c) for c in li.columns])
    return out.withColumn("l_key", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                               F.round(F.col("l_extendedprice") * 100).cast("long")))


def lineitem_keyed_nulls(spark, sf) -> DataFrame:
    """lineitem with the l_quantity NULL rule and the row key ``l_key``."""
    return add_lineitem_key_and_nulls(table(spark, sf, "lineitem"))
