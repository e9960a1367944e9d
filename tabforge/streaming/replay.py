"""The fitted pipeline on a stream: every stage is a per-row projection, so the replay is a
stateless streaming query (no watermark or state store needed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, table_path


def replay_stream(spark: SparkSession, pipeline, sf_dir: str, table: str, prepare=None,
                  keep: list[str] | None = None) -> DataFrame:
    """Read ``table`` as a file stream, apply ``prepare`` (row-wise) and the pipeline replay,
    write to a parquet sink in the shared checkpoint folder with ``availableNow`` and return
    the sink as a batch table."""
    schema = spark.read.parquet(table_path(sf_dir, table)).schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    if prepare is not None:
        stream = prepare(stream)
    out = pipeline.transform(stream, keep=keep)
    sink = scratch_path(spark, f"{table}-replay")
    q = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", sink + "-ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)
