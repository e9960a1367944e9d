"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, table_path

#: Rows turned into Python objects at a time inside a task; Arrow batches are larger.
SLICE_ROWS = 256


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf, name))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back: later steps
    start from files every executor can read, so a lost executor costs one task, not the job."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written``, once what follows from them is written too."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], name: str) -> str:
    """``name``, or with underscores behind it the first that is none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """``df.mapInArrow`` with ``fn`` called on short slices of each batch; ``fn`` returns the
    output columns as lists or Arrow arrays in schema order, one entry per input row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                cols = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(fn(part), out)]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return df.mapInArrow(run, schema)


def code_points(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit("")))
