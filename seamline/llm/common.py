"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.arrow import spread
from ..sources.shared import cut, shared_dir

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "bound_batches", "cut", "once", "rows_by_batch", "shared_dir", "table"]

#: Rows of one Arrow batch handed to a Python worker.  Texts are up to about 120 kB, so a batch stays
#: far under the memory of a worker, while short texts still share the cost of a batch.
BATCH_ROWS = 400
#: Bytes of one, which cells of any size fill alone.
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Repeated ids that are sent to all tasks at most; beyond it rows are shuffled.
MOST_REPEATED = 1_000_000


def once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row a key; only the rows of repeated keys are shuffled, as long as these are few.

    The number of repeated keys is counted before it is broadcast.  Rows without a key are all kept.
    """
    repeated = cut(df.groupBy(F.col(key).alias("key_")).count().where("count > 1 and key_ is not null").select("key_"))
    n = repeated.count()
    if not n:
        return df
    if n > MOST_REPEATED:
        return df.where(F.col(key).isNotNull()).dropDuplicates([key]).unionAll(df.where(F.col(key).isNull()))
    same = F.col(key) == F.col("key_")
    return df.join(F.broadcast(repeated), same, "left_anti").unionAll(df.join(F.broadcast(repeated), same, "left_semi").dropDuplicates([key]))


def bound_batches(spark: SparkSession) -> None:
    """Bounds of an Arrow batch, by rows and by bytes, where the session still has Spark's own defaults."""
    for name, default, value in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "-1", str(BATCH_BYTES))):
        try:
            if spark.conf.get(f"spark.sql.execution.arrow.{name}").lower() in (default, "9223372036854775807b", "9223372036854775807", "64mb", "67108864b", "256mb"):
                spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
        except Exception:  # a version without this setting
            continue


def rows_by_batch(
    df: DataFrame, schema: T.StructType | str, fn: Callable[..., Iterable[tuple]]
) -> DataFrame:
    """Run ``fn(*column lists) -> rows`` on each Arrow batch of ``df`` and return the rows as a DataFrame.

    One call per batch and plain Python lists inside, so no object is built per cell by pandas.
    """
    spark = df.sparkSession
    bound_batches(spark)
    struct = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names, out = list(df.columns), to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            found = list(fn(*columns))
            if found:
                arrays = [pa.array(list(c), type=f.type) for c, f in zip(zip(*found), out)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return spread(df).mapInArrow(run, struct)
