"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from engramite.plans.ship import ship_package
from engramite.plans.scratch import discard, materialize, shared_dir  # noqa: F401

#: Rows of documents in one Arrow batch. A batch is the unit of memory in a Python worker.
BATCH_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for whole texts, a smaller setting of the session stays; and lets workers import this package."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def doc_id(df: DataFrame) -> Column:
    return df["doc_id"].cast("bigint")


def fold(df: DataFrame, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the contract's split into learned and held-out rows. Null for a null id."""
    return F.crc32(df["doc_id"].cast("string").cast("binary")) % modulus


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType
) -> DataFrame:
    """Runs make()(batch) -> columns over Arrow batches; make() is called once in each task."""
    bound_batches(df.sparkSession)
    names = schema.names if isinstance(schema, StructType) else [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _array(values):
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        return values
    return pa.array(values)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts; a null text is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
