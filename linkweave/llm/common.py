"""What the corpus operators share: table access, the shared folder, arrays and edges of groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

#: The white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of whole texts in one Arrow batch; keeps a Python worker's memory small however long texts are.
ARROW_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by at most ARROW_ROWS rows, so that long texts don't meet in one batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{storage.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    return storage.stored(df, name)


def forget(spark: SparkSession, *dfs: DataFrame) -> None:
    """Delete tables that stored() made and that no plan needs any more."""
    storage.forget(*dfs)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside further lambdas."""
    return F.transform(F.array(value), body)[0]


def hexed(*parts: Column) -> Column:
    """64-bit integers as one lower-case hex string of 16 digits each."""
    return F.concat(*(F.lpad(F.lower(F.hex(p)), 16, "0") for p in parts))
