"""Datasets become record tables: record_id, record_key, source and their fields."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import to_text

PRIME, START = 0x100000001B3, 0xCBF29CE484222325


@dataclass(frozen=True)
class DatasetConfig:
    """A dataset's label and the column that holds its natural key."""

    source: str
    key_column: str


def fnv1a(text: str) -> int:
    """64-bit FNV-1a of the text's UTF-8 bytes."""
    h = START
    for b in text.encode():
        h = ((h ^ b) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def _fnv(s: pd.Series) -> pd.Series:
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    return s.map(lambda x: signed(fnv1a(x))).astype("int64")


def stable_id(source: Column, key: Column) -> Column:
    """FNV-1a of "source:key" as a signed 64-bit number."""
    return F.pandas_udf(_fnv, "long")(F.concat(F.coalesce(source, F.lit("")), F.lit(":"), key))


def load_dataset(df: DataFrame, config: DatasetConfig) -> DataFrame:
    """df with record_id, record_key and source in front. A missing or null key becomes the row's number."""
    row = F.monotonically_increasing_id().cast("string")
    key = F.coalesce(F.col(config.key_column).cast("string"), row) if config.key_column in df.columns else row
    rest = [c for c in df.columns if c not in ("record_id", "record_key", "source")]
    keyed = df.select(*rest, key.alias("record_key"), F.lit(config.source).alias("source"))
    return keyed.select(stable_id(F.col("source"), F.col("record_key")).alias("record_id"), "record_key", "source", *rest)


def load_frame(spark: SparkSession, frame, config: DatasetConfig) -> DataFrame:
    """load_dataset of a table in memory: pandas, Arrow, or anything that gives an Arrow table by to_arrow(). Dates and times become text."""
    table = frame.to_arrow() if hasattr(frame, "to_arrow") else frame
    d = spark.createDataFrame(table)
    timed = {c: to_text(F.col(f"`{c}`"), kind) for c, kind in d.dtypes if kind == "date" or kind.startswith("timestamp")}
    return load_dataset(d.withColumns(timed) if timed else d, config)


def label_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def wide_unsigned(df: DataFrame, *columns: str) -> DataFrame:
    """Unsigned 64-bit columns as DECIMAL(20, 0), which holds all of them."""
    return df.withColumns({c: F.col(c).cast("decimal(20,0)") for c in columns})


def read_csv(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A CSV with a header: the first column is the key, all cells are text, blank ones empty texts."""
    d = spark.read.csv(path, header=True, inferSchema=False)
    d = d.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in d.columns))
    return load_dataset(d, DatasetConfig(source, d.columns[0]))


def read_csv_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns; one that the file lacks is empty text."""
    d = spark.read.csv(path, header=True, inferSchema=False)
    return d.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in d.columns else F.lit("").alias(c) for c in columns))


def canonical_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs in one order: key_a <= key_b."""
    return df.withColumns({"key_a": F.least(F.col(a), F.col(b)), "key_b": F.greatest(F.col(a), F.col(b))})


def ground_truth(df: DataFrame) -> DataFrame:
    """key_a, key_b, match_type of the true pairs in a table whose first columns are a, b, is_match[, match_type]."""
    a, b, is_match, *more = df.columns
    kind = F.coalesce(F.col(more[0]).cast("string"), F.lit("")) if more else F.lit("")
    true = df.where(F.lower(F.trim(F.col(is_match).cast("string"))).isin("true", "1", "yes"))
    return canonical_pairs(true, a, b).select("key_a", "key_b", kind.alias("match_type")).groupBy("key_a", "key_b").agg(F.max("match_type").alias("match_type"))


class RecordStore:
    """Records by id; of repeated ids the last inserted counts for get, all for len."""

    def __init__(self, records: DataFrame | None = None):
        self.batches = [records] if records is not None else []

    def insert(self, records: DataFrame) -> None:
        self.batches.append(records)

    def all(self) -> DataFrame:
        out = None
        for i, b in enumerate(self.batches):
            b = b.withColumn("__batch", F.lit(i))
            out = b if out is None else out.unionByName(b, allowMissingColumns=True)
        return out

    def current(self) -> DataFrame:
        every = self.all()
        last = every.groupBy("record_id").agg(F.max("__batch").alias("__batch"))
        return every.join(last, ["record_id", "__batch"]).drop("__batch")

    def get(self, ids: DataFrame) -> DataFrame:
        return self.current().join(ids.select("record_id").distinct(), "record_id", "left_semi")

    def len(self) -> int:
        return sum(b.count() for b in self.batches)
