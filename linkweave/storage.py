"""Tables that cut lineage: written to the folder all executors share, then read again."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a temporary folder on a local master, which has one machine, and else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="linkweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df as Parquet in the shared folder: later reads survive lost executors and repeat no work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that never broadcasts it: a table that grows with the input does not pass through the driver, also while it is below the threshold."""
    return df.hint("merge")


def numbered(df: DataFrame, key: str, name: str, start: int = 0) -> DataFrame:
    """df with rows numbered from start + 1 in the order of a unique key, without a task that sees all rows.

    Rows are dealt by ranges of the key; each range counts its own, and only the ranges' sizes (one row a partition) are summed in one place.
    """
    ranged = stored(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    out = ranged.withColumn("__rank", rank).join(F.broadcast(offsets), "__range")
    return out.withColumn(name, (F.col("__rank") + F.col("__before") + start).cast("long")).drop("__range", "__rank", "__before")


def forget(*dfs: DataFrame) -> None:
    """Deletes tables that stored() made and that no plan needs any more."""
    for df in dfs:
        if path := getattr(df, "_stored_at", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Versions:
    """Tables under a folder, each made of Parquet parts, and which parts are current.

    A state is one JSON file, written under another name and renamed when whole: all tables change at once, and readers see the last whole
    state, also after a restart. Parts are added, not rewritten; a table of over COMPACT parts is rewritten as one. Parts and states that the last two states
    don't name are deleted, so a reader of the state before still finds its files. One writer at a time.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        found = (re.fullmatch(r"state-([0-9]+)\.json", x.getPath().getName()) for x in self._fs.listStatus(self._at("")))
        return sorted(int(m[1]) for m in found if m)

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"state-{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> dict:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {"parts": {}}

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        parts = (state or self.state())["parts"].get(name, [])
        return self.read(name, parts)

    def read(self, name: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*(f"{self.path}/{p}" for p in parts))

    def write(self, name: str, df: DataFrame) -> str:
        """A part, which counts once a state names it."""
        part = f"{name}/part-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{part}")
        return part

    def publish(self, added: dict[str, DataFrame], **more) -> dict:
        """The state before, with a part added to each table named and with what is in more."""
        numbers = self._numbers()
        before = self._load(numbers[-1]) if numbers else {"parts": {}}
        parts = {k: list(v) for k, v in before["parts"].items()}
        for name, df in added.items():
            parts.setdefault(name, []).append(self.write(name, df))
            if len(parts[name]) > self.COMPACT:
                parts[name] = [self.write(name, self.read(name, parts[name]))]
        state = before | more | {"parts": parts}
        number = (numbers[-1] if numbers else 0) + 1
        temporary = self._at(f".state-{number}-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(temporary, self._at(f"state-{number}.json")):
            raise RuntimeError(f"state {number} of {self.path} could not be published")
        self._sweep(numbers, before, state)
        return state

    def _sweep(self, numbers: list[int], before: dict, state: dict) -> None:
        live = {p for x in (before, state) for ps in x["parts"].values() for p in ps}
        for number in numbers[:-1]:
            for part in {p for ps in self._load(number)["parts"].values() for p in ps} - live:
                self._fs.delete(self._at(part), True)
            self._fs.delete(self._at(f"state-{number}.json"), False)
