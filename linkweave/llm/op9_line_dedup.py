"""Line deduplication over levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without blanks at its ends and with A-Z lower-cased; its hash has 96 bits. A run is a table,
sorted by hash, of the distinct line hashes of some batches with the number of documents that hold each. A new batch is first
anti-joined with the settled hashes (those that min_docs documents are known to hold, and which need no counting any more), then merge-joined
with the run of each level: hashes whose counts reach min_docs become settled, the others enter as the batch's own run on level 0. Two runs of one
level are compacted into a run of the next: their counts add up, and hashes settled meanwhile go. So there are at most log2(batches) + 1 runs,
and after the last batch the settled hashes are those of all documents. Documents then lose the lines with a settled hash. Counting
combines before the shuffle, so a line in every document is no hot key. A query over one table deals its rows into BATCHES batches.

A null or empty text is one empty line. Empty keys are never dropped. Each row counts as one document, also a repeated
one; rows that share an id and differ in text are told apart by a hash of the text. Null ids work like any other value.
Columns other than doc_id and text pass through dedup_lines unchanged, whatever their names.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DOCS, MIN_CHARS, BATCHES = 10, 1, 4
#: Frequent hashes up to this number (20 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
HASH = ["h1", "h2"]


def lower_az(text: Column) -> Column:
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def keys_of(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(lower_az(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.trim(x, F.lit(common.BLANK)))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.hash(key).alias("h2")]


class LineIndex:
    """The levels: at most one run on each; and the settled hashes. All are Parquet tables in the shared folder."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.levels: dict[int, DataFrame] = {}
        self.settled: list[DataFrame] = []

    def run_of(self, docs: DataFrame, *by: str) -> DataFrame:
        """h1, h2, n_docs (after the columns by, each counted apart)."""
        keys = F.array_distinct(keys_of(F.col("text").cast("string")))
        lines = docs.select(*by, F.explode(keys).alias("key")).where(F.length("key") >= self.min_chars)
        return lines.select(*by, *hashes(F.col("key"))).groupBy(*by, *HASH).agg(F.count("*").alias("n_docs"))

    def add(self, docs: DataFrame) -> None:
        self.add_run(self.run_of(docs))

    def add_run(self, run: DataFrame) -> None:
        """Takes in a batch's run: merge-anti-joins what is there, settles what has become frequent, adds the rest."""
        total = F.col("n_docs")
        new = run.join(self.frequent(), HASH, "left_anti") if self.settled else run
        for level, old in self.levels.items():
            new = new.join(old.withColumnRenamed("n_docs", f"n_{level}"), HASH, "left")
            total = total + F.coalesce(f"n_{level}", F.lit(0))
        counted = common.stored(new.select(*HASH, "n_docs", total.alias("total")), "lines-counted", self.spark)
        self.settled.append(common.stored(counted.where(F.col("total") >= self.min_docs).select(*HASH), "lines-settled", self.spark))
        rest = counted.where(F.col("total") < self.min_docs).select(*HASH, "n_docs")
        self.put(0, common.stored(rest.sortWithinPartitions(*HASH), "lines-0", self.spark))
        common.forget(self.spark, counted)

    def put(self, level: int, run: DataFrame) -> None:
        if level not in self.levels:
            self.levels[level] = run
            return
        other = self.levels.pop(level)
        both = run.unionByName(other).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs")).join(self.frequent(), HASH, "left_anti")
        merged = common.stored(both.sortWithinPartitions(*HASH), f"lines-{level + 1}", self.spark)
        common.forget(self.spark, run, other)
        self.put(level + 1, merged)

    def close(self) -> None:
        """Deletes the runs, when no more batches come; the settled hashes stay for plans that read them."""
        common.forget(self.spark, *self.levels.values())
        self.levels = {}

    def frequent(self) -> DataFrame:
        """Hashes in at least min_docs documents of all batches so far."""
        return reduce(DataFrame.unionByName, self.settled)


def build(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """An index of docs, dealt into batches by a hash of the id; one pass over the texts counts the lines of all batches."""
    index = LineIndex(docs.sparkSession, min_chars, min_docs)
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"), "text")
    runs = common.stored(index.run_of(rows, "batch"), "lines-runs", docs.sparkSession)
    for i in range(batches):
        index.add_run(runs.where(F.col("batch") == i).drop("batch"))
    common.forget(docs.sparkSession, runs)
    return index


def dedup_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with the lines kept as text, and lines_dropped beside them (any column of that name is replaced)."""
    spark = docs.sparkSession
    row = F.struct(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")))
    common_lines = index.frequent()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(F.xxhash64(row).alias("__a"), F.hash(row).alias("__b"), F.posexplode(F.split(lower_az(text), "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", F.trim("line", F.lit(common.BLANK)))
    lines = lines.where(F.length("key") >= index.min_chars).select("__a", "__b", "pos", *hashes(F.col("key")))
    small = common_lines.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hit = lines.join(F.broadcast(common_lines) if small else common_lines, HASH, "left_semi")
    drop = hit.groupBy("__a", "__b").agg(F.collect_set("pos").alias("__drop"))
    both = docs.drop("lines_dropped").withColumns({"__a": F.xxhash64(row), "__b": F.hash(row)}).join(drop, ["__a", "__b"], "left")
    # only texts that lose lines are split; the others are passed on
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__drop"))
    rest = common.let(F.split(text, "\n"), lambda all_: F.array_join(F.transform(kept, lambda i: F.get(all_, i)), "\n"))
    both = both.withColumns({"text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(rest), "__n_lines": n_lines.cast("long"), "lines_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long")})
    return both.select(*[c for c in docs.columns if c != "lines_dropped"], "lines_dropped", "__n_lines")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    index = build(docs)
    index.close()
    out = dedup_lines(docs, index)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
one AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
k AS (SELECT *, trim(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM one),
bad AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT r) >= {MIN_DOCS}),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM k WHERE key NOT IN (SELECT key FROM bad) GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)
"""
