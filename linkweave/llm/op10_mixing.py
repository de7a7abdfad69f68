"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's mean repetition rate is its target share of all units over the share it has. Each document draws its number of copies
by inverting the Poisson distribution of that mean at a uniform number made from a hash of the seed and its id: the same
seed gives the same corpus on any cluster. Documents explode by their counts, and all copies are shuffled
globally by a hash of id and copy: the key's leading part is the partition, the rest the order inside it.

Units are the texts' characters and one more, over all documents. Target weights are given by source, or by default follow the
sources' units to the power TEMPERATURE. Sources without a given weight get none of the target: rate 0. A null
source is a source of its own. Null texts count one unit; repeated rows draw the same number each; a null id draws like
the text "null". Means over PART split into parts with a draw each. Columns named copy, n_copies or shuffle_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED, TEMPERATURE, EPOCHS, PART = "mix-1", 0.5, 1.0, 300.0
#: Up to so many sources are broadcast, each with fewer than 600 numbers; more are joined by a salted shuffle.
BROADCAST_SOURCES, SALTS = 2000, 64
ADDED = ("copy", "n_copies", "shuffle_key")


def hash60(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts, as a long."""
    joined = F.concat_ws("/", F.lit(SEED), *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """source, has (a key that null sources have too), rate, parts, cdf: one row for each source."""
    unit = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1
    by = docs.groupBy("source").agg(F.sum(unit).alias("units"))
    if weights is None:
        by = by.withColumn("weight", F.pow(F.col("units").cast("double"), F.lit(TEMPERATURE)))
    else:
        given = F.lit(0.0)
        for name, x in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), float(x)).otherwise(given)
        by = by.withColumn("weight", given)
    total = by.agg(F.sum("units").alias("all_units"), F.sum("weight").alias("all_weight"))
    # one row of two totals joins each source: a scalar, bounded
    by = by.join(F.broadcast(total), F.lit(True))
    rate = F.when(F.col("all_weight") > 0, F.lit(float(epochs)) * F.col("weight") / F.col("all_weight") * F.col("all_units") / F.col("units")).otherwise(0.0)
    by = by.select("source", key_of(F.col("source")).alias("__key"), rate.alias("rate"))
    by = by.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    # beyond the last entry less than 2^-60 is left, finer than the draw's 60 bits resolve
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("__mean") / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return by.withColumn("__mean", mean).withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, step)["c"]).drop("__mean")


def key_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """docs' rows by their numbers of copies, with copy, n_copies and shuffle_key, in global random order."""
    spark = docs.sparkSession
    # as many rows as there are sources
    table = common.stored(rates(docs, weights, epochs), "mix-rates", spark).select("__key", "parts", "cdf")
    base = docs.drop(*ADDED).withColumn("__key", key_of(F.col("source")))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        d = base.join(F.broadcast(table), "__key")
    else:  # a source with a third of all rows spreads over SALTS keys
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
        d = base.withColumn("__salt", salt).join(table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), ["__key", "__salt"]).drop("__salt")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: hash60(j.cast("string"), doc).cast("double") / float(1 << 60))
    counts = F.transform(draws, lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    d = d.withColumn("n_copies", F.aggregate(counts, F.lit(0), lambda a, x: a + x)).drop("__key", "parts", "cdf").where("n_copies > 0")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    d = d.withColumn("shuffle_key", hash60(doc, F.col("copy").cast("string")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.shiftright(F.col("shuffle_key"), 28) * n / float(1 << 32)).cast("int")
    return d.repartitionById(n, part).sortWithinPartitions("shuffle_key", "doc_id").select(*[c for c in docs.columns if c not in ADDED], *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH RECURSIVE u AS (SELECT source, sum(length(coalesce(text, '')) + 1) AS units FROM documents GROUP BY source),
tot AS (SELECT sum(units)::DOUBLE AS all_units, sum(pow(units::DOUBLE, {TEMPERATURE})) AS all_weight FROM u),
r0 AS (SELECT source, {EPOCHS}::DOUBLE * pow(units::DOUBLE, {TEMPERATURE}) / all_weight * all_units / units AS rate FROM u, tot),
r AS (SELECT source, rate, greatest(1, ceil(rate / {PART}))::INT AS parts, rate / greatest(1, ceil(rate / {PART})) AS m FROM r0),
c AS (SELECT source, m, parts, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM r
      UNION ALL SELECT source, m, parts, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM c WHERE k < ceil(m + 12 * sqrt(m) + 30)),
d AS (SELECT row_number() OVER () AS rn, * FROM documents),
j AS (SELECT d.*, r.parts, unnest(range(1, r.parts + 1)) AS part FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
x AS (SELECT rn, part, source, ('0x' || substr(md5('{SEED}/' || part || '/' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT::DOUBLE / {1 << 60}::DOUBLE AS u FROM j),
n AS (SELECT rn, count(*)::INT AS n_copies FROM x JOIN c ON c.source IS NOT DISTINCT FROM x.source AND c.c <= x.u GROUP BY rn),
e AS (SELECT d.*, n_copies, unnest(range(1, n_copies + 1))::INT AS copy FROM d JOIN n USING (rn))
SELECT doc_id, text, lang, source, n_chars, copy, n_copies,
  ('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, 'null') || '/' || copy), 1, 15))::BIGINT AS shuffle_key FROM e
"""
