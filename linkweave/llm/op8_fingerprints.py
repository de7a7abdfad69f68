"""Document fingerprints: canonical exact digests, in DataFrame functions only.

A text's canonical form is its compatibility composition (NFKC), case-folded and composed again, with runs of white
space as one blank and none at the ends. The fingerprint is two 64-bit xxhash values of that form under different seeds,
as 32 hex digits. Equal fingerprints are believed only after the canonical forms compare equal byte by byte: documents of one
fingerprint form a bucket, and its groups get the smallest doc_id as group_id.
The digest has no degrees: likeness is 1.0 or 0.0.

A null text counts as empty. Documents are ordered by doc_id, then text (null ids first); repeated rows follow
one another. An only document is followed by itself; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEED = "linkweave"
LEAST = -(1 << 63)
#: Shared fingerprints up to this number (32 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
HEAVY = 1000


def canonical(text: Column) -> Column:
    compose = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # ASCII is its own composition
    folded = F.when(plain, F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.trim(F.regexp_replace(folded, r"\p{IsWhite_Space}+", " "))


def digest(canon: Column) -> Column:
    return common.hexed(F.xxhash64(canon), F.xxhash64(F.lit(SEED), canon))


def fingerprints(df: DataFrame) -> DataFrame:
    """df with canonical and fingerprint."""
    return df.withColumn("canonical", canonical(F.col("text").cast("string"))).withColumn("fingerprint", digest(F.col("canonical")))


def group_table(df: DataFrame) -> DataFrame:
    """fingerprint, form, group_id, n: the groups of two documents or more; group_id is their smallest doc_id.

    The bytes are compared inside equal buckets: a bucket whose smallest and largest canonical forms differ (a collision) splits by the forms
    themselves, named by their SHA-256; otherwise form is null. Aggregations combine before the shuffle, so a huge group is no hot task, and only
    the forms of buckets with several documents leave their task.
    """
    spark = df.sparkSession
    f = fingerprints(df.select("doc_id", "text")).select("doc_id", "fingerprint", "canonical")
    several = f.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id")).where("n > 1")
    several = common.stored(several, "buckets", spark)
    named = several.select("fingerprint")
    if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    inside = f.join(named, "fingerprint", "left_semi")
    mixed = inside.groupBy("fingerprint").agg(F.expr("min(canonical) <> max(canonical)").alias("mixed")).where("mixed").select("fingerprint")
    mixed = common.stored(mixed, "collisions", spark)
    same = several.join(mixed, "fingerprint", "left_anti").select("fingerprint", F.lit(None).cast("string").alias("form"), "group_id", "n")
    if not mixed.limit(1).count():
        return same
    split = inside.join(mixed, "fingerprint").groupBy("fingerprint", "canonical").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id"))
    return same.unionByName(split.select("fingerprint", F.sha2("canonical", 256).alias("form"), "group_id", "n"))


def with_groups(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (doc_id, fingerprint, form: SHA-256 of the canonical form, any others) without form, with group_id: the own doc_id outside all groups.

    Groups with over 1/HEAVY of all grouped documents, fewer than HEAVY by count, are broadcast; the other ones are joined by a shuffle, in which
    no group is a hot key.
    """
    table = common.stored(table, "groups", rows.sparkSession)
    total = table.agg(F.sum("n")).first()[0] or 0
    of = lambda t, name: t.select(F.col("fingerprint").alias("fp"), F.col("form").alias("fm"), F.struct("group_id").alias(name))
    same = (F.col("key") == F.col("fp")) & (F.col("fm").isNull() | (F.col("fm") == F.col("form")))
    heavy, light = of(table.where(F.col("n") * HEAVY > total), "heavy"), of(table.where(F.col("n") * HEAVY <= total), "light")
    found = rows.withColumn("key", F.col("fingerprint")).join(F.broadcast(heavy), same, "left").drop("fp", "fm")
    # members of heavy groups are done: a key of their own spreads them
    alone = F.when(F.col("heavy").isNull(), F.col("fingerprint")).otherwise(F.concat(F.lit("done/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    found = found.withColumn("key", alone).join(light, same, "left")
    own = F.when(F.col("heavy").isNotNull(), F.col("heavy.group_id")).when(F.col("light").isNotNull(), F.col("light.group_id")).otherwise(F.col("doc_id"))
    return found.withColumn("group_id", own).drop("key", "fp", "fm", "form", "heavy", "light")


def exact_groups(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id: the smallest doc_id among documents of equal canonical form."""
    rows = fingerprints(df.select("doc_id", "text")).select("doc_id", "fingerprint", F.sha2("canonical", 256).alias("form"))
    return with_groups(rows, group_table(df))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each document beside its successor, by one shuffle of the texts.

    Buckets are ranges of doc_id. Their bounds, one value that occurs for each partition of a range partitioning of the ids alone, are one
    row, broadcast and searched by halving. The first document of each bucket also goes to the end of the bucket before it (the first of
    all to the last bucket), so a window inside each bucket sees every successor.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = docs.select(k.alias("k")).repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("part")).agg(F.min("k").alias("low"))
    # one row of at most n numbers, n being a setting
    bounds = common.stored(ranges.agg(F.sort_array(F.collect_set("low")).alias("bounds"), F.count("*").cast("int").alias("n_bounds")), "bounds", spark)
    t = docs.select("doc_id", k.alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(bounds), F.lit(True))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        right = F.get("bounds", middle) <= F.col("k")
        return F.struct(F.when(right, middle).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(middle - 1).alias("hi"))

    whole = F.struct(F.lit(0).alias("lo"), (F.col("n_bounds") - 1).alias("hi"))
    t = t.withColumn("bucket", F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), whole, halve)["lo"])
    starts = F.get("bounds", "bucket") == F.col("k")
    before = F.when(F.col("bucket") == 0, F.col("n_bounds") - 1).otherwise(F.col("bucket") - 1)
    here = F.struct(F.col("bucket").alias("part"), F.lit(False).alias("lent"))
    t = t.select("doc_id", "k", "text", F.inline(F.when(starts, F.array(here, F.struct(before.alias("part"), F.lit(True).alias("lent")))).otherwise(F.array(here))))
    order = Window.partitionBy("part").orderBy("lent", "k", "text")
    return t.withColumn("next_text", F.lead("text").over(order)).where("NOT lent").select("doc_id", "text", "next_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    d = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("a"), canonical(F.col("edited")).alias("b"), canonical(F.col("next_text")).alias("c"))
    d = d.select("*", digest(F.col("a")).alias("fingerprint"), digest(F.col("b")).alias("edited_fingerprint"), digest(F.col("c")).alias("next_fingerprint"))
    like = lambda f, x: F.when((F.col("fingerprint") == F.col(f)) & (F.col("a") == F.col(x)), 1.0).otherwise(0.0)
    d = d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint", "b").alias("near_edited"), like("next_fingerprint", "c").alias("near_next"), F.sha2("a", 256).alias("form"))
    return with_groups(d, group_table(docs))
