"""The corpus pipeline: STAGES applied one after another, each to all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and works on whatever rows docs has; nulls, empty tables and repeated rows are as its operator says.
All but the last return the columns of docs, n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave import storage
from linkweave.llm import common, op1_quality_classifier, op5_sentencepiece, op6_minhash, op9_line_dedup, op10_mixing

#: Near duplicates: word shingles and least similarity in percent.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, accepts."""
    model = op1_quality_classifier.fit(docs, common.table(spark, sf_dir, "labels"))
    return op1_quality_classifier.score(docs, model).where(F.col("score") >= op1_quality_classifier.THRESHOLD).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that MIN_DOCS documents or more share."""
    index = op9_line_dedup.build(docs)
    index.close()
    out = op9_line_dedup.dedup_lines(docs, index).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def apart(docs: DataFrame) -> DataFrame:
    """docs with __row, the doc_id; where an id has several texts, each but the smallest gets a number after all ids instead.

    Of rows equal in id and text, the smallest by their other columns stays.
    """
    columns, rest = docs.columns, [c for c in docs.columns if c not in ("doc_id", "text")]
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return docs.withColumn("__row", F.col("doc_id").cast("long"))
    again = common.stored(again, "repeated-ids", docs.sparkSession)
    rows = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *rest)).alias("__rest"))
    rows = rows.select("doc_id", "text", *(F.col("__rest")[c].alias(c) for c in rest))
    first = rows.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNotNull(), "text"))["text"].alias("__first"))
    rows = rows.join(first, "doc_id").withColumn("__more", ~F.col("text").eqNullSafe(F.col("__first"))).drop("__first")
    rows = common.stored(rows.withColumn("__key", F.struct("doc_id", "text")), "repeated", docs.sparkSession)
    top = docs.agg(F.max("doc_id").cast("long")).first()[0]
    more = storage.numbered(rows.where("__more"), "__key", "__row", top).select(*columns, "__row")
    single = docs.join(again, "doc_id", "left_anti").unionByName(rows.where("NOT __more").select(columns))
    return single.withColumn("__row", F.col("doc_id").cast("long")).unionByName(more)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id. Rows without an id stay.

    Different texts of one id are documents of their own, the second and further ones in order after all ids, so unlike ones stay.
    """
    rows = apart(docs)
    found = op6_minhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), WORDS, PERCENT)
    return rows.join(found.where("NOT kept").select(F.col("doc_id").alias("__row")).distinct(), "__row", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their numbers of copies, sources at the target weights, in global random order."""
    return op10_mixing.mix(docs).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every row, in the order that the mixing gave them."""
    return op5_sentencepiece.encode(docs, in_order=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: The first stage learns a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            done = common.stored(done, f"stage-{name}", spark)
            common.forget(spark, docs)  # what the stage before left; the input isn't a stored table
        docs = done
    return docs
