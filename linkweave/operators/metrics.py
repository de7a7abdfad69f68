"""Evaluation against true pairs (key_a, key_b, match_type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["key_a", "key_b"]


def ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def _bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) AS int))")


def marked(records: DataFrame, truth: DataFrame) -> DataFrame:
    """records (record_key) with truth_mask: a bit for each true partner by its key's hash, 0 without one."""
    ends = truth.select(F.inline(F.array(F.struct(F.col("key_a").alias("record_key"), _bit("key_b").alias("m")), F.struct(F.col("key_b").alias("record_key"), _bit("key_a").alias("m")))))
    masks = ends.groupBy("record_key").agg(F.bit_or("m").alias("truth_mask"))
    return records.join(masks, "record_key", "left").withColumn("truth_mask", F.coalesce("truth_mask", F.lit(0)))


def keyed(pairs: DataFrame) -> DataFrame:
    """Pairs (record_key_a, record_key_b, truth_mask_a, truth_mask_b) with key_a <= key_b, and maybe: false where the pair can't be a true one.

    Of pairs with maybe few are not true, so joins with the truth shuffle hardly more than it.
    """
    maybe = (F.col("truth_mask_a").bitwiseAND(_bit("record_key_b")) != 0) & (F.col("truth_mask_b").bitwiseAND(_bit("record_key_a")) != 0)
    d = pairs.withColumns({"key_a": F.least("record_key_a", "record_key_b"), "key_b": F.greatest("record_key_a", "record_key_b"), "maybe": F.coalesce(maybe, F.lit(False))})
    return d.drop("record_key_a", "record_key_b", "truth_mask_a", "truth_mask_b")


def perhaps(pairs: DataFrame) -> DataFrame:
    return pairs.where("maybe") if "maybe" in pairs.columns else pairs


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of predicted pairs; one full join of the distinct pairs."""
    p = predicted.select(*PAIR).distinct().withColumn("p", F.lit(1))
    t = truth.select(*PAIR).distinct().withColumn("t", F.lit(1))
    d = p.join(t, PAIR, "full").agg(F.count_if(F.expr("p = 1 AND t = 1")).alias("tp"), F.count_if(F.expr("p = 1 AND t IS NULL")).alias("fp"), F.count_if(F.expr("p IS NULL AND t = 1")).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return d.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def curve(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """score, tp, fp, precision, recall, f1 at each distinct score, highest first.

    Pairs combine by score before the running sums, so the ordered window holds one row for each distinct score. Pairs that keyed() says
    can't be true combine by score before they are shuffled.
    """
    t = truth.select(*PAIR).distinct().withColumn("hit", F.lit(1))
    own = [F.when(F.col("maybe"), F.col(k)).alias(k) if "maybe" in scored.columns else F.col(k) for k in PAIR]
    by = scored.groupBy(F.col("match_probability").alias("score"), *own).agg(F.count("*").alias("n")).join(t, PAIR, "left")
    by = by.groupBy("score").agg(F.coalesce(F.sum(F.col("n") * F.col("hit")), F.lit(0)).alias("pos"), F.sum("n").alias("n"))
    n_pos = truth.select(*PAIR).distinct().agg(F.count("*").alias("n_pos"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    d = by.withColumns({"tp": F.sum("pos").over(w), "seen": F.sum("n").over(w)}).join(F.broadcast(n_pos), F.lit(True))
    d = d.withColumns({"fp": F.col("seen") - F.col("tp"), "precision": F.col("tp") / F.col("seen"), "recall": ratio(F.col("tp"), F.col("n_pos"))})
    return d.withColumn("f1", ratio(2 * F.col("tp"), F.col("seen") + F.col("n_pos"))).select("score", "tp", "fp", "precision", "recall", "f1")


def pr_auc(points: DataFrame) -> DataFrame:
    """The area below the steps of the curve."""
    w = Window.orderBy(F.desc("score"))
    gain = F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0))
    return points.select((gain * F.col("precision")).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("pr_auc"))


def best_threshold(points: DataFrame) -> DataFrame:
    """threshold, f1, precision, recall, tp, fp at the best f1, the highest score of equals."""
    best = points.agg(F.max(F.struct("f1", "score", "precision", "recall", "tp", "fp")).alias("x"))
    return best.select(F.col("x.score").alias("threshold"), "x.f1", "x.precision", "x.recall", "x.tp", "x.fp")


def cluster_recall(members: DataFrame, truth: DataFrame) -> DataFrame:
    """The share of true pairs whose records are in one entity: two joins by record, no pairs within entities."""
    m = members.select("record_key", "entity")
    d = truth.select(*PAIR).distinct().join(m.select(F.col("record_key").alias("key_a"), F.col("entity").alias("ea")), "key_a", "left").join(m.select(F.col("record_key").alias("key_b"), F.col("entity").alias("eb")), "key_b", "left")
    return d.agg(F.count_if(F.expr("ea = eb")).alias("found"), F.count("*").alias("n_true")).withColumn("cluster_recall", F.when(F.col("n_true") > 0, F.col("found") / F.col("n_true")).otherwise(1.0))


def stratified_recall(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """match_type, count_gt, true_pos, false_neg, recall."""
    p = perhaps(predicted).select(*PAIR).distinct().withColumn("p", F.lit(1))
    d = truth.join(p, PAIR, "left").groupBy("match_type").agg(F.count("*").alias("count_gt"), F.count("p").alias("true_pos"))
    return d.withColumns({"false_neg": F.col("count_gt") - F.col("true_pos"), "recall": ratio(F.col("true_pos"), F.col("count_gt"))})


def blocking_quality(pairs: DataFrame, truth: DataFrame, n_records: int) -> DataFrame:
    """blocking_recall and reduction_ratio of candidate pairs (key_a, key_b)."""
    found = truth.select(*PAIR).distinct().join(perhaps(pairs).select(*PAIR).distinct().withColumn("p", F.lit(1)), PAIR, "left").agg(F.count("p").alias("found"), F.count("*").alias("n_true"))
    n = pairs.agg(F.count("*").alias("n_pairs"))
    every = float(n_records) * (n_records - 1) / 2
    return found.join(F.broadcast(n), F.lit(True)).select("n_pairs", ratio(F.col("found"), F.col("n_true")).alias("blocking_recall"), (1 - F.col("n_pairs") / F.lit(every)).alias("reduction_ratio"))
