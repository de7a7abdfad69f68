"""Views over the entity store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clusters(members: DataFrame, records: DataFrame) -> DataFrame:
    """entity_id with each member's record."""
    return members.select("entity_id", "record_id", "score", "method").join(records, "record_id")


def member_pairs(members: DataFrame, linked_only: bool = False) -> DataFrame:
    """entity_id, a, b, key_a, key_b, score, method of the pairs inside each entity; entities are bounded by the cluster size limit.

    score is the lower of the two, method the first record's. linked_only keeps pairs of different sources.
    """
    side = lambda n: members.select("entity_id", F.col("record_id").alias(n), F.col("record_key").alias(f"key_{n}"), F.col("source").alias(f"source_{n}"), F.col("score").alias(f"score_{n}"), F.col("method").alias(f"method_{n}"))
    d = side("a").join(side("b"), "entity_id").where("a < b")
    if linked_only:
        d = d.where(~F.col("source_a").eqNullSafe(F.col("source_b")))
    return d.select("entity_id", "a", "b", "key_a", "key_b", F.least("score_a", "score_b").alias("score"), F.col("method_a").alias("method"))
