"""Clustering of scored pairs into entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AUTO_MATCH, ClusterConfig
from ..storage import forget, numbered, stored
from .graph import components

PROB = "match_probability"


def partition_by_band(scored: DataFrame, band: str) -> DataFrame:
    return scored.where(F.col("band") == band)


def edges(scored: DataFrame, config: ClusterConfig) -> DataFrame:
    """a, b, p of automatic matches: the best of repeated edges, weak ones dropped."""
    best = partition_by_band(scored, AUTO_MATCH).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(PROB).alias("p"))
    return best.where(F.col("p") >= config.within_cluster_min)


def both_ends(links: DataFrame) -> DataFrame:
    return links.select(F.inline(F.array(F.struct(F.col("a").alias("record_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("record_id"), F.col("a").alias("other")))))


def star_prune(members: DataFrame, links: DataFrame | None, config: ClusterConfig, degrees: DataFrame | None = None, beside: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """members (record_id, entity) where components above the size limit keep only their hub and its neighbours.

    The hub is the record with most links, the smallest id among equals; the others become unclustered. Links that are too many to be
    listed are given by degrees (record_id, n) and beside, which returns record_id, other for the links of the records asked.
    """
    sizes = members.groupBy("entity").agg(F.count("*").alias("n"))
    big = stored(sizes.where(F.col("n") > config.max_cluster_size).select("entity"), "crowded")
    if big.isEmpty():
        forget(big)
        return members.select("record_id", "entity")
    if degrees is None:
        degrees = both_ends(links).groupBy("record_id").agg(F.count("*").alias("n"))
    degree = members.join(big, "entity", "left_semi").join(degrees, "record_id")
    hubs = degree.groupBy("entity").agg(F.max(F.struct("n", -F.col("record_id")))["col2"].alias("neg")).select("entity", (-F.col("neg")).alias("record_id"))
    hubs = stored(hubs, "hubs")
    near = beside(hubs.select("record_id")) if beside else both_ends(links)
    kept = near.join(hubs, "record_id").select("entity", F.explode(F.array("record_id", "other")).alias("record_id")).distinct()
    # the kept star's label is its own smallest record
    relabelled = kept.join(kept.groupBy("entity").agg(F.min("record_id").alias("label")), "entity").select("record_id", F.col("label").alias("entity"))
    return members.join(big, "entity", "left_anti").select("record_id", "entity").unionByName(relabelled)


def cluster(scored: DataFrame, config: ClusterConfig | None = None) -> DataFrame:
    """record_id, entity (its smallest record), score (best incident match), method; entities of two records or more.

    scored is read once, for its automatic matches.
    """
    config = config or ClusterConfig()
    matches = stored(partition_by_band(scored, AUTO_MATCH).select("a", "b", PROB, "band"), "matches")
    strong = matches.where(F.col(PROB) >= config.within_cluster_min).select("a", "b")
    found = stored(components(strong).select(F.col("node").alias("record_id"), F.col("component").alias("entity")), "found")
    members = star_prune(found, edges(matches, config), config)
    ends = matches.select(F.inline(F.array(F.struct(F.col("a").alias("record_id"), F.col(PROB).alias("p")), F.struct(F.col("b").alias("record_id"), F.col(PROB).alias("p")))))
    best = ends.groupBy("record_id").agg(F.max("p").alias("score"))
    return members.join(best, "record_id").select("record_id", "entity", "score", F.lit(AUTO_MATCH).alias("method"))


def dense_ids(members: DataFrame) -> DataFrame:
    """Entities numbered 1 to n by their smallest record."""
    return members.join(numbered(members.select("entity").distinct(), "entity", "entity_id"), "entity")
