"""The batch pipeline: records to entities.

The plan materialises twice: compared pairs (one stored table, read by pattern counting, scoring and clustering) and the collected
histogram of patterns. All else is lazy.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AUTO_MATCH, AUTO_REJECT, BORDERLINE, ClusterConfig, ConfigError, ModelParams, PipelineConfig, Schema
from ..operators import blocking, em
from ..operators import judge as J
from ..operators.cluster import cluster
from ..operators.compare import FieldComparator
from ..operators.inference import fingerprint
from ..sources.store import EntityStore, ModelRegistry
from ..storage import stored
from . import views


@dataclass
class BatchReport:
    records_in: int = 0
    candidate_pairs: int = 0
    cross_source_pairs: int = 0
    within_source_pairs: int = 0
    auto_matched: int = 0
    borderline: int = 0
    auto_rejected: int = 0
    judge_promoted: int = 0
    judge_demoted: int = 0
    entities_created: int = 0
    entities_updated: int = 0
    em_iterations: int = 0
    em_iterations_limit: int = 0
    startup_mode: str = "ColdStart"
    upper_threshold: float = 0.0
    lower_threshold: float = 0.0
    elapsed_ms: dict[str, int] = field(default_factory=dict)


@dataclass
class Resolved:
    report: BatchReport
    params: ModelParams | None
    compared: DataFrame | None = None
    scored: DataFrame | None = None
    members: DataFrame | None = None


class Pipeline:
    """Schema and store are required; blocker, comparator and the rest have defaults by schema."""

    def __init__(self, schema: Schema | None = None, store: EntityStore | None = None, blocker: blocking.CompositeBlocker | None = None, comparator: FieldComparator | None = None,
                 config: PipelineConfig | None = None, registry: ModelRegistry | None = None, judge: J.Judge | None = None, progress: Callable[[str, dict], None] | None = None):
        if schema is None or store is None:
            raise ConfigError("a pipeline needs a schema and a store")
        self.schema, self.store, self.config, self.registry, self.judge = schema, store, config or PipelineConfig(), registry, judge
        self.blocker = blocker or blocking.from_schema(schema)
        c = self.config
        self.comparator = comparator or FieldComparator(schema, c.field_mappings, c.missing_as_null, c.source_a)
        self.tell = progress or (lambda event, data: None)

    def run_batch(self, records: DataFrame) -> Resolved:
        """Resolves records (record_id, record_key, source, fields) against each other and stores the entities."""
        c, report, spark = self.config, BatchReport(), records.sparkSession
        began = last = time.time()

        def lap(stage: str, **data) -> None:
            nonlocal last
            report.elapsed_ms[stage] = int((time.time() - last) * 1000)
            last = time.time()
            self.tell(stage, data)

        if "source" not in records.columns:
            records = records.withColumn("source", F.lit(None).cast("string"))
        report.records_in = records.count()
        if not report.records_in:
            return Resolved(report, None)
        mode, params, print_ = "ColdStart", None, None
        if self.registry:  # the records of the smallest hashes: the same ones in every run
            sample = records.orderBy(F.xxhash64("record_id"), "record_id").limit(1000)
            print_ = fingerprint(self.schema, sample, c.field_mappings)
            mode, params = self.registry.startup(print_)
        if c.force_em and mode == "WarmLoad":
            mode = "WarmStart"
        report.startup_mode = mode
        lap("fingerprint", mode=mode)
        levels = self.comparator.level_columns
        compared = stored(self.comparator.compare_blocked(self.blocker.index(records), records, c.max_bucket, c.link_mode, ["source"]), "compared")
        same = F.col("source_a").eqNullSafe(F.col("source_b"))
        counts = compared.agg(F.count_if(~same).alias("n_cross"), F.count_if(same).alias("n_within")).first()
        compared = compared.drop("source_a", "source_b")
        report.cross_source_pairs, report.within_source_pairs = counts["n_cross"], counts["n_within"]
        report.candidate_pairs = counts["n_cross"] + counts["n_within"]
        lap("compare", pairs=report.candidate_pairs)
        fitted = self._parameters(compared, levels, mode, params, report)
        used = ModelParams(fitted.m, fitted.u, fitted.log_prior_odds, c.upper_threshold or fitted.upper_threshold, c.lower_threshold or fitted.lower_threshold)
        report.upper_threshold, report.lower_threshold = used.upper_threshold, used.lower_threshold
        lap("em", iterations=report.em_iterations)
        scored = em.score(compared, levels, used)
        if self.judge:
            scored = self._judged(scored, records, used, report)
        scored = scored if self.judge else scored.withColumn("resolution", F.lit(None).cast("string"))
        bands = {r["band"]: r["count"] for r in scored.groupBy("band").count().collect()}
        report.auto_matched, report.borderline, report.auto_rejected = (bands.get(b, 0) for b in (AUTO_MATCH, BORDERLINE, AUTO_REJECT))
        lap("score", **bands)
        edges = scored
        if c.judge_edge_weight == "calibrated":
            edges = scored.withColumn("match_probability", F.when(F.col("resolution").isNotNull(), J.calibrated(F.col("match_probability"), F.when(F.col("resolution") == "JudgePromoted", J.INCREASE).otherwise(J.DECREASE))).otherwise(F.col("match_probability")))
        found = self._members(edges, records, c.cluster)
        lap("cluster")
        ids = self.store.upsert(found)
        n = ids.agg(F.count_if("created").alias("new"), F.count_if(~F.col("created")).alias("old")).first()
        report.entities_created, report.entities_updated = n["new"], n["old"]
        if self.registry and report.candidate_pairs:
            self.registry.save(print_, fitted, "batch", report.em_iterations)
        lap("store")
        report.elapsed_ms["total"] = int((time.time() - began) * 1000)
        return Resolved(report, used, compared, scored, found)

    def _parameters(self, compared: DataFrame, levels: list[str], mode: str, params: ModelParams | None, report: BatchReport) -> ModelParams:
        if not report.candidate_pairs:
            return em.default_params(len(levels))
        if mode == "WarmLoad" and params:
            return params
        warm = mode == "WarmStart" and params and len(params.m) == len(levels)
        report.em_iterations_limit = self.config.warm_iterations if warm else self.config.cold_iterations
        x, n = em.collected(em.patterns(compared, levels), levels)
        fitted, report.em_iterations = em.run_em(x, n, params if warm else None, report.em_iterations_limit)
        return fitted

    def _judged(self, scored: DataFrame, records: DataFrame, params: ModelParams, report: BatchReport) -> DataFrame:
        asked = J.with_text(scored.where(F.col("band") == BORDERLINE).select("a", "b"), records, self.schema)
        out = stored(J.apply_verdicts(scored, self.judge(asked)), "judged")
        n = {r["resolution"]: r["count"] for r in out.groupBy("resolution").count().collect()}
        report.judge_promoted, report.judge_demoted = n.get("JudgePromoted", 0), n.get("JudgeDemoted", 0)
        return out

    def _members(self, scored: DataFrame, records: DataFrame, config: ClusterConfig) -> DataFrame:
        found = cluster(scored, config)
        if self.judge:  # a record all of whose links the judge made
            ends = F.inline(F.array(*(F.struct(F.col(x).alias("record_id"), F.col("resolution").isNull().alias("plain")) for x in ("a", "b"))))
            plain = scored.where(F.col("band") == AUTO_MATCH).select(ends).groupBy("record_id").agg(F.max("plain").alias("plain"))
            found = found.join(plain, "record_id").withColumn("method", F.when(F.col("plain"), F.col("method")).otherwise("JudgePromoted")).drop("plain")
        keys = records.select("record_id", "record_key" if "record_key" in records.columns else F.col("record_id").cast("string").alias("record_key"), "source")
        return found.join(keys, "record_id").select("entity", "record_id", "record_key", "score", "method", "source")

    def cluster_view(self, records: DataFrame) -> DataFrame:
        return views.clusters(self.store.members(), records)


