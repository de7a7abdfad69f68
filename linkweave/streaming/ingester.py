"""Record-at-a-time resolution as a Structured Streaming foreachBatch sink.

Each micro-batch behaves as if its records arrived one by one in the order of their sequence number: a record meets the index of
earlier batches and the earlier records of its own batch, takes its best partner, and joins the partner's entity, becomes a singleton or
waits as a borderline case. A partner without an entity founds one of its own id. Chains of matches inside a batch are followed by connected
components over the chosen links.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AUTO_MATCH, AUTO_REJECT, BORDERLINE, ModelParams, RateConfig, Schema
from ..functions.normalize import to_text
from ..operators import blocking, em
from ..operators.compare import FieldComparator
from ..operators.graph import components
from ..sources.store import ModelRegistry
from ..storage import Versions, forget, shared_dir, stored

RESULT = "record_id long, seq long, band string, partner long, entity long, score double, method string"


class RateAdapter:
    """Widens the match band under load: at the fast rate and above the upper threshold is divided by the widening."""

    def __init__(self, config: RateConfig | None = None):
        self.config, self.rate = config or RateConfig(), 0.0

    def observe(self, records: int, seconds: float) -> None:
        self.rate = records / seconds if seconds > 0 else 0.0

    def adjusted(self, p: ModelParams) -> ModelParams:
        if self.rate < self.config.fast_threshold:
            return p
        return ModelParams(p.m, p.u, p.log_prior_odds, p.upper_threshold / self.config.widening, p.lower_threshold)


class Ingester:
    """Resolves batches against all that came before.

    State is a folder of append-only tables (storage.Versions): records, their keys, results, and entities (the entity of each resolved record, a
    later row going before an earlier one). One state file publishes a batch's rows in all of them, with the batch's number. A batch whose
    number isn't above the last one's is a replay: its stored results are returned and nothing is added, so the sink is exactly-once with
    foreachBatch. A new Ingester on the same path goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, schema: Schema, blocker: blocking.CompositeBlocker | None = None, comparator: FieldComparator | None = None,
                 params: ModelParams | None = None, registry: ModelRegistry | None = None, rate: RateConfig | None = None, path: str | None = None):
        self.spark, self.schema = spark, schema
        self.blocker, self.comparator = blocker or blocking.from_schema(schema), comparator or FieldComparator(schema)
        if params is None and registry is not None:
            from ..operators.inference import schema_hash

            params = registry.exact(schema_hash(schema))
        self.params = params or em.default_params(len(self.comparator.fields))
        self.adapter = RateAdapter(rate) if rate else None
        self.columns = list(dict.fromkeys([*schema.names, *(f for a, b, *_ in self.comparator.fields for f in (a, b))]))
        fields = ", ".join(f"`{f}` string" for f in self.columns)
        self.path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        self.versions = Versions(spark, self.path, {
            "records": f"record_id long, seq long, source string, {fields}", "keys": "block_key string, record_id long, seq long",
            "results": f"{RESULT}, batch long", "entities": "record_id long, entity long, seq long",
        })

    def _entities(self, state: dict) -> DataFrame:
        """record_id, entity: the newest of each record."""
        return self.versions.table("entities", state).groupBy("record_id").agg(F.max(F.struct("seq", "entity"))["entity"].alias("entity"))

    def process(self, batch: DataFrame, batch_id: int | None = None) -> DataFrame:
        """Resolves a batch (record_id, seq, fields; seq grows over batches) and returns its results. Without a number it is the next batch."""
        began = time.time()
        state = self.versions.state()
        last = state.get("batch", -1)
        batch_id = last + 1 if batch_id is None else batch_id
        if batch_id <= last:
            return self._results(state).where(F.col("batch") == batch_id).drop("batch")
        if "source" not in batch.columns:
            batch = batch.withColumn("source", F.lit(None).cast("string"))
        kinds = dict(batch.dtypes)
        text = [to_text(F.col(f), kinds[f]).alias(f) if f in kinds else F.lit(None).cast("string").alias(f) for f in self.columns]
        plain = stored(batch.select(F.col("record_id").cast("long").alias("record_id"), F.col("seq").cast("long").alias("seq"), "source", *text), "arrived")
        keys = stored(self.blocker.index(batch).select("block_key", "record_id").join(plain.select("record_id", "seq"), "record_id").select("block_key", "record_id", "seq"), "keys")
        # only keys meet all that came before; records are read for the pairs found
        index = self.versions.table("keys", state).unionByName(keys)
        count = lambda d, n: d.groupBy("block_key").agg(F.count("*").alias(n))
        sizes = count(keys, "nx").join(count(index, "ny").where("ny > 1"), "block_key")
        probes, near = stored(keys.join(sizes, "block_key"), "probes"), stored(index.join(sizes, "block_key"), "near")
        wanted = near.select("record_id").distinct()
        rows = self.versions.table("records", state).unionByName(plain).join(wanted, "record_id", "left_semi")
        newest = rows.groupBy("record_id").agg(F.max(F.struct("seq", "source", *self.columns)).alias("x")).select("record_id", "x.*")
        packed, made = self.comparator.packed(newest)
        packed = stored(packed, "packed")
        # fields travel with the keys, and each partition keeps one partner for a record: no pair is shuffled. A pair that shares several keys is
        # compared for each, which changes no maximum
        size = probes.agg(F.sum("ny").alias("looks"), F.count("*").alias("rows"), F.max(F.greatest("nx", "ny")).alias("most")).first()
        pairs = blocking.meet(probes.join(packed, "record_id"), near.join(packed, "record_id"), size["looks"] or 0, size["rows"], size["most"] or 0, F.expr("y.seq < x.seq AND x.record_id <> y.record_id"))
        pairs = pairs.select(F.col("x.record_id").alias("a"), F.col("y.record_id").alias("b"), F.col("y.seq").alias("t"), F.col("x.r").alias("x"), F.col("y.r").alias("y"))
        compared = self.comparator.levels(pairs, made)
        scored = em.score(compared, self.comparator.level_columns, self.adapter.adjusted(self.params) if self.adapter else self.params)
        # the heaviest partner, the last to arrive of equals
        best = (
            scored.groupBy("a").agg(F.max(F.struct("match_weight", "t", "b", "match_probability", "band")).alias("x"))
            .select(F.col("a").alias("record_id"), F.col("x.b").alias("partner"), F.col("x.match_probability").alias("score"), F.col("x.band").alias("band"))
        )
        out = plain.select("record_id", "seq").join(best, "record_id", "left").withColumn("band", F.coalesce("band", F.lit(AUTO_REJECT)))
        out = stored(out, "resolved")
        known = self._entities(state)
        assigned = stored(self._assigned(out, known), "assigned")
        done = out.join(assigned, "record_id", "left").select(
            "record_id", "seq", "band", F.when(F.col("band") == AUTO_MATCH, F.col("partner")).alias("partner"), "entity",
            F.when(F.col("band") == AUTO_REJECT, 1.0).otherwise(F.col("score")).alias("score"),
            F.when(F.col("band") == AUTO_REJECT, "Manual").when(F.col("band") == AUTO_MATCH, "AutoMatch").alias("method"),
            F.lit(batch_id).cast("long").alias("batch"),
        )
        # a borderline record of an earlier batch that is now a partner has an entity from here on
        top = plain.agg(F.max("seq")).first()[0] or 0
        fresh = assigned.select("record_id", "entity", F.lit(top).cast("long").alias("seq"))
        state = self.versions.publish({"records": plain, "keys": keys, "results": done, "entities": fresh}, batch=batch_id)
        if self.adapter:
            self.adapter.observe(plain.count(), time.time() - began)
        forget(plain, keys, probes, near, packed, out, assigned)
        return self._results(state).where(F.col("batch") == batch_id).drop("batch")

    @staticmethod
    def _assigned(out: DataFrame, known: DataFrame) -> DataFrame:
        """record_id, entity of what the batch resolves: its own records, and earlier ones without an entity that its records match.

        A record has at most one partner, which came before it, so links form trees. A tree's root is the only node without a link of its
        own: its stored entity, or else its own id, is the entity of the tree.
        """
        links = out.where(F.col("band") == AUTO_MATCH).select(F.col("record_id").alias("a"), F.col("partner").alias("b"))
        trees = stored(components(links).select(F.col("node").alias("record_id"), "component"), "trees")
        roots = trees.join(links.select(F.col("a").alias("record_id")), "record_id", "left_anti").join(known, "record_id", "left")
        roots = roots.select("component", F.coalesce("entity", "record_id").alias("entity"))
        in_tree = trees.join(roots, "component").select("record_id", "entity")
        single = out.where(F.col("band") == AUTO_REJECT).join(trees, "record_id", "left_anti").join(known, "record_id", "left")
        return in_tree.unionByName(single.select("record_id", F.coalesce("entity", "record_id").alias("entity")))

    def _results(self, state: dict) -> DataFrame:
        now = self._entities(state).withColumnRenamed("entity", "now")
        rows = self.versions.table("results", state).join(now, "record_id", "left")
        return rows.withColumn("entity", F.coalesce("now", "entity")).drop("now")

    @property
    def results(self) -> DataFrame:
        """One row for each record that came, with the entity it has by now."""
        return self._results(self.versions.state()).drop("batch")

    def start(self, stream: DataFrame, checkpoint: str):
        """Runs on a streaming DataFrame; rows need seq (offset or event order). Batches are numbered as the checkpoint numbers them."""
        return stream.writeStream.foreachBatch(lambda df, i: self.process(df, i) and None).option("checkpointLocation", checkpoint).start()

    def borderlines(self) -> DataFrame:
        """Records that wait for a judge."""
        return self.results.where((F.col("band") == BORDERLINE) & F.col("entity").isNull())

    flush_borderlines = borderlines
