"""The entity store and the model registry."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ModelParams, StoreError
from ..storage import Versions, forget, numbered, shared_dir, stored

MEMBERS = "entity_id long, record_id long, record_key string, score double, method string, source string"
EVENTS = "event_type string, entity_id long, n_records long, step long"


class EntityStore:
    """Members and events under a folder, of which one state is current: both change at once, and a store on an existing folder goes on from there."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/entities-{uuid.uuid4().hex}"
        self.versions = Versions(spark, self.path, {"members": MEMBERS, "events": EVENTS})

    def members(self) -> DataFrame:
        return self.versions.table("members")

    def events(self) -> DataFrame:
        return self.versions.table("events")

    def upsert(self, members: DataFrame) -> DataFrame:
        """Adds clusters (entity, record_id, record_key, score, method, source) and returns entity, entity_id, created.

        A cluster joins the entity of its first stored record (the smallest record_id); without one it becomes a new entity, numbered on
        in the order of the clusters. Records that are stored already stay where they are; entities never merge. Only what is new is written.
        """
        state = self.versions.state()
        top, step = state.get("top", 0), state.get("step", 0) + 1
        members, now = stored(members, "upsert"), self.versions.table("members", state)
        known = members.join(now.select("record_id", "entity_id"), "record_id")
        joined = known.groupBy("entity").agg(F.min(F.struct("record_id", "entity_id"))["entity_id"].alias("entity_id"))
        fresh = members.select("entity").distinct().join(joined, "entity", "left_anti")
        fresh = numbered(fresh, "entity", "entity_id", top)
        ids = stored(joined.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True))), "upsert-ids")
        added = members.join(ids, "entity").join(now.select("record_id"), "record_id", "left_anti")
        new = stored(added.select("entity_id", "record_id", "record_key", "score", "method", "source", "created"), "upsert-new")
        events = new.groupBy("entity_id", "created").agg(F.count("*").alias("n_records")).select(F.when(F.col("created"), "EntityCreated").otherwise("RecordsAdded").alias("event_type"), "entity_id", "n_records", F.lit(step).cast("long").alias("step"))
        top = max(top, ids.agg(F.max("entity_id")).first()[0] or 0)
        self.versions.publish({"members": new.drop("created"), "events": events}, top=top, step=step)
        forget(members, new)
        return ids

    def entity(self, entity_id: int) -> DataFrame:
        return self.members().where(F.col("entity_id") == entity_id)

    def entity_of(self, records: DataFrame) -> DataFrame:
        return records.select("record_id").join(self.members(), "record_id").select("record_id", "entity_id")

    def entities(self) -> DataFrame:
        """entity_id and its members as an array."""
        one = F.struct("record_id", "record_key", "score", "method", "source")
        return self.members().groupBy("entity_id").agg(F.sort_array(F.collect_list(one)).alias("members"))


class ModelRegistry:
    """Fitted parameters by schema fingerprint: one JSON file each, published by rename."""

    WARM_START = 0.25

    def __init__(self, path: str):
        self.path = path
        os.makedirs(path, exist_ok=True)

    def _file(self, schema_hash: str) -> str:
        return os.path.join(self.path, f"{schema_hash}.json")

    def save(self, fingerprint: dict, params: ModelParams, tag: str = "", iterations: int = 0) -> None:
        body = {"fingerprint": fingerprint, "params": json.loads(params.to_json()), "tag": tag, "em_iterations": iterations}
        tmp = self._file(fingerprint["hash"]) + f".{uuid.uuid4().hex}.tmp"
        with open(tmp, "w") as f:
            json.dump(body, f)
        os.replace(tmp, self._file(fingerprint["hash"]))

    def _load(self, file: str) -> dict:
        try:
            with open(file) as f:
                return json.load(f)
        except ValueError as e:
            raise StoreError(f"{file}: {e}") from e

    def exact(self, schema_hash: str) -> ModelParams | None:
        file = self._file(schema_hash)
        return ModelParams(**self._load(file)["params"]) if os.path.exists(file) else None

    def all(self) -> list[dict]:
        return [self._load(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".json")]

    def nearest(self, fingerprint: dict) -> tuple[float, ModelParams] | None:
        from ..operators.inference import fingerprint_distance

        found = [(fingerprint_distance(fingerprint, x["fingerprint"]), i, x) for i, x in enumerate(self.all())]
        if not found:
            return None
        d, _, x = min(found, key=lambda f: f[:2])
        return d, ModelParams(**x["params"])

    def startup(self, fingerprint: dict) -> tuple[str, ModelParams | None]:
        """WarmLoad for a known schema, WarmStart for a near one, else ColdStart."""
        if p := self.exact(fingerprint["hash"]):
            return "WarmLoad", p
        near = self.nearest(fingerprint)
        return ("WarmStart", near[1]) if near and near[0] <= self.WARM_START else ("ColdStart", None)

    def delete(self, schema_hash: str) -> bool:
        file = self._file(schema_hash)
        if os.path.exists(file):
            os.remove(file)
            return True
        return False
