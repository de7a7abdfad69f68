"""Evaluation scenarios by name, their strategies, and a run of one: files in, entities and a report out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..model import FieldDef, FieldKind, FieldMapping, LinkMode, PipelineConfig, Schema
from ..operators import blocking as B
from ..operators import metrics
from ..operators.compare import FieldComparator
from ..operators.inference import harness_kind
from ..sources import ingest, sinks
from ..sources.store import EntityStore
from .pipeline import Pipeline, Resolved

# The fields that registers of persons share with each other one, all compared only where both have them.
SHARED = {
    "kvk": ["voornamen", "tussenvoegsel", "achternaam", "geboortedatum", "woonplaats", "postcode"],
    "sis": ["voornamen", "achternaam", "geboortedatum", "geboorteplaats", "geboorteland", "nationaliteit", "geslacht"],
    "hks": ["voornamen", "tussenvoegsel", "achternaam", "geboortedatum", "geboorteplaats", "geboorteland", "nationaliteit", "geslacht"],
    "kvk_hks": ["voornamen", "tussenvoegsel", "achternaam", "geboortedatum", "geboorteplaats", "geboorteland", "nationaliteit", "geslacht", "woonplaats", "postcode"],
}
# The scenarios and their tags.
NAMES = {
    "brp/dedupe": "dedupe", "brp/link": "link", "brp/link_and_dedupe": "link-and-dedupe", "brp_kvk/link": "cross-schema kvk", "brp_sis/link": "cross-schema sis",
    "brp_hks/link": "cross-schema hks", "brp_kvk_hks/link_and_dedupe": "cross-schema kvk hks", "kvk/dedupe": "kvk", "micro/brp/dedupe": "micro micro-dedupe",
    "micro/brp/link": "micro micro-link", "micro/brp/link_and_dedupe": "micro micro-link-and-dedupe", "micro/brp_sis/link": "micro cross-schema sis",
}
MODES = {"dedupe": LinkMode.DEDUPLICATE, "link": LinkMode.LINK_ONLY, "link_and_dedupe": LinkMode.LINK_AND_DEDUPE}


@dataclass(frozen=True)
class Scenario:
    """sources: (path, label) each; paths are relative to the data folder."""

    name: str
    sources: tuple[tuple[str, str], ...]
    truth: str
    mode: LinkMode
    mappings: tuple[FieldMapping, ...]
    tags: tuple[str, ...]

    @property
    def dataset(self) -> str:
        return self.name.replace("/", "_")


def scenario(name: str, tags: str = "") -> Scenario:
    """A scenario by its name alone: one register twice is sources a and b, several registers are one source each."""
    *_, registers, kind = name.split("/")
    folder, labels = f"benchmarks/{name}", registers.split("_")
    if kind == "dedupe":
        sources = ((f"{folder}/source.csv", registers),)
    elif len(labels) == 1:
        sources = tuple((f"{folder}/source_{x}.csv", f"{registers}_{x}") for x in "ab")
    else:
        sources = tuple((f"{folder}/source_{x}.csv", x) for x in labels)
    shared = SHARED["_".join(labels[1:])] if len(labels) > 1 else []
    return Scenario(name, sources, f"{folder}/ground_truth.csv", MODES[kind], tuple(FieldMapping(f, f) for f in shared), tuple(tags.split()))


SCENARIOS = {name: scenario(name, tags) for name, tags in NAMES.items()}


def by_tag(tag: str) -> list[Scenario]:
    return [s for s in SCENARIOS.values() if tag in s.tags]


def full_size() -> list[Scenario]:
    return [s for s in SCENARIOS.values() if "micro" not in s.tags]


def throughput() -> list[Scenario]:
    """Those of a single source, whose pairs the throughput run counts."""
    return [s for s in SCENARIOS.values() if s.mode == LinkMode.DEDUPLICATE]


def _wider_comparator(schema: Schema, config: PipelineConfig) -> FieldComparator:
    c = FieldComparator(schema, config.field_mappings, config.missing_as_null, config.source_a)
    more = {FieldKind.NAME: [S.jaro_winkler, S.phonetic_equal, S.token_overlap], FieldKind.ADDRESS: [S.address_overlap, S.street_number]}
    for f in schema.fields:
        if f.kind in more and any(a == f.name for a, *_ in c.fields):
            c.with_fns(f.name, *more[f.kind])
    return c


def strategy(s: Scenario) -> dict:
    """What a scenario changes in the pipeline: functions from the schema (and config) to a comparator or a blocker."""
    plain = s.dataset.removeprefix("micro_")
    if plain in ("brp_dedupe", "kvk_dedupe"):  # sound-alike names and transposed house numbers
        return {"comparator": _wider_comparator}
    if plain in ("brp_hks_link", "brp_sis_link", "brp_kvk_hks_link_and_dedupe"):  # first names that are initials
        return {"blocker": lambda schema: B.CustomCategory().phonetic_name_dob_initial().build(schema)}
    return {}


def load(spark: SparkSession, s: Scenario, root: str) -> tuple[DataFrame, Schema]:
    """The sources' records, with null for fields that a source lacks, and the schema of all fields."""
    tables = [ingest.read_csv(spark, f"{root}/{path}", label) for path, label in s.sources]
    records = tables[0]
    for t in tables[1:]:
        records = records.unionByName(t, allowMissingColumns=True)
    fields = [c for c in records.columns if c not in ("record_id", "record_key", "source")]
    return records, Schema(tuple(FieldDef(f, harness_kind(f)) for f in fields))


def run(spark: SparkSession, s: Scenario, root: str, config: PipelineConfig | None = None, store: EntityStore | None = None) -> tuple[Resolved, dict]:
    """Resolves a scenario's files and evaluates the result against its true pairs."""
    records, schema = load(spark, s, root)
    config = replace(config or PipelineConfig(), link_mode=s.mode.value, field_mappings=list(s.mappings), source_a=s.sources[0][1] if s.mappings else None)
    own = strategy(s)
    pipeline = Pipeline(schema, store or EntityStore(spark), own["blocker"](schema) if "blocker" in own else None, own["comparator"](schema, config) if "comparator" in own else None, config)
    done = pipeline.run_batch(records)
    truth = ingest.ground_truth(spark.read.csv(f"{root}/{s.truth}", header=True))
    return done, report(s, done, records, truth)


def report(s: Scenario, done: Resolved, records: DataFrame, truth: DataFrame) -> dict:
    keys = records.select("record_id", "record_key")
    pairs = done.scored.join(keys.select(F.col("record_id").alias("a"), F.col("record_key").alias("ka")), "a").join(keys.select(F.col("record_id").alias("b"), F.col("record_key").alias("kb")), "b")
    pairs = ingest.canonical_pairs(pairs, "ka", "kb")
    matched = pairs.where("band = 'AutoMatch'")
    own, points = metrics.confusion(matched, truth).first(), metrics.curve(pairs, truth)
    best, area, r = metrics.best_threshold(points).first(), metrics.pr_auc(points).first()[0], done.report
    found = metrics.cluster_recall(done.members, truth).first()["cluster_recall"]
    fn = truth.select("key_a", "key_b").distinct().count() - (best["tp"] or 0)
    numbers = {
        "total_records": r.records_in, "candidate_pairs": r.candidate_pairs, "auto_matched": r.auto_matched, "borderline": r.borderline, "auto_rejected": r.auto_rejected,
        "precision": best["precision"], "recall": best["recall"], "f1": best["f1"], "optimal_threshold": best["threshold"], "true_pos": best["tp"], "false_pos": best["fp"], "false_neg": fn,
        "pipeline_precision": own["precision"], "pipeline_recall": own["recall"], "pipeline_f1": own["f1"], "pipeline_true_pos": own["tp"], "pipeline_false_pos": own["fp"],
        "pipeline_false_neg": own["fn"], "f1_max": best["f1"], "pr_auc": area, "cluster_recall": found,
    }
    strata = [x.asDict() for x in metrics.stratified_recall(matched, truth).orderBy("match_type").collect()]
    return sinks.run_report({"run_id": s.dataset, "library": "linkweave", "scenario": s.name, "mode": s.mode.value, "dataset": s.dataset, "target": "spark"}, numbers, strata, s.dataset)
