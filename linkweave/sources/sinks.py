"""Writers of results and reports, and the summary reader."""

from __future__ import annotations

import datetime
import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a run's summary, in order.
SUMMARY = [
    "library", "mode", "dataset", "run_id", "timestamp", "total_records", "candidate_pairs", "auto_matched", "borderline", "auto_rejected",
    "elapsed_ms", "true_pos", "false_pos", "false_neg", "precision", "recall", "f1",
]
# The columns of a written pair.
PAIR = ["run_id", "record_key_a", "source_a", "record_key_b", "source_b", "match_probability", "predicted_match"]


def utc_now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def format_unix(seconds: int) -> str:
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_pairs(scored: DataFrame, path: str) -> None:
    """One JSON object a pair, in as many files as there are partitions."""
    have = set(scored.columns)
    scored.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in PAIR)).write.mode("overwrite").json(path)


def write_scored_csv(scored: DataFrame, truth: DataFrame, path: str) -> None:
    """score, is_match by descending score; the order is global, over range partitions."""
    tagged(scored, truth).select(F.col("match_probability").alias("score"), "is_match").orderBy(F.desc("score")).write.mode("overwrite").csv(path, header=True)


def tagged(scored: DataFrame, truth: DataFrame) -> DataFrame:
    hit = truth.select("key_a", "key_b", F.lit(True).alias("hit"))
    return scored.join(hit, ["key_a", "key_b"], "left").withColumn("is_match", F.coalesce("hit", F.lit(False))).drop("hit")


def write_stratified_csv(rows: DataFrame, path: str) -> None:
    rows.orderBy("match_type").coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_summary(rows: DataFrame, path: str) -> None:
    have = set(rows.columns)
    rows.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in SUMMARY)).coalesce(1).write.mode("append").csv(path, header=True)


def read_summaries(spark: SparkSession, glob: str, mode: str | None = None, dataset: str | None = None) -> DataFrame:
    d = spark.read.csv(glob, header=True)
    for column, value in (("mode", mode), ("dataset", dataset)):
        if value is not None:
            d = d.where(F.col(column) == value)
    return d.orderBy("mode", "dataset", "library")


def normal_mode(mode: str) -> str:
    """Modes as summaries name them, whatever their spelling."""
    m = mode.lower().replace("-", "_")
    return "deduplicate" if m == "dedupe" else m


def comparison(spark: SparkSession, folder: str, mode: str = "", dataset: str = "") -> DataFrame:
    """The rows of all summaries below a folder, of one mode and of datasets whose name holds a text if these are given, in a stable order."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder, header=True, schema=", ".join(f"{c} string" for c in SUMMARY))
    if mode:
        plain = F.regexp_replace(F.regexp_replace(F.lower("mode"), "-", "_"), "^dedupe$", "deduplicate")
        d = d.where(plain == normal_mode(mode))
    if dataset:
        d = d.where(F.col("dataset").contains(dataset))
    return d.orderBy("mode", "dataset", "library")


def write_comparison(rows: DataFrame, folder: str, mode: str = "", dataset: str = "") -> str:
    """The rows as one CSV, named by mode and dataset; returns its path. Summaries have a row a run, so one file is bounded."""
    slug = lambda x: x.replace("-", "_") or "all"
    path = f"{folder}/comparison_{slug(mode)}_{slug(dataset)}"
    rows.select(*SUMMARY).coalesce(1).write.mode("overwrite").csv(path, header=True)
    return path


def comparison_text(rows: DataFrame) -> str:
    """The rows as a table of library, mode, dataset, precision, recall, f1 and time; ratios with three decimals, what is missing as a dash."""
    heads = ["library", "mode", "dataset", "precision", "recall", "f1", "elapsed_ms"]
    three = lambda x: "-" if x in (None, "") else f"{float(x):.3f}"
    cells = [[r[0], r[1], r[2], *map(three, r[3:6]), r[6] or "-"] for r in rows.select(*heads).collect()]
    widths = [max(len(str(x)) for x in column) for column in zip(heads, *cells)]
    line = lambda xs: "  ".join(f"{x:<{w}}" if i < 3 else f"{x:>{w}}" for i, (x, w) in enumerate(zip(xs, widths)))
    return "\n".join([line(heads), "-" * (sum(widths) + 2 * len(widths) - 2), *map(line, cells)])


# The fields of a run report's metrics, in order, and the decimals they are rounded to.
METRICS = {
    "total_records": 0, "candidate_pairs": 0, "auto_matched": 0, "borderline": 0, "auto_rejected": 0, "precision": 3, "recall": 3, "f1": 3, "optimal_threshold": 6, "true_pos": 0,
    "false_pos": 0, "false_neg": 0, "pipeline_precision": 3, "pipeline_recall": 3, "pipeline_f1": 3, "pipeline_true_pos": 0, "pipeline_false_pos": 0, "pipeline_false_neg": 0,
    "f1_max": 4, "pr_auc": 4, "cluster_recall": 4,
}


def run_report(run: dict, metrics: dict, strata: list[dict], stem: str, scored_csv: str | None = None) -> dict:
    """The report of one evaluation run: run_id, library, scenario, mode, dataset and target of run, its files, metrics and strata."""
    rounded = {k: None if metrics.get(k) is None else round(metrics[k], n) if n else int(metrics[k]) for k, n in METRICS.items()}
    strat = [{k: round(r[k], 4) if k == "recall" else r[k] for k in ("match_type", "count_gt", "true_pos", "false_neg", "recall")} for r in strata]
    files = {"summary_csv": f"{stem}_summary.csv", "pairs_ndjson": f"{stem}_pairs.ndjson", "strat_csv": f"{stem}_strat.csv" if any(r["match_type"] for r in strat) else None, "scored_pairs_csv": scored_csv}
    head = {k: run.get(k) for k in ("run_id", "library", "scenario", "mode", "dataset", "target")}
    return {**head, "timestamp_unix": int(time.time()), "files": files, "metrics": rounded, "strat": strat, "scored_pairs": None}


def write_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=1, sort_keys=True))


def append_audit(verdicts: DataFrame, path: str) -> None:
    """The judge's decisions, appended as JSON lines."""
    verdicts.write.mode("append").json(path)
