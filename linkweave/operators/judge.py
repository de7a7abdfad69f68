"""Borderline pairs before a judge: their serialisation, verdicts, and what verdicts do to bands and probabilities."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import to_text
from ..model import AUTO_MATCH, AUTO_REJECT, BORDERLINE, FieldKind, JudgeError, Schema
from .blocking import paired

INCREASE, DECREASE, NO_CHANGE = "IncreaseConfidence", "DecreaseConfidence", "NoChange"
# Odds factors of the verdicts, and the scores from which a model's output is one.
RATIOS = {INCREASE: 4.5, DECREASE: 0.12, NO_CHANGE: 1.0}
UPPER, LOWER = 0.6, 0.35

#: A judge takes (a, b, pair_text) rows and returns a, b, verdict.
Judge = Callable[[DataFrame], DataFrame]


def shown(x: Column, kind: str) -> Column:
    """A value as the judge reads it: floats with 6 decimals, nothing for null and binary."""
    text = F.format_string("%.6f", x.cast("double")) if kind in ("double", "float") else to_text(x, kind)
    return F.coalesce(F.when(x.isNotNull(), text), F.lit(""))


def serialise(df: DataFrame, schema: Schema, a: str, b: str) -> Column:
    """The text of a pair whose records are the struct columns a and b."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema[a].dataType.fields}

    def record(r: str) -> list[Column]:
        return [F.concat(F.lit(f"COL:{f} VAL:"), shown(F.col(f"{r}.{f}"), kinds[f]) if f in kinds else F.lit("")) for f in schema.names]

    return F.concat_ws(" ", F.lit("[CLS]"), *record(a), F.lit("[SEP]"), *record(b), F.lit("[SEP]"))


def shown_fields(records: DataFrame, schema: Schema) -> DataFrame:
    return records.select("record_id", F.struct(*(c for c in schema.names if c in records.columns)).alias("r"))


def blocked_text(index: DataFrame, records: DataFrame, schema: Schema) -> DataFrame:
    """The index's candidate pairs (a, b) with pair_text; the fields travel with the index."""
    d = paired(index, shown_fields(records, schema))
    return d.withColumn("pair_text", serialise(d, schema, "x", "y")).drop("x", "y")


def with_text(pairs: DataFrame, records: DataFrame, schema: Schema) -> DataFrame:
    """pairs (a, b) with pair_text."""
    r = shown_fields(records, schema)
    d = pairs.join(r.select(F.col("record_id").alias("a"), F.col("r").alias("__x")), "a").join(r.select(F.col("record_id").alias("b"), F.col("r").alias("__y")), "b")
    return d.withColumn("pair_text", serialise(d, schema, "__x", "__y")).drop("__x", "__y")


def dummy_judge(pairs: DataFrame) -> DataFrame:
    """Promotes every pair."""
    return pairs.select("a", "b", F.lit(INCREASE).alias("verdict"))


def verdict(score: Column, upper: float = UPPER, lower: float = LOWER) -> Column:
    return F.when(score >= upper, INCREASE).when(score <= lower, DECREASE).otherwise(NO_CHANGE)


def model_judge(score: Callable[[list[str]], list[float]], upper: float = UPPER, lower: float = LOWER, chunk: int = 64) -> Judge:
    """A judge from a scoring function over texts, run in Arrow batches on the executors."""

    def judge(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for p in batches:
                out: list[float] = []
                for i in range(0, len(p), chunk):
                    out += score(p["pair_text"].iloc[i : i + chunk].tolist())
                yield pd.DataFrame({"a": p["a"], "b": p["b"], "score": pd.Series(out, dtype="float64", index=p.index)})

        scored = pairs.select("a", "b", "pair_text").mapInPandas(run, "a long, b long, score double")
        return scored.select("a", "b", verdict(F.col("score"), upper, lower).alias("verdict"))

    return judge


def onnx_judge(model_path: str, tokenize: Callable[[list[str]], dict], entailment: int = 1, **kwargs) -> Judge:
    """A judge from an ONNX classifier; tokenize gives the model's inputs for some texts."""
    held: dict = {}

    def score(texts: list[str]) -> list[float]:
        import numpy as np

        if "session" not in held:
            try:
                import onnxruntime
            except ImportError as e:
                raise JudgeError("onnxruntime is not installed") from e
            held["session"] = onnxruntime.InferenceSession(model_path)
        z = held["session"].run(None, tokenize(texts))[0]
        e = np.exp(z - z.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True))[:, entailment].tolist()

    return model_judge(score, **kwargs)


def apply_verdicts(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """scored with new bands for borderline pairs; resolution says what the judge did."""
    d = scored.join(verdicts.select("a", "b", "verdict"), ["a", "b"], "left")
    judged = F.col("band") == BORDERLINE
    up, down = judged & (F.col("verdict") == INCREASE), judged & (F.col("verdict") == DECREASE)
    resolution = F.when(up, "JudgePromoted").when(down, "JudgeDemoted")
    return d.withColumns({"resolution": resolution, "band": F.when(up, AUTO_MATCH).when(down, AUTO_REJECT).otherwise(F.col("band"))})


def calibrated(p: Column, of: Column, ratios: dict[str, float] | None = None) -> Column:
    """The probability after a verdict: its odds times the verdict's factor."""
    ratio = F.lit(None).cast("double")
    for name, x in (ratios or RATIOS).items():
        ratio = F.when(of == name, x).otherwise(ratio)
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = q / (1 - q) * ratio
    return odds / (1 + odds)


def effective_probability(band_before: Column, band_after: Column, p: Column, upper: float, lower: float) -> Column:
    """At least the upper threshold for a promoted pair, at most the lower for a demoted one."""
    up = (band_before == BORDERLINE) & (band_after == AUTO_MATCH)
    down = (band_before == BORDERLINE) & (band_after == AUTO_REJECT)
    return F.when(up, F.greatest(p, F.lit(upper))).when(down, F.least(p, F.lit(lower))).otherwise(p)


def near_duplicates(records: DataFrame, schema: Schema, offset: int, index: str = "position") -> DataFrame:
    """Two records for each: a copy and one with names shortened by a character and other month and day.

    records has a column of positions from 0; ids are offset + 2 * position and the next.
    """
    i = F.col(index)
    names, dates = set(schema.of_kind(FieldKind.NAME)), set(schema.of_kind(FieldKind.DATE))

    def changed(f: str) -> Column:
        x = F.col(f)
        if f in names:
            return F.when(F.length(x) > 1, F.left(x, F.length(x) - 1)).otherwise(x)
        if f in dates:
            alt = F.format_string("%s-%02d-%02d", F.left(x, F.lit(4)), (i % 11 + 1).cast("int"), (i % 25 + 1).cast("int"))
            return F.when(F.length(x) >= 4, alt).otherwise(x)
        return x

    one = lambda k, value: F.struct((offset + 2 * i + k).cast("long").alias("record_id"), F.lit(k == 1).alias("perturbed"), *(value(f).alias(f) for f in schema.names))
    return records.select(F.inline(F.array(one(0, F.col), one(1, changed))))
