"""Schema inference from names and values, field statistics and fingerprints."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tomllib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import to_text
from ..model import EmptySchema, FieldDef, FieldKind, FieldMapping, Schema

# Rules on lower-cased names, tried in this order; within a rule any test suffices.
NAME_RULES = [
    {"kind": "Name", "contains": ["first", "fname", "given", "voornamen", "last", "lname", "surname", "family"], "exact": ["name", "voornamen", "achternaam", "naam"], "ends": ["_name"]},
    {"kind": "Date", "contains": ["dob", "birth", "born", "geboortedatum", "date", "_dt", "activatiedatum"], "ends": ["_at"]},
    {"kind": "Phone", "contains": ["phone", "telefoon", "mobile", "cell"], "exact": ["msisdn", "tel"], "starts": ["tel_"], "ends": ["_tel"]},
    {"kind": "Address", "contains": ["addr", "street", "straat", "city", "woonplaats", "huisnummer", "zip", "postcode", "postal"]},
    {"kind": "Id", "contains": ["ssn", "passport", "license", "document_nummer", "_id"], "exact": ["bsn", "imsi", "iccid"], "ends": ["id", "_nr", "nummer"]},
    {"kind": "Numeric", "contains": ["age", "count", "score", "amount", "lengte"]},
    {"kind": "LicensePlate", "contains": ["kenteken", "plate", "license_plate"]},
    {"kind": "GpsCoordinate", "exact": ["lat", "lon", "latitude", "longitude"]},
    {"kind": "Timestamp", "contains": ["tijdstip", "timestamp", "datetime"]},
]
# Patterns of values, tried in this order; all conditions of one must hold.
VALUE_RULES = [
    {"kind": "Date", "regex": r"^\d{4}[-/]\d{2}[-/]\d{2}$", "share": 0.8},
    {"kind": "Phone", "regex": r"^[\d\s\-\+\(\)]{7,15}$", "share": 0.8},
    {"kind": "Numeric", "regex": r"^\d+(\.\d+)?$", "share": 0.9},
    {"kind": "Id", "regex": r"^[A-Z0-9\-]{4,20}$", "share": 0.8, "unique_min": 0.9},
    {"kind": "Name", "unique_min": 0.7, "length_max": 30.0},
    {"kind": "Categorical", "unique_max": 0.2},
]
SAMPLE, TOP = 50, 10
#: Environment variables that name rule files to be used where no rules are given.
NAME_FILE, VALUE_FILE = "LINKWEAVE_NAME_RULES", "LINKWEAVE_VALUE_RULES"


def rules_from(path: str) -> list[dict]:
    """Rules of a TOML file: one [[rules]] table each, with the keys of NAME_RULES or VALUE_RULES."""
    with open(path, "rb") as f:
        rules = tomllib.load(f).get("rules", [])
    for r in rules:
        FieldKind(r["kind"])  # a ValueError for an unknown kind
        re.compile(r.get("regex", ""))
        if "regex" in r and "share" not in r:
            raise ValueError(f"{path}: a rule with a regex needs a share")
    return rules


def rules_or(given: list[dict] | None, variable: str, default: list[dict]) -> list[dict]:
    if given is not None:
        return given
    return rules_from(os.environ[variable]) if os.environ.get(variable) else default


def kind_of_name(name: str, rules: list[dict] | None = None) -> FieldKind | None:
    n = name.lower()
    for r in NAME_RULES if rules is None else rules:
        if n in r.get("exact", ()) or any(x in n for x in r.get("contains", ())) or any(n.startswith(x) for x in r.get("starts", ())) or any(n.endswith(x) for x in r.get("ends", ())):
            return FieldKind(r["kind"])
    return None


# The simpler rules for evaluation files, tried in this order.
HARNESS_RULES = [
    {"kind": "Categorical", "contains": ["handelsnaam", "rechtsvorm", "kvk"]},
    {"kind": "Address", "contains": ["straat", "adres", "street", "address", "city", "place", "woon"]},
    {"kind": "Name", "contains": ["naam", "name", "nomen", "alias"]},
    {"kind": "Date", "contains": ["datum", "date", "dob", "birth"]},
    {"kind": "Id", "contains": ["id", "nummer", "bsn", "number", "code"]},
]


def harness_kind(name: str) -> FieldKind:
    """The kind of an evaluation file's column."""
    return kind_of_name(name, HARNESS_RULES) or FieldKind.CATEGORICAL


def value_statistics(df: DataFrame, fields: list[str], rules: list[dict] | None = None) -> DataFrame:
    """field, n, unique_rate, avg_len (bytes) and the share of values that each rule's pattern matches, in one aggregation."""
    kinds = dict(df.dtypes)
    stack = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), to_text(F.col(f), kinds[f]).alias("value")) for f in fields)))
    d = df.select(stack).where("value <> ''")
    shares = [F.avg(F.col("value").rlike(r["regex"]).cast("double")).alias(f"share_{r['kind'].lower()}") for r in (VALUE_RULES if rules is None else rules) if "regex" in r]
    return d.groupBy("field").agg(F.count("*").alias("n"), (F.count_distinct("value") / F.count("*")).alias("unique_rate"), F.avg(F.octet_length("value")).alias("avg_len"), *shares)


def kind_of_values(stats: dict | None, rules: list[dict] | None = None) -> FieldKind:
    for r in (VALUE_RULES if rules is None else rules) if stats else ():
        if (
            ("regex" not in r or stats[f"share_{r['kind'].lower()}"] >= r["share"])
            and stats["unique_rate"] >= r.get("unique_min", 0)
            and stats["unique_rate"] <= r.get("unique_max", 1)
            and stats["avg_len"] <= r.get("length_max", float("inf"))
            and stats["avg_len"] >= r.get("length_min", 0)
        ):
            return FieldKind(r["kind"])
    return FieldKind.FREE_TEXT


def infer_schema(df: DataFrame, overrides: dict[str, FieldKind | str] | None = None, name_rules: list[dict] | None = None, sample: int = SAMPLE,
                 value_rules: list[dict] | None = None) -> Schema:
    """Overrides, then names, then up to `sample` values that aren't empty of each text field. Fields come by name.

    Rules not given come from the files that LINKWEAVE_NAME_RULES and LINKWEAVE_VALUE_RULES name, else from the tables above.
    """
    overrides = overrides or {}
    name_rules, value_rules = rules_or(name_rules, NAME_FILE, NAME_RULES), rules_or(value_rules, VALUE_FILE, VALUE_RULES)
    fields = sorted(c for c in df.columns if c not in ("record_id", "record_key", "source"))
    if not fields:
        raise EmptySchema("no fields to infer")
    kinds = {f: FieldKind(overrides[f]) if f in overrides else kind_of_name(f, name_rules) for f in fields}
    types = dict(df.dtypes)
    for f in (f for f in fields if kinds[f] is None):
        values = df.where(F.col(f).cast("string") != "").select(f).limit(sample) if types[f] == "string" else df.select(f).limit(0)
        rows = value_statistics(values, [f], value_rules).collect()
        kinds[f] = kind_of_values(rows[0].asDict() if rows else None, value_rules)
    return Schema(tuple(FieldDef(f, kinds[f]) for f in fields))


def _stacked(df: DataFrame, fields: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.nullif(to_text(F.col(f), kinds[f]), F.lit("")).alias("value")) for f in fields))))


def field_stats(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_rows, n_null, cardinality: empty texts count as null. Values combine by (field, value) before any distinct count."""
    by_value = _stacked(df, fields).groupBy("field", "value").agg(F.count("*").alias("n"))
    return by_value.groupBy("field").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.count("value").alias("cardinality"))


def top_values(df: DataFrame, fields: list[str], k: int = TOP) -> DataFrame:
    """field, value, n, rank: the k most frequent values, equals by value. Ranks run over distinct values with counts."""
    counts = _stacked(df, fields).where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def schema_hash(schema: Schema, mappings: list[FieldMapping] | None = None) -> str:
    """SHA-256 of the fields by name, and of the mappings if there are any."""
    text = "".join(f"{f.name}:{f.kind.value}|" for f in sorted(schema.fields, key=lambda f: f.name))
    if mappings:
        text += "mappings:" + "".join(f"{m.a_field}:{m.b_field}|" for m in sorted(mappings, key=lambda m: m.a_field))
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(schema: Schema, sample: DataFrame | None = None, mappings: list[FieldMapping] | None = None) -> dict:
    out = {"hash": schema_hash(schema, mappings), "n": 0, "fields": {f.name: {"kind": f.kind.value, "null_rate": 0.0, "cardinality": 0, "top": []} for f in schema.fields}}
    if sample is not None:
        there = [f for f in schema.names if f in sample.columns]
        for r in field_stats(sample, there).collect():
            out["fields"][r["field"]] |= {"null_rate": r["n_null"] / r["n_rows"], "cardinality": r["cardinality"]}
            out["n"] = r["n_rows"]
        for r in top_values(sample, there).orderBy("field", "rank").collect():
            out["fields"][r["field"]]["top"].append(r["value"])
    return json.loads(json.dumps(out))


def fingerprint_distance(a: dict, b: dict) -> float:
    """0 for equal schemas, else 0.7 of what their fields differ and 0.3 of what shared fields' statistics differ."""
    if a["hash"] == b["hash"]:
        return 0.0
    x, y = ({(n, f["kind"]) for n, f in p["fields"].items()} for p in (a, b))
    alike = len(x & y) / len(x | y) if x | y else 1.0
    both = sorted(a["fields"].keys() & b["fields"].keys())
    if not a["n"] or not b["n"]:
        stats = 1.0
    elif not both:
        stats = 0.0
    else:

        def one(f: dict, g: dict) -> float:
            most = max(f["cardinality"], g["cardinality"])
            card = 1 - abs(f["cardinality"] - g["cardinality"]) / most if most else 1.0
            return (1 - min(abs(f["null_rate"] - g["null_rate"]), 1) + card) / 2

        stats = sum(one(a["fields"][n], b["fields"][n]) for n in both) / len(both)
    return 0.7 * (1 - alike) + 0.3 * (1 - stats)
