"""Comparison: pairs join their records' fields, each field's similarity becomes a level of agreement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import to_text
from ..functions.similarity import DEFAULTS, Similarity
from ..model import CLOSE, EXACT, NONE, NULL, PARTIAL, FieldKind, FieldMapping, LinkMode, NullPolicy, Schema
from .blocking import ID, SOURCE, paired

# Similarity from which a field agrees exactly, closely, partially.
THRESHOLDS: dict[FieldKind, tuple[float, float, float]] = {
    FieldKind.NAME: (0.92, 0.75, 0.50),
    FieldKind.DATE: (0.99, 0.85, 0.60),
    FieldKind.TIMESTAMP: (0.99, 0.85, 0.60),
    FieldKind.PHONE: (0.98, 0.90, 0.70),
    FieldKind.ADDRESS: (0.90, 0.70, 0.40),
    FieldKind.ID: (0.99, 0.90, 0.75),
    FieldKind.LICENSE_PLATE: (0.99, 0.75, 0.50),
    FieldKind.NUMERIC: (0.95, 0.80, 0.50),
    FieldKind.GPS: (0.95, 0.80, 0.50),
    FieldKind.CATEGORICAL: (1.00, 0.95, 0.70),
    FieldKind.FREE_TEXT: (0.90, 0.65, 0.35),
    FieldKind.ALIAS: (0.90, 0.65, 0.35),
}


ABSENT = -1.0


def level(similarity: Column, thresholds: tuple[float, float, float]) -> Column:
    """Compared in single precision, as the thresholds are meant."""
    s = similarity.cast("float")
    at = [F.lit(t).cast("float") for t in thresholds]
    return F.when(s >= at[0], EXACT).when(s >= at[1], CLOSE).when(s >= at[2], PARTIAL).otherwise(NONE)


class FieldComparator:
    """Level expressions for pairs: lvl_0 … lvl_{n-1}, by schema field or by mapping."""

    def __init__(self, schema: Schema, mappings: list[FieldMapping] | None = None, missing_as_null: bool = False, source_a: str | None = None):
        self.schema, self.mappings, self.missing_as_null, self.source_a = schema, list(mappings or []), missing_as_null, source_a
        fields = [(m.a_field, m.b_field, m.null_policy) for m in self.mappings] or [(f, f, None) for f in schema.names]
        known = set(schema.names)
        kinds = [schema.kind(a) if a in known else FieldKind.CATEGORICAL for a, _, _ in fields]
        self.fields = [(a, b, k, p) for (a, b, p), k in zip(fields, kinds)]
        self.fns: list[list[Similarity]] = [list(DEFAULTS[k]) for k in kinds]
        self.thresholds = [THRESHOLDS[k] for k in kinds]

    def position(self, field: str) -> int:
        return [a for a, *_ in self.fields].index(field)

    def with_fns(self, field: str, *fns: Similarity) -> FieldComparator:
        self.fns[self.position(field)] = list(fns)
        return self

    def with_thresholds(self, field: str, exact: float, close: float, partial: float) -> FieldComparator:
        self.thresholds[self.position(field)] = (exact, close, partial)
        return self

    @property
    def level_columns(self) -> list[str]:
        return [f"lvl_{i}" for i in range(len(self.fields))]

    def prepared(self, i: int) -> dict[str, tuple[Similarity, Callable[[Column], Column]]]:
        """The functions of field i that work on a prepared value, with their preparation, by a name of their own."""
        return {f"__p{i}_{k}": (f, f.prepare) for k, f in enumerate(self.fns[i]) if hasattr(f, "prepare")}

    def similarity(self, i: int, a: Column, b: Column) -> Column:
        ready = {id(f): name for name, (f, _) in self.prepared(i).items()}
        each = [f.compare(F.col(f"__a{ready[id(f)]}"), F.col(f"__b{ready[id(f)]}")) if id(f) in ready else f(a, b) for f in self.fns[i]]
        return each[0] if len(each) == 1 else F.greatest(*each)

    def _alike(self, i: int) -> Column:
        """The similarity of field i, ABSENT where a side is missing."""
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        there = a.isNotNull() & b.isNotNull() & (a != "") & (b != "")
        return F.when(there, F.coalesce(self.similarity(i, a, b), F.lit(0.0))).otherwise(ABSENT).alias(f"__s{i}")

    def _level(self, i: int) -> Column:
        _, _, _, policy = self.fields[i]
        s = F.col(f"__s{i}")
        absent = NULL if (policy == NullPolicy.SKIP or (policy is None and self.missing_as_null)) else NONE
        return F.when(s == ABSENT, absent).otherwise(level(s, self.thresholds[i])).alias(f"lvl_{i}")

    def packed(self, records: DataFrame, keep: list[str] = ()) -> tuple[DataFrame, dict[str, Column | None]]:
        """record_id and r: the compared fields, what is prepared from them, and the columns of keep; and the prepared columns by name."""
        kinds = dict(records.dtypes)
        text = lambda f: to_text(F.col(f), kinds[f]) if f in kinds else F.lit(None).cast("string")
        side = F.col(SOURCE) if SOURCE in kinds else F.lit(None).cast("string")
        every = sorted({f for a, b, *_ in self.fields for f in (a, b)})
        packed = [side.alias("__source"), *(text(f).alias(f) for f in every), *(F.col(c).alias(f"__keep_{c}") for c in keep)]
        # what depends on one record is computed before records meet
        made = {}
        for i, (a, b, *_) in enumerate(self.fields):
            for name, (_, prepare) in self.prepared(i).items():
                made[f"__a{name}"], made[f"__b{name}"] = prepare(text(a)), prepare(text(b))
                if a == b:
                    made[f"__b{name}"] = None
        packed = F.struct(*packed, *(x.alias(n) for n, x in made.items() if x is not None))
        return records.select(F.col(ID), packed.alias("r")), made

    def compare(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        """pairs (a, b) with a level for each field. Records join twice by id; only the compared fields travel."""
        r, made = self.packed(records)
        d = pairs.join(r.select(F.col(ID).alias("a"), F.col("r").alias("x")), "a").join(r.select(F.col(ID).alias("b"), F.col("r").alias("y")), "b")
        return self.levels(d.select("a", "b", "x", "y"), made)

    def compare_blocked(self, index: DataFrame, records: DataFrame, cap: int = 300, mode: LinkMode | str = LinkMode.DEDUPLICATE, keep: list[str] = ()) -> DataFrame:
        """compare() of the index's candidate pairs, whose records' fields travel with the index, so no pair is ever shuffled.

        Columns of keep come along from both records, as <column>_a and <column>_b.
        """
        r, made = self.packed(records, keep)
        own = [F.col(f"{side}.__keep_{c}").alias(f"{c}_{end}") for c in keep for side, end in (("x", "a"), ("y", "b"))]
        return self.levels(paired(index, r, cap, mode).select("*", *own), made)

    def levels(self, d: DataFrame, made: dict[str, Column | None]) -> DataFrame:
        """Levels of pairs with the packed fields of both records (x, y); other columns are kept."""
        own = [c for c in d.columns if c not in ("x", "y")]
        if self.mappings and self.source_a is not None:  # the mapped source comes first, whatever the ids' order
            turn = F.col("y.__source").eqNullSafe(self.source_a) & ~F.col("x.__source").eqNullSafe(self.source_a)
            d = d.withColumns({"x": F.when(turn, F.col("y")).otherwise(F.col("x")), "y": F.when(turn, F.col("x")).otherwise(F.col("y"))})
        sides = [F.col(f"x.{a}").alias(f"__a{i}") for i, (a, *_) in enumerate(self.fields)] + [F.col(f"y.{b}").alias(f"__b{i}") for i, (_, b, *_) in enumerate(self.fields)]
        for n, x in made.items():
            # equal fields of both sides share one preparation
            sides.append(F.col(f"{'x' if n.startswith('__a') else 'y'}.{n if x is not None else n.replace('__b', '__a', 1)}").alias(n))
        d = d.select(*own, *sides)
        # similarities first, as columns of their own: a level asks for them several times
        every = range(len(self.fields))
        return d.select(*own, *map(self._alike, every)).select(*own, *map(self._level, every))
