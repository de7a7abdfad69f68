"""Blocking: records explode into keys, and the key index self-joins into candidate pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FieldKind, LinkMode, Schema
from ..storage import stored
from . import keys as K

ID, SOURCE = "record_id", "source"
#: Rows of a bucket in one chunk; larger buckets meet chunk by chunk, so that no task holds more than a chunk of one.
CHUNK = 2048
#: Combinations of rows that one partition goes through, rows in one partition, and partitions of one join.
LOOKS, ROWS, PARTITIONS = 2_000_000, 200_000, 20_000


class CompositeBlocker:
    """The union of several keys' values, each once for a record."""

    def __init__(self, *keys: K.BlockingKey):
        self.keys, self.remaps = list(keys), {}

    def add(self, key: K.BlockingKey) -> CompositeBlocker:
        self.keys.append(key)
        return self

    def with_source_remap(self, source: str, **fields: str) -> CompositeBlocker:
        """Records of that source use another field: with_source_remap("B", name="surname")."""
        self.remaps[source] = fields
        return self

    def remapped(self, df: DataFrame) -> DataFrame:
        """df with the fields that keys read, taken from where each source has them."""
        wanted: dict[str, Column] = {}
        for source, fields in self.remaps.items():
            for to, of in fields.items():
                before = wanted.get(to, F.col(to) if to in df.columns else F.lit(None).cast("string"))
                wanted[to] = F.when(F.col(SOURCE) == source, F.col(of)).otherwise(before)
        return df.withColumns(wanted) if wanted else df

    def key_column(self) -> Column:
        if not self.keys:
            return F.array().cast(K.NO_KEYS)
        return F.array_distinct(F.flatten(F.array(*(k.extract() for k in self.keys))))

    def index(self, records: DataFrame) -> DataFrame:
        """block_key, record_id, source: the inverted index."""
        d = self.remapped(records)
        codes: dict[str, Column] = {}
        for k in self.keys:
            codes |= k.codes()
        if codes:  # each code once, however many keys use it; batched evaluation stays below the explode
            d = d.withColumns(codes)
        source = F.col(SOURCE) if SOURCE in d.columns else F.lit(None).cast("string")
        return d.select(F.col(ID), source.alias(SOURCE), F.explode(self.key_column()).alias("block_key")).select("block_key", ID, SOURCE)


def from_schema(schema: Schema) -> CompositeBlocker:
    """Keys by the schema's kinds."""
    last = lambda xs: xs[-1] if xs else None
    first = lambda xs: xs[0] if xs else None
    names, dates = schema.of_kind(FieldKind.NAME), schema.of_kind(FieldKind.DATE)
    b, date = CompositeBlocker(), first(dates)
    if names and date:
        b.add(K.PhoneticNameDobInitial(last(names), first(names), date) if len(names) > 1 else K.PhoneticNameDob(last(names), date))
        b.add(K.DateFragment(date, 7))
    if names and (address := first(schema.of_kind(FieldKind.ADDRESS))):
        b.add(K.AddressInitial(address, first(names)))
    if phone := first(schema.of_kind(FieldKind.PHONE)):
        b.add(K.Suffix(phone, 7))
    for f in schema.of_kind(FieldKind.ID):
        b.add(K.Suffix(f, 4))
    if not names and date:
        b.add(K.DateFragment(date, 7))
    for f in schema.of_kind(FieldKind.CATEGORICAL):
        b.add(K.ExactField(f))
    return b


def from_category(category: str, schema: Schema) -> CompositeBlocker:
    """Presets by name: PersonRegistry, WantedPersons, ANPRPassages, CallDetailRecords, SIMSubscribers, FinancialIntelligence."""
    of = schema.of_kind
    b = CompositeBlocker()
    if category == "PersonRegistry":
        return from_schema(schema)
    if category == "WantedPersons":
        names, dates = of(FieldKind.NAME), of(FieldKind.DATE)
        if names and dates:
            b.add(K.PhoneticNameDob(names[-1], dates[0])).add(K.TransliteratedPhonetic(names[-1], dates[0])).add(K.FuzzyYear(names[-1], dates[0], 1))
        for f in of(FieldKind.ALIAS) if dates else []:
            b.add(K.AliasPhonetic(f, dates[0]))
        for f in of(FieldKind.ID):
            b.add(K.DocumentSuffix(f, 6))
        return b
    if category == "ANPRPassages":
        for f in of(FieldKind.LICENSE_PLATE):
            b.add(K.PlateNorm(f)).add(K.PlateOcrFuzzy(f))
        if of(FieldKind.CATEGORICAL) and of(FieldKind.TIMESTAMP):
            b.add(K.CameraTimeWindow(of(FieldKind.CATEGORICAL)[0], of(FieldKind.TIMESTAMP)[0], 10))
        if len(of(FieldKind.GPS)) > 1:
            b.add(K.GeoGrid(*of(FieldKind.GPS)[:2], 0.01))
        return b
    if category in ("CallDetailRecords", "SIMSubscribers"):
        for f in of(FieldKind.PHONE):
            b.add(K.Suffix(f, 7))
        for f in of(FieldKind.ID):
            b.add(K.Suffix(f, 6))
        for f in of(FieldKind.CATEGORICAL):
            b.add(K.ExactField(f))
        return b
    if category == "FinancialIntelligence":
        for f in of(FieldKind.ID):
            b.add(K.Suffix(f, 6))
        for f in of(FieldKind.DATE)[:1]:
            b.add(K.DateFragment(f, 7))
        for f in of(FieldKind.CATEGORICAL):
            b.add(K.ExactField(f))
        return b
    raise ValueError(f"unknown category {category!r}")


class CustomCategory:
    """A preset of one's own, built step by step; steps whose kinds a schema lacks are skipped."""

    def __init__(self):
        self.steps: list[Callable[[Schema], list[K.BlockingKey]]] = []

    def _each(self, kind: FieldKind, make) -> CustomCategory:
        self.steps.append(lambda s: [make(f) for f in s.of_kind(kind)])
        return self

    def phone_suffix(self, n: int):
        return self._each(FieldKind.PHONE, lambda f: K.Suffix(f, n))

    def id_suffix(self, n: int):
        return self._each(FieldKind.ID, lambda f: K.Suffix(f, n))

    def document_suffix(self, n: int):
        return self._each(FieldKind.ID, lambda f: K.DocumentSuffix(f, n))

    def exact_categorical(self):
        return self._each(FieldKind.CATEGORICAL, K.ExactField)

    def date_fragment(self, size: int = 7):
        return self._each(FieldKind.DATE, lambda f: K.DateFragment(f, size))

    def phonetic_name_dob(self):
        self.steps.append(lambda s: [K.PhoneticNameDob(s.of_kind(FieldKind.NAME)[-1], s.of_kind(FieldKind.DATE)[0])] if s.of_kind(FieldKind.NAME) and s.of_kind(FieldKind.DATE) else [])
        return self

    def phonetic_name_dob_initial(self):
        self.steps.append(lambda s: [K.PhoneticNameDobInitial(s.of_kind(FieldKind.NAME)[-1], s.of_kind(FieldKind.NAME)[0], s.of_kind(FieldKind.DATE)[0])] if len(s.of_kind(FieldKind.NAME)) > 1 and s.of_kind(FieldKind.DATE) else [])
        return self

    def address_initial(self):
        self.steps.append(lambda s: [K.AddressInitial(s.of_kind(FieldKind.ADDRESS)[0], s.of_kind(FieldKind.NAME)[0])] if s.of_kind(FieldKind.ADDRESS) and s.of_kind(FieldKind.NAME) else [])
        return self

    def with_key(self, key: K.BlockingKey):
        self.steps.append(lambda s: [key])
        return self

    def build(self, schema: Schema) -> CompositeBlocker:
        return CompositeBlocker(*(k for step in self.steps for k in step(schema)))


# --- the index and its joins


def bucket_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("block_key").agg(F.count("*").alias("n"))


def oversized(index: DataFrame, cap: int) -> DataFrame:
    return bucket_sizes(index).where(F.col("n") > cap)


def histogram(index: DataFrame) -> DataFrame:
    """How many buckets have each size."""
    return bucket_sizes(index).groupBy("n").agg(F.count("*").alias("buckets"))


def capped(index: DataFrame, cap: int) -> DataFrame:
    """The index without buckets larger than cap or of one row, with each bucket's size n; 0 keeps all. Bucket sizes combine before the shuffle."""
    n = F.col("n")
    return index.join(bucket_sizes(index).where(n.between(2, cap) if cap else n >= 2), "block_key")


def meet(x: DataFrame, y: DataFrame, looks: int, rows: int, most: int, on: Column) -> DataFrame:
    """x and y (block_key, nx, ny: the bucket's rows of either side) joined by bucket under aliases x and y and the condition on.

    Partitions go by the combinations of rows, not by bytes: a small index makes many pairs. Where a bucket has over CHUNK rows (most) of a
    side, each chunk of x meets each chunk of y in a cell of its own, so hot buckets are dealt out as well.
    """
    parts = min(max(1, -(-looks // LOOKS), -(-rows // ROWS)), PARTITIONS)
    by = ["block_key"]
    if most > CHUNK:
        by += ["cx", "cy"]
        chunks = {c: F.ceil(F.col(n) / CHUNK).cast("int") for c, n in (("cx", "nx"), ("cy", "ny"))}
        dealt = lambda d, own, other: d.withColumn(own, F.pmod(F.xxhash64(ID), chunks[own]).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), chunks[other] - 1)))
        x, y = dealt(x, "cx", "cy"), dealt(y, "cy", "cx")
    x, y = x.repartition(parts, *by).alias("x").hint("merge"), y.repartition(parts, *by).alias("y").hint("merge")
    for c in by:
        on = (F.col(f"x.{c}") == F.col(f"y.{c}")) & on
    return x.join(y, on)


def paired(index: DataFrame, rows: DataFrame | None = None, cap: int = 300, mode: LinkMode | str = LinkMode.DEDUPLICATE) -> DataFrame:
    """a, b (a < b, record ids): each pair that shares a bucket, once; with x and y, what rows (record_id, r) has of either, where rows is given.

    Equal sources are left out by the join itself in link_only. Only the index is shuffled, never the pairs: each row knows its record's
    earlier buckets, and a pair comes from the first bucket that its records share.
    """
    linking = LinkMode.parse(mode) == LinkMode.LINK_ONLY
    i = stored(capped(index, cap).select("block_key", ID, SOURCE, "n"), "index")
    size = i.agg(F.sum("n").alias("looks"), F.count("*").alias("rows"), F.max("n").alias("most")).first()
    keys = ["block_key", SOURCE] if linking else ["block_key"]
    i = i.groupBy(ID).agg(F.sort_array(F.collect_set(F.struct(*keys, "n"))).alias("all"))
    if rows is not None:
        i = i.join(rows, ID)
    i = i.select(ID, "all", F.posexplode("all").alias("at", "e"), *(["r"] if rows is not None else []))
    before = F.when(F.col("at") > 0, F.slice("all", F.lit(1), F.col("at")))
    kept = ["at", ID, *(["all"] if linking else []), *(["r"] if rows is not None else [])]
    i = i.select("e.*", F.col("e.n").alias("nx"), F.col("e.n").alias("ny"), (before if linking else before["block_key"]).alias("before"), *kept).drop("n")
    on = F.col(f"x.{ID}") < F.col(f"y.{ID}")
    if linking:
        apart = lambda e, f: (e["block_key"] == f["block_key"]) & ~e[SOURCE].eqNullSafe(f[SOURCE])
        own = F.struct(F.col("x.block_key").alias("block_key"), F.col(f"x.{SOURCE}").alias(SOURCE))
        on = on & ~F.col(f"x.{SOURCE}").eqNullSafe(F.col(f"y.{SOURCE}"))
        on = on & ((F.col("x.at") == 0) | ~F.exists("x.before", lambda e: F.exists("y.all", lambda f: apart(e, f))))
        on = on & ((F.col("y.at") == 0) | ~F.exists("y.before", lambda f: apart(own, f)))
    else:
        on = on & ((F.col("x.at") == 0) | (F.col("y.at") == 0) | ~F.arrays_overlap("x.before", "y.before"))
    d = meet(i, i, size["looks"] or 0, size["rows"], size["most"] or 0, on)
    both = [F.col("x.r").alias("x"), F.col("y.r").alias("y")] if rows is not None else []
    return d.select(F.col(f"x.{ID}").alias("a"), F.col(f"y.{ID}").alias("b"), *both)


def candidate_pairs(index: DataFrame, cap: int = 300, mode: LinkMode | str = LinkMode.DEDUPLICATE) -> DataFrame:
    """a, b (a < b, record ids): each pair that shares a bucket, once."""
    return paired(index, None, cap, mode)


def source_counts(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """n_cross, n_within: pairs of different and of equal (or both missing) sources."""
    r = records.select(F.col(ID), F.col(SOURCE))
    d = pairs.join(r.select(F.col(ID).alias("a"), F.col(SOURCE).alias("sa")), "a").join(r.select(F.col(ID).alias("b"), F.col(SOURCE).alias("sb")), "b")
    same = F.col("sa").eqNullSafe(F.col("sb"))
    return d.agg(F.count_if(~same).alias("n_cross"), F.count_if(same).alias("n_within"))


def blocked_source_counts(index: DataFrame, records: DataFrame) -> DataFrame:
    """source_counts of the index's candidate pairs; sources travel with the index."""
    d = paired(index, records.select(ID, F.struct(SOURCE).alias("r")))
    same = F.col(f"x.{SOURCE}").eqNullSafe(F.col(f"y.{SOURCE}"))
    return d.agg(F.count_if(~same).alias("n_cross"), F.count_if(same).alias("n_within"))


def lookup(index: DataFrame, probes: DataFrame, cap: int = 0) -> DataFrame:
    """probe_id, record_id: indexed records that share a bucket with a probe (probe_id, block_key), itself excepted."""
    i = index if not cap else index.join(oversized(index, cap).select("block_key"), "block_key", "left_anti")
    return probes.join(i, "block_key").where(F.col("probe_id") != F.col(ID)).select("probe_id", ID).distinct()


def insert(index: DataFrame, more: DataFrame) -> DataFrame:
    return index.unionByName(more)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the records of ids (record_id)."""
    return index.join(ids.select(ID), ID, "left_anti").select("block_key", ID, SOURCE)
