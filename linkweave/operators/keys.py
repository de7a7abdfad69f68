"""Blocking keys: each gives an ARRAY<STRING> column of "namespace:value". A missing field gives no key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.phonetic import metaphone, metaphones, soundex

NO_KEYS = "array<string>"


def one(value: Column, given: Column | None = None) -> Column:
    """One value, or none where it is null, empty or not given."""
    ok = value.isNotNull() & (value != "")
    return F.when(ok if given is None else ok & given, F.array(value)).otherwise(F.array().cast(NO_KEYS))


def year(dob: Column) -> Column:
    y = F.substring(dob, 1, 4)
    return F.when(y.rlike("^[0-9]{4}$"), y)


def code_column(name: str, algorithm: str = "double_metaphone", latin: bool = False) -> dict[str, Column]:
    """The column that holds a field's phonetic surname code (null if there is none), and its expression.

    Codes run in Python, which can't stand inside higher-order functions, so they are columns of their own.
    """
    token = N.surname_token(N.transliterate(F.col(name)) if latin else N.normalize_text(F.col(name)))
    code = soundex(token) if algorithm == "soundex" else metaphone(token)
    return {f"__{algorithm}_{'latin_' if latin else ''}{name}": F.nullif(code, F.lit(""))}


def code_of(name: str, algorithm: str = "double_metaphone", latin: bool = False) -> Column:
    return F.col(next(iter(code_column(name, algorithm, latin))))


class BlockingKey:
    """Base of all keys; subclasses give a namespace and the values of a record."""

    namespace = ""

    def codes(self) -> dict[str, Column]:
        """Columns that must be there before values() is used."""
        return {}

    def values(self) -> Column:
        raise NotImplementedError

    def extract(self) -> Column:
        return F.transform(F.coalesce(self.values(), F.array().cast(NO_KEYS)), lambda v: F.concat(F.lit(self.namespace + ":"), v))


@dataclass
class PhoneticNameDob(BlockingKey):
    name: str
    dob: str
    algorithm: str = "double_metaphone"
    namespace = "phonetic_dob"

    def codes(self):
        return code_column(self.name, self.algorithm)

    def values(self):
        return one(F.concat(code_of(self.name, self.algorithm), F.lit(":"), year(F.col(self.dob))))


@dataclass
class PhoneticNameDobInitial(BlockingKey):
    name: str
    first: str
    dob: str
    algorithm: str = "double_metaphone"
    namespace = "phonetic_initial_dob"

    def codes(self):
        return code_column(self.name, self.algorithm)

    def values(self):
        initial = F.upper(F.substring(F.trim(F.col(self.first)), 1, 1))
        return one(F.concat(code_of(self.name, self.algorithm), F.lit(":"), F.nullif(initial, F.lit("")), F.lit(":"), year(F.col(self.dob))))


@dataclass
class TransliteratedPhonetic(BlockingKey):
    name: str
    dob: str
    namespace = "transliterated_phonetic"

    def codes(self):
        return code_column(self.name, latin=True)

    def values(self):
        return one(F.concat(code_of(self.name, latin=True), F.lit(":"), year(F.col(self.dob))))


@dataclass
class AliasPhonetic(BlockingKey):
    """One key for each of the aliases that stand between bars; shares the namespace of names."""

    alias: str
    dob: str
    namespace = "phonetic_dob"

    def codes(self):
        tokens = F.transform(F.split(F.col(self.alias), r"\|"), lambda x: N.surname_token(N.normalize_text(x)))
        return {f"__aliases_{self.alias}": metaphones(tokens)}

    def values(self):
        y = year(F.col(self.dob))
        found = F.filter(F.col(f"__aliases_{self.alias}"), lambda c: c != "")
        return F.when(y.isNotNull(), F.array_sort(F.array_distinct(F.transform(found, lambda c: F.concat(c, F.lit(":"), y)))))


@dataclass
class FuzzyYear(BlockingKey):
    """For dates on 1 January, which are often estimates: the years around, too."""

    name: str
    dob: str
    reach: int = 1
    namespace = "phonetic_dob"

    def codes(self):
        return code_column(self.name)

    def values(self):
        dob = F.col(self.dob)
        y = F.when(F.substring(dob, 5, 6) == "-01-01", year(dob).try_cast("int"))
        code = code_of(self.name)
        return F.when(y.isNotNull() & code.isNotNull(), F.transform(F.sequence(y - self.reach, y + self.reach), lambda x: F.concat(code, F.lit(":"), x.cast("string"))))


@dataclass
class DateFragment(BlockingKey):
    field: str
    size: int = 7  # 4: year, 7: year and month, 10: day
    namespace = "date_fragment"

    def values(self):
        x = F.trim(F.col(self.field))
        return one(F.substring(x, 1, self.size), (F.length(x) >= self.size) & x.rlike("^[0-9]"))


@dataclass
class Suffix(BlockingKey):
    field: str
    n: int
    namespace = "suffix"

    def cleaned(self) -> Column:
        return N.normalize_digits(F.col(self.field))

    def values(self):
        return one(F.right(self.cleaned(), F.lit(self.n)), F.length(self.cleaned()) >= self.n)


@dataclass
class DocumentSuffix(Suffix):
    namespace = "document_suffix"

    def cleaned(self):
        return N.normalize_plate(F.col(self.field))


@dataclass
class DocumentDigitSuffix(Suffix):
    namespace = "document_digit_suffix"


@dataclass
class ExactField(BlockingKey):
    field: str
    namespace = "exact"

    def values(self):
        return one(N.normalize_text(F.col(self.field)))


@dataclass
class AddressInitial(BlockingKey):
    address: str
    first: str
    namespace = "addr_initial"

    def values(self):
        token = F.substring_index(N.normalize_text(F.col(self.address)), " ", 1)
        initial = F.substring(N.normalize_text(F.col(self.first)), 1, 1)
        return one(F.concat(token, F.lit(":"), initial), (token != "") & initial.rlike("^[A-Z]$"))


@dataclass
class PlateNorm(BlockingKey):
    field: str
    namespace = "plate_norm"

    def values(self):
        return one(N.normalize_plate(F.col(self.field)))


@dataclass
class PlateOcrFuzzy(BlockingKey):
    """The plate and all texts with one of its characters left out: plates that differ in one place share a key."""

    field: str
    namespace = "plate_ocr"

    def values(self):
        p = N.normalize_plate(F.col(self.field))
        without = F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.concat(F.substring(p, F.lit(1), i - 1), F.substring(p, i + 1, F.length(p))))
        every = F.filter(F.array_append(without, p), lambda v: v != "")
        return F.when(F.length(p) > 0, F.array_sort(F.array_distinct(every)))


@dataclass
class CameraTimeWindow(BlockingKey):
    camera: str
    time: str
    minutes: int = 10
    namespace = "cam_time_window"

    def values(self):
        ts = F.col(self.time)
        at = F.regexp_extract(ts, r"T([0-9]+):([0-9]+)", 1).try_cast("int"), F.regexp_extract(ts, r"T([0-9]+):([0-9]+)", 2).try_cast("int")
        slot = F.floor((at[0] * 60 + at[1]) / self.minutes)
        return one(F.concat(F.col(self.camera), F.lit(":"), F.substring(ts, 1, 10), F.lit(":"), slot.cast("string")))


@dataclass
class GeoGrid(BlockingKey):
    lat: str
    lon: str
    cell: float = 0.01
    namespace = "geo_grid"

    def values(self):
        cell = lambda c: F.floor(F.col(c).try_cast("double") / F.lit(float(self.cell))).cast("string")
        return one(F.concat(cell(self.lat), F.lit(":"), cell(self.lon)))


class CustomKey(BlockingKey):
    """A user's key: a column of strings or of arrays of strings, or a function that gives it."""

    def __init__(self, namespace: str, column: Column | Callable[[], Column], many: bool = False):
        self.namespace, self.column, self.many = namespace, column, many

    def values(self):
        column = self.column() if callable(self.column) else self.column
        return column if self.many else one(column)
