"""Similarities of two values, from 0 to 1, as Column functions of two strings.

All but Jaro-Winkler and phonetic equality are built-in expressions. Those two run in Arrow batches: Jaro-Winkler over all pairs of a
batch at once, phonetic equality over its distinct pairs. prepared() marks functions that work on something derived from each value alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import FieldKind
from . import normalize as N
from .phonetic import double_metaphone

Similarity = Callable[[Column, Column], Column]


def jaro_winkler_of(a: str, b: str) -> float:
    """The public definition: window of half the longer length less one, prefix of up to 4, boost above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    n = len(left)
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (n / len(a) + n / len(b) + (n - swaps) / n) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


#: Pairs are compared together by the length of the longer text, up to these (as many bits as a number has); longer ones one by one.
WIDTHS = {8: np.uint8, 16: np.uint16, 32: np.uint32, 64: np.uint64}
BELOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def _jaro_winkler_wide(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """jaro_winkler_of for rows of code points, zero beyond the texts' lengths (1 at least).

    All rows take each step at once; the places of b that are used, in reach or equal to a character of a are the bits of one number.
    """
    n, width = a.shape
    kind = WIDTHS[width]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used = np.zeros(n, kind)
    used_a = np.zeros((n, width), bool)
    for i in range(int(la.max(initial=0))):
        equal = np.packbits(b == a[:, i : i + 1], axis=1, bitorder="little").view(kind)[:, 0]
        window = BELOW[np.minimum(lb, i + reach + 1)] & ~BELOW[np.minimum(np.maximum(0, i - reach), 64)]
        open_ = equal & window.astype(kind) & ~used & (np.iinfo(kind).max * (i < la).astype(kind))
        first = open_ & (~open_ + kind(1))
        used |= first
        used_a[:, i] = first != 0
    used_b = np.unpackbits(used.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").astype(bool)
    m = used_a.sum(1)
    # row by row, the matched characters of both sides in order
    differ = a[used_a] != b[used_b]
    swaps = np.bincount(np.repeat(np.arange(n), m)[differ], minlength=n) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / some) / 3, 0.0)
    same = (a[:, :4] == b[:, :4]) & (np.arange(4) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def jaro_winkler_many(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """jaro_winkler_of for many pairs; nan where a side is missing."""
    out = np.full(len(a), np.nan)
    la = np.fromiter((-1 if x is None else len(x) for x in a), np.int64, len(a))
    lb = np.fromiter((-1 if x is None else len(x) for x in b), np.int64, len(b))
    there, longest = (la >= 0) & (lb >= 0), np.maximum(la, lb)
    out[there] = 0.0
    out[there & (longest == 0)] = 1.0
    low = 0
    for width in WIDTHS:
        rows = np.flatnonzero(there & (la > 0) & (lb > 0) & (longest > low) & (longest <= width))
        low = width
        if len(rows):
            points = [np.array([side[k] for k in rows], f"U{width}").view(np.uint32).reshape(len(rows), width) for side in (a, b)]
            out[rows] = np.where((points[0] == points[1]).all(1) & (la[rows] == lb[rows]), 1.0, _jaro_winkler_wide(*points, la[rows], lb[rows]))
    for k in np.flatnonzero(there & (longest > low)):
        out[k] = jaro_winkler_of(a[k], b[k])
    return out


def by_distinct(f: Callable[[str, str], float]):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a.tolist(), b.tolist()):
            if (x := known.get(pair)) is None:
                x = known[pair] = None if pair[0] is None or pair[1] is None else f(*pair)
            out.append(x)
        return pd.Series(out, dtype="float64")

    return run


def _jaro_winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    """Each pair of values that differs in the batch once."""
    x, y = a.dictionary_encode(), b.dictionary_encode()
    i, j = (pc.fill_null(d.indices, len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) for d in (x, y))
    xs, ys = x.dictionary.to_pylist() + [None], y.dictionary.to_pylist() + [None]
    pairs, where = np.unique(i * len(ys) + j, return_inverse=True)
    return pa.array(jaro_winkler_many([xs[p] for p in pairs // len(ys)], [ys[p] for p in pairs % len(ys)])[where], from_pandas=True)


def jaro_winkler(a: Column, b: Column) -> Column:
    return F.arrow_udf(_jaro_winkler, "double")(a, b)


def _same_code(a: str, b: str) -> float:
    x, y = double_metaphone(a), double_metaphone(b)
    return 1.0 if x and x == y else 0.0


def phonetic_equal(a: Column, b: Column) -> Column:
    return F.pandas_udf(by_distinct(_same_code), "double")(N.to_ascii_upper(a), N.to_ascii_upper(b))


def prepared(prepare: Callable[[Column], Column], compare: Similarity) -> Similarity:
    """compare(prepare(a), prepare(b)); a comparator that sees the two functions prepares each record before it meets others."""

    def f(a: Column, b: Column) -> Column:
        return F.transform(F.array(F.struct(prepare(a).alias("a"), prepare(b).alias("b"))), lambda p: compare(p["a"], p["b"]))[0]

    f.prepare, f.compare = prepare, compare
    return f


def tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, r"(?U)\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; two empty ones are alike."""
    all_ = F.size(a) + F.size(b)
    share = lambda both: F.when(all_ == both, 1.0).otherwise(both / (all_ - both))
    return F.transform(F.array(F.size(F.array_intersect(a, b))), share)[0]  # bound, so that it is computed once


token_overlap = prepared(tokens, jaccard)


def levenshtein(most: int) -> Similarity:
    def f(a: Column, b: Column) -> Column:
        d = F.levenshtein(a, b)
        return F.when(d <= most, 1 - d / max(most, 1)).otherwise(0.0)

    return f


def alias_overlap(a: Column, b: Column) -> Column:
    """Best token overlap of any alias of a with any of b; aliases stand between bars."""
    split = lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    each = F.flatten(F.transform(split(a), lambda x: F.transform(split(b), lambda y: token_overlap(x, y))))
    return F.coalesce(F.array_max(each), F.lit(0.0))


address_overlap = prepared(lambda x: F.array_distinct(N.address_tokens(x)), jaccard)


def street_number(a: Column, b: Column) -> Column:
    d = F.levenshtein(N.leading_number(a), N.leading_number(b))
    return F.when(d == 0, 1.0).when(d == 1, 0.8).otherwise(0.0)


def date_parts(x: Column) -> Column:
    """struct(y, m, d) of an ISO date or of seconds since 1970 (counting years of 365 days); null for other texts."""
    t = F.split(F.trim(x), "T")[0]
    part = lambda i: F.regexp_extract(t, r"^\+?([0-9]{1,9})-\+?([0-9]{1,9})-\+?([0-9]{1,9})(?:-.*)?$", i).try_cast("int")
    y, m, d = part(1), part(2), part(3)
    seconds = F.when(F.trim(x).rlike(r"^[+-]?[0-9]{1,18}$"), F.trim(x).try_cast("long"))
    days = F.when(seconds >= 0, F.floor(seconds / 86400)).otherwise(F.ceil(seconds / 86400))
    years = F.when(days >= 0, F.floor(days / 365)).otherwise(F.ceil(days / 365))
    # Unix seconds have no dashes, so at most one reading applies
    return F.when(m.between(1, 12) & d.between(1, 31) & y.isNotNull(), F.struct(y.alias("y"), m.alias("m"), d.alias("d"))).when(
        seconds.isNotNull(), F.struct((years + 1970).cast("int").alias("y"), F.lit(1).alias("m"), F.lit(1).alias("d"))
    )


def day_number(p: Column) -> Column:
    """Julian day number, also of days that the calendar lacks (such as 31 February)."""
    whole = lambda x: F.floor(x)
    a = whole((14 - p["m"]) / 12)
    y, m = p["y"] + 4800 - a, p["m"] + 12 * a - 3
    return p["d"] + whole((153 * m + 2) / 5) + 365 * y + whole(y / 4) - whole(y / 100) + whole(y / 400) - 32045


def date_prepared(x: Column) -> Column:
    """struct(text, y, m, day): what comparing a date takes, so that each text is parsed once however many pairs it is in."""
    # bound by transform, so that the parts are computed once
    parts = F.transform(F.array(date_parts(x)), lambda p: F.struct(p["y"].alias("y"), p["m"].alias("m"), day_number(p).alias("day")))[0]
    return F.transform(F.array(parts), lambda p: F.struct(x.alias("text"), p["y"].alias("y"), p["m"].alias("m"), p["day"].alias("day")))[0]


def date_compared(x: Column, y: Column) -> Column:
    days = F.abs(x["day"] - y["day"])
    return (
        F.when(x["text"] == y["text"], 1.0).when(x["day"].isNull() | y["day"].isNull(), 0.0).when(days == 0, 1.0).when(days <= 1, 0.9)
        .when((x["y"] == y["y"]) & (x["m"] == y["m"]), 0.75).when(x["y"] == y["y"], 0.5).when(F.abs(x["y"] - y["y"]) <= 1, 0.3).otherwise(0.0)
    )


date_likeness = prepared(date_prepared, date_compared)


def exact(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def hamming(most: int) -> Similarity:
    """Texts of equal length in bytes that differ in at most so many places."""

    def f(a: Column, b: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(a))
        differ = F.size(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
        same = (F.octet_length(a) == F.octet_length(b)) & (F.length(a) == F.length(b))
        return F.when(a == b, 1.0).when(same & (F.length(a) > 0) & (differ <= most), 0.8).otherwise(0.0)

    return f


def suffix(n: int) -> Similarity:
    return lambda a, b: F.when((F.length(a) >= n) & (F.length(b) >= n) & (F.right(a, F.lit(n)) == F.right(b, F.lit(n))), 1.0).otherwise(0.0)


def number(x: Column) -> Column:
    """A number as plain decimal text has it; blanks around it are allowed, type suffixes aren't."""
    t = F.trim(x)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def numeric_bucketed(a: Column, b: Column) -> Column:
    x, y = number(a), number(b)
    r = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    return F.when(r.isNull(), 0.0).when(r == 0, 1.0).when(r <= 0.05, 0.85).when(r <= 0.20, 0.6).when(r <= 0.50, 0.3).otherwise(0.0)


def both_present(a: Column, b: Column) -> Column:
    return (a.isNotNull() & b.isNotNull()).cast("double")


#: The functions of a kind; a field's similarity is the largest of them.
DEFAULTS: dict[FieldKind, list[Similarity]] = {
    FieldKind.NAME: [jaro_winkler, token_overlap],
    FieldKind.DATE: [date_likeness],
    FieldKind.TIMESTAMP: [date_likeness],
    FieldKind.ADDRESS: [address_overlap],
    FieldKind.ID: [exact, hamming(1)],
    FieldKind.PHONE: [exact, hamming(1)],
    FieldKind.LICENSE_PLATE: [exact, hamming(1)],
    FieldKind.NUMERIC: [numeric_bucketed],
    FieldKind.GPS: [numeric_bucketed],
    FieldKind.CATEGORICAL: [exact],
    FieldKind.FREE_TEXT: [token_overlap],
    FieldKind.ALIAS: [alias_overlap],
}
