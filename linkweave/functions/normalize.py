"""Text normalisation as Column functions; null stays null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of Dutch surnames, tried in this order.
PREFIXES = [
    "VAN DER ", "VAN DEN ", "VAN DE ", "VAN HET ", "VAN 'T ", "VAN T ", "VAN ", "DEN ", "DER ", "DE ", "TEN ", "TER ", "TE ",
    "IN 'T ", "IN T ", "OP DEN ", "OP DE ", "OP HET ", "OP ", "V/D ", "V.D. ",
]

# Address abbreviations and what they stand for. Points are gone before the table is used.
ABBREVIATIONS = {
    "str": "straat", "ln": "laan", "ave": "avenue", "st": "street", "blvd": "boulevard", "dr": "dreef", "sg": "singel",
}

# Latin spelling of Cyrillic and Greek small letters.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ї": "i", "є": "e", "ґ": "g",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
    "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ı": "i", "þ": "th", "ð": "d",
}


def decompose(x: Column) -> Column:
    """Compatibility decomposition (NFKD); plain ASCII is passed on as it is."""
    icu = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(x, F.lit("")), F.lit(True))
    return F.when(x.isNull() | (F.octet_length(x) == F.length(x)), x).otherwise(icu)


def to_ascii_upper(x: Column) -> Column:
    return F.upper(F.regexp_replace(decompose(x), r"[^\x00-\x7F]", ""))


def normalize_text(x: Column) -> Column:
    """Decomposed, ASCII only, upper case, single blanks."""
    return F.trim(F.regexp_replace(to_ascii_upper(x), r"\s+", " "))


def normalize_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normalize_plate(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))


def strip_prefix(x: Column) -> Column:
    """x without the first listed prefix that it starts with, in any case."""
    return F.regexp_replace(x, "(?i)^(" + "|".join(p.replace(".", r"\.") for p in PREFIXES) + ")", "")


def surname_token(x: Column) -> Column:
    """The last word without prefix; empty for an empty name."""
    stripped = strip_prefix(x)
    return F.regexp_extract(stripped, r"(\S+)\s*$", 1)


def address_tokens(x: Column) -> Column:
    """Lower-case words with abbreviations spelled out."""
    words = F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9 -]", " "), " +"), lambda t: t != "")
    spelled = lambda t: F.coalesce(*[F.when(t == k, v) for k, v in ABBREVIATIONS.items()], t)
    return F.transform(words, spelled)


def normalize_address(x: Column) -> Column:
    return F.array_join(address_tokens(x), " ")


def leading_number(x: Column) -> Column:
    """The digits that a trimmed text starts with; null if there are none."""
    found = F.regexp_extract(F.trim(x), "^([0-9]+)", 1)
    return F.when(found != "", found)


def _latin(s: pd.Series) -> pd.Series:
    table = str.maketrans(LATIN | {k.upper(): v.upper() for k, v in LATIN.items() if len(k.upper()) == 1})
    return s.map(lambda x: None if x is None else x.translate(table), na_action="ignore")


def transliterate(x: Column) -> Column:
    """Cyrillic, Greek and special Latin letters spelled in ASCII, then normalize_text. Other scripts drop out."""
    return normalize_text(F.pandas_udf(_latin, "string")(x))


def to_text(x: Column, kind: str) -> Column:
    """The string view of a value: whole doubles without a fraction, true and false, nothing for binary data."""
    if kind in ("double", "float"):
        d = x.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(whole, F.format_string("%.0f", d)).otherwise(d.cast("string"))
    if kind == "binary":
        return F.lit(None).cast("string")
    if kind == "date":
        return F.date_format(x, "yyyy-MM-dd")
    if kind.startswith("timestamp"):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    return x.cast("string")
