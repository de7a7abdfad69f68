"""Phonetic codes: Double Metaphone (primary code of up to 4 letters) and Soundex."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 4
VOWELS = "AEIOUY"


@functools.lru_cache(200_000)
def double_metaphone(word: str) -> str:
    """The primary Double Metaphone code of a word, after the published description of the algorithm."""
    w = (word or "").strip().upper()
    if not w:
        return ""
    n, last = len(w), len(w) - 1
    slavic = "W" in w or "K" in w or "CZ" in w or "WITZ" in w
    out: list[str] = []
    i = 1 if w[:2] in ("GN", "KN", "PN", "WR", "PS") else 0

    def at(start: int, size: int, *options: str) -> bool:
        return start >= 0 and start + size <= n and w[start : start + size] in options

    def ch(p: int) -> str:
        return w[p] if 0 <= p < n else "\0"

    def vowel(p: int) -> bool:
        return ch(p) in VOWELS

    while i < n and len("".join(out)) < LENGTH:
        c = w[i]
        if c in VOWELS:
            if i == 0:
                out.append("A")
            i += 1
        elif c == "B":
            out.append("P")
            i += 2 if ch(i + 1) == "B" else 1
        elif c == "Ç":
            out.append("S")
            i += 1
        elif c == "C":
            i = _c(w, i, at, ch, vowel, out)
        elif c == "D":
            if at(i, 2, "DG"):
                if at(i + 2, 1, "I", "E", "Y"):
                    out.append("J")
                    i += 3
                else:
                    out.append("TK")
                    i += 2
            else:
                out.append("T")
                i += 2 if at(i, 2, "DT", "DD") else 1
        elif c == "G":
            i = _g(w, i, at, ch, vowel, out, slavic)
        elif c == "H":
            if (i == 0 or vowel(i - 1)) and vowel(i + 1):
                out.append("H")
                i += 2
            else:
                i += 1
        elif c == "J":
            if at(i, 4, "JOSE") or at(0, 4, "SAN "):
                out.append("H" if (i == 0 and ch(i + 4) == " ") or n == 4 or at(0, 4, "SAN ") else "J")
                i += 1
            else:
                if i == 0 and not at(i, 4, "JOSE"):
                    out.append("J")
                elif vowel(i - 1) and not slavic and ch(i + 1) in "AO":
                    out.append("J")
                elif i == last:
                    out.append("J")
                elif not at(i + 1, 1, "L", "T", "K", "S", "N", "M", "B", "Z") and not at(i - 1, 1, "S", "K", "L"):
                    out.append("J")
                i += 2 if ch(i + 1) == "J" else 1
        elif c in "FKNQV":
            out.append({"F": "F", "K": "K", "N": "N", "Q": "K", "V": "F"}[c])
            i += 2 if ch(i + 1) == c else 1
        elif c == "L":
            out.append("L")
            i += 2 if ch(i + 1) == "L" else 1
        elif c == "M":
            double = ch(i + 1) == "M" or (at(i - 1, 3, "UMB") and (i + 1 == last or at(i + 2, 2, "ER")))
            out.append("M")
            i += 2 if double else 1
        elif c == "Ñ":
            out.append("N")
            i += 1
        elif c == "P":
            if ch(i + 1) == "H":
                out.append("F")
                i += 2
            else:
                out.append("P")
                i += 2 if at(i + 1, 1, "P", "B") else 1
        elif c == "R":
            if not (i == last and not slavic and at(i - 2, 2, "IE") and not at(i - 4, 2, "ME", "MA")):
                out.append("R")
            i += 2 if ch(i + 1) == "R" else 1
        elif c == "S":
            i = _s(w, i, at, ch, out, slavic, last)
        elif c == "T":
            if at(i, 4, "TION") or at(i, 3, "TIA", "TCH"):
                out.append("X")
                i += 3
            elif at(i, 2, "TH") or at(i, 3, "TTH"):
                out.append("T" if at(i + 2, 2, "OM", "AM") or at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH") else "0")
                i += 2
            else:
                out.append("T")
                i += 2 if at(i + 1, 1, "T", "D") else 1
        elif c == "W":
            i = _w(w, i, at, vowel, out, last)
        elif c == "X":
            if i == 0:
                out.append("S")
                i += 1
            else:
                if not (i == last and (at(i - 3, 3, "IAU", "EAU") or at(i - 2, 2, "AU", "OU"))):
                    out.append("KS")
                i += 2 if at(i + 1, 1, "C", "X") else 1
        elif c == "Z":
            if ch(i + 1) == "H":
                out.append("J")
                i += 2
            else:
                out.append("S")
                i += 2 if ch(i + 1) == "Z" else 1
        else:
            i += 1
    return "".join(out)[:LENGTH]


def _c(w, i, at, ch, vowel, out) -> int:
    if at(i, 4, "CHIA") or (i > 1 and not vowel(i - 2) and at(i - 1, 3, "ACH") and ((ch(i + 2) not in "IE") or at(i - 2, 6, "BACHER", "MACHER"))):
        out.append("K")
        return i + 2
    if i == 0 and at(i, 6, "CAESAR"):
        out.append("S")
        return i + 2
    if at(i, 2, "CH"):
        if i > 0 and at(i, 4, "CHAE"):
            out.append("K")
        elif i == 0 and (at(1, 5, "HARAC", "HARIS") or at(1, 3, "HOR", "HYM", "HIA", "HEM")) and not at(0, 5, "CHORE"):
            out.append("K")
        elif (
            at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH") or at(i - 2, 6, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2, 1, "T", "S")
            or ((at(i - 1, 1, "A", "O", "U", "E") or i == 0) and (at(i + 2, 1, "L", "R", "N", "M", "B", "H", "F", "V", "W", " ") or i + 1 == len(w) - 1))
        ):
            out.append("K")
        elif i > 0:
            out.append("K" if at(0, 2, "MC") else "X")
        else:
            out.append("X")
        return i + 2
    if at(i, 2, "CZ") and not at(i - 2, 4, "WICZ"):
        out.append("S")
        return i + 2
    if at(i + 1, 3, "CIA"):
        out.append("X")
        return i + 3
    if at(i, 2, "CC") and not (i == 1 and ch(0) == "M"):
        if at(i + 2, 1, "I", "E", "H") and not at(i + 2, 2, "HU"):
            out.append("KS" if (i == 1 and ch(i - 1) == "A") or at(i - 1, 5, "UCCEE", "UCCES") else "X")
            return i + 3
        out.append("K")
        return i + 2
    if at(i, 2, "CK", "CG", "CQ"):
        out.append("K")
        return i + 2
    if at(i, 2, "CI", "CE", "CY"):
        out.append("S")
        return i + 2
    out.append("K")
    if at(i + 1, 2, " C", " Q", " G"):
        return i + 3
    return i + (2 if at(i + 1, 1, "C", "K", "Q") and not at(i + 1, 2, "CE", "CI") else 1)


def _g(w, i, at, ch, vowel, out, slavic) -> int:
    if ch(i + 1) == "H":
        if i > 0 and not vowel(i - 1):
            out.append("K")
        elif i == 0:
            out.append("J" if ch(i + 2) == "I" else "K")
        elif (i > 1 and at(i - 2, 1, "B", "H", "D")) or (i > 2 and at(i - 3, 1, "B", "H", "D")) or (i > 3 and at(i - 4, 1, "B", "H")):
            pass
        elif i > 2 and ch(i - 1) == "U" and at(i - 3, 1, "C", "G", "L", "R", "T"):
            out.append("F")
        elif i > 0 and ch(i - 1) != "I":
            out.append("K")
        return i + 2
    if ch(i + 1) == "N":
        if i == 1 and vowel(0) and not slavic:
            out.append("KN")
        elif not at(i + 2, 2, "EY") and ch(i + 1) != "Y" and not slavic:
            out.append("N")
        else:
            out.append("KN")
        return i + 2
    if at(i + 1, 2, "LI") and not slavic:
        out.append("KL")
        return i + 2
    if i == 0 and (ch(i + 1) == "Y" or at(i + 1, 2, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        out.append("K")
        return i + 2
    if (at(i + 1, 2, "ER") or ch(i + 1) == "Y") and not at(0, 6, "DANGER", "RANGER", "MANGER") and not at(i - 1, 1, "E", "I") and not at(i - 1, 3, "RGY", "OGY"):
        out.append("K")
        return i + 2
    if at(i + 1, 1, "E", "I", "Y") or at(i - 1, 4, "AGGI", "OGGI"):
        out.append("K" if at(0, 4, "VAN ", "VON ") or at(0, 3, "SCH") or at(i + 1, 2, "ET") else "J")
        return i + 2
    out.append("K")
    return i + (2 if ch(i + 1) == "G" else 1)


def _s(w, i, at, ch, out, slavic, last) -> int:
    if at(i - 1, 3, "ISL", "YSL"):
        return i + 1
    if i == 0 and at(i, 5, "SUGAR"):
        out.append("X")
        return i + 1
    if at(i, 2, "SH"):
        out.append("S" if at(i + 1, 4, "HEIM", "HOEK", "HOLM", "HOLZ") else "X")
        return i + 2
    if at(i, 3, "SIO", "SIA") or at(i, 4, "SIAN"):
        out.append("S")
        return i + 3
    if (i == 0 and at(i + 1, 1, "M", "N", "L", "W")) or at(i + 1, 1, "Z"):
        out.append("S")
        return i + (2 if at(i + 1, 1, "Z") else 1)
    if at(i, 2, "SC"):
        if ch(i + 2) == "H":
            if at(i + 3, 2, "OO", "ER", "EN", "UY", "ED", "EM"):
                out.append("X" if at(i + 3, 2, "ER", "EN") else "SK")
            else:
                out.append("X")
        elif at(i + 2, 1, "I", "E", "Y"):
            out.append("S")
        else:
            out.append("SK")
        return i + 3
    if not (i == last and at(i - 2, 2, "AI", "OI")):
        out.append("S")
    return i + (2 if at(i + 1, 1, "S", "Z") else 1)


def _w(w, i, at, vowel, out, last) -> int:
    if at(i, 2, "WR"):
        out.append("R")
        return i + 2
    if i == 0 and (vowel(i + 1) or at(i, 2, "WH")):
        out.append("A")
        return i + 1
    if (i == last and vowel(i - 1)) or at(i - 1, 5, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, 3, "SCH"):
        return i + 1
    if at(i, 4, "WICZ", "WITZ"):
        out.append("TS")
        return i + 4
    return i + 1


def _codes(s: pd.Series) -> pd.Series:
    known = {x: double_metaphone(x) for x in s.dropna().unique()}
    return s.map(lambda x: known.get(x), na_action="ignore")


def _code_lists(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [double_metaphone(x) if x else "" for x in xs])


def metaphone(x: Column) -> Column:
    """Double Metaphone of each text; distinct texts of a batch are coded once."""
    return F.pandas_udf(_codes, "string")(x)


def metaphones(x: Column) -> Column:
    """Double Metaphone of each text of an array."""
    return F.pandas_udf(_code_lists, "array<string>")(x)


def soundex(x: Column) -> Column:
    """Soundex of a word; empty for texts that don't start with a letter."""
    return F.when(x.rlike("^[A-Za-z]"), F.soundex(x)).when(x.isNotNull(), "")
