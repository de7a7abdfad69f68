import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.functions import normalize as N
from linkweave.functions import similarity as S
from linkweave.functions.phonetic import double_metaphone


def values(spark, f, rows, n=1):
    names = ["x", "y"][:n]
    d = spark.createDataFrame([(i, *(r if n > 1 else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in names))
    return [r[0] for r in d.orderBy("i").select(f(*(F.col(c) for c in names))).collect()]


def test_normalize_text(spark):
    assert values(spark, N.normalize_text, ["  Müller\t van  ", "ﬁn", "日本", "", None, "a b"]) == ["MULLER VAN", "FIN", "", "", None, "A B"]


def test_prefixes_and_surnames(spark):
    assert values(spark, N.strip_prefix, ["VAN DEN BERG", "van der Aa", "V.D. BERG", "VANDAAL", "DE"]) == ["BERG", "Aa", "BERG", "VANDAAL", "DE"]
    assert values(spark, N.surname_token, ["JAN DE VRIES", "VAN DIJK", "", "BOS "]) == ["VRIES", "DIJK", "", "BOS"]


def test_address_and_number(spark):
    assert values(spark, N.normalize_address, ["Dorpsstr. 12", "Park ln 3", "Main St.", ""]) == ["dorpsstr 12", "park laan 3", "main street", ""]
    assert values(spark, N.leading_number, [" 12a", "x1", "", None]) == ["12", None, None, None]


def test_transliterate(spark):
    assert values(spark, N.transliterate, ["Иванов", "Παπαδοπουλος", "Øst ß", None]) == ["IVANOV", "PAPADOPOULOS", "OST SS", None]


def test_double_matches_plain_text(spark):
    d = spark.createDataFrame([(52.0,), (0.5,), (12345678.0,), (None,)], "x double")
    assert [r[0] for r in d.select(N.to_text(F.col("x"), "double")).collect()] == ["52", "0.5", "12345678", None]


@pytest.mark.parametrize("word, code", [("SMITH", "SM0"), ("SCHMIDT", "XMT"), ("JANSEN", "JNSN"), ("THOMAS", "TMS"), ("WRIGHT", "RT"), ("", "")])
def test_double_metaphone(word, code):
    assert double_metaphone(word) == code


@given(st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ ", max_size=12))
def test_double_metaphone_is_short_and_total(word):
    assert len(double_metaphone(word)) <= 4


@given(st.text("abcde", max_size=8), st.text("abcde", max_size=8))
def test_jaro_winkler_range_and_identity(a, b):
    assert 0 <= S.jaro_winkler_of(a, b) <= 1
    assert S.jaro_winkler_of(a, a) == 1


def test_similarities(spark):
    assert values(spark, S.date_likeness, [("2020-01-01", "2020-01-01"), ("2020-01-31", "2020-02-01"), ("2020-01-01", "2020-01-20"), ("2020-01-01", "2020-07-20"), ("2020-01-01", "2021-07-20"), ("2020-01-01", "2030-01-01"), ("x", "2020-01-01"), ("0", "1970-01-01"), ("2020-02-31", "2020-03-02")], 2) == [1, 0.9, 0.75, 0.5, 0.3, 0, 0, 1, 1]
    assert values(spark, S.numeric_bucketed, [("100", "100"), ("100", "96"), ("100", "85"), ("100", "60"), ("1", "100"), ("1d", "1"), (" 5 ", "5"), ("a", "a")], 2) == [1, 0.85, 0.6, 0.3, 0, 0, 1, 0]
    assert values(spark, S.hamming(1), [("ab", "ab"), ("ab", "ac"), ("ab", "cd"), ("ab", "abc"), ("", "")], 2) == [1, 0.8, 0, 0, 1]
    assert values(spark, S.alias_overlap, [("Jan Jansen|JJ", "jj|Jan Jansen"), ("", "a"), ("a b", "a c")], 2) == pytest.approx([1, 0, 1 / 3])
    assert values(spark, S.token_overlap, [("a b", "b a"), ("", ""), ("a", "")], 2) == [1, 1, 0]
    assert values(spark, S.street_number, [("12 x", "12 y"), ("12", "13"), ("12", "45"), ("x", "1")], 2) == [1, 0.8, 0, 0]
    assert values(spark, S.levenshtein(2), [("ab", "ab"), ("ab", "ac"), ("ab", "xyz")], 2) == [1, 0.5, 0]
    assert values(spark, S.suffix(3), [("x123", "y123"), ("12", "12")], 2) == [1, 0]


def test_jaro_winkler_of_many_pairs():
    """The kernel over whole batches equals the definition pair by pair, at all widths."""
    rng = random.Random(5)
    a, b = [None, "", "x", "", "martha"], ["x", "", "", "y", "marhta"]
    for _ in range(3000):
        x = [rng.choice("abcdé") for _ in range(rng.randint(0, rng.choice((4, 9, 20, 40, 64, 80))))]
        y = [c for c in x if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            if len(y) > 1:
                i = rng.randrange(len(y) - 1)
                y[i], y[i + 1] = y[i + 1], y[i]
        a.append("".join(x))
        b.append("".join(y))
    got = S.jaro_winkler_many(a, b)
    assert np.isnan(got[0]) and all(g == S.jaro_winkler_of(x, y) for x, y, g in zip(a[1:], b[1:], got[1:]))
    assert len(S.jaro_winkler_many([], [])) == 0
