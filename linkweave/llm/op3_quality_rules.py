"""Quality rules as a bitmask ledger, in DataFrame functions only.

measure() reads every whole text once and evaluates every rule once: the ledger has a document's measurements and `failed`, an
integer with one bit for each failed rule. Policies are versioned masks over those bits. stored_ledger() writes the ledger: applying a policy
to it, or asking what a policy would keep without one of its rules, never reads a text again. Ablations aggregate the
masks: first to one row for each distinct mask (at most 2^rules rows), then by bit operations. The query applies one policy, so it
stores nothing and computes no ablations.

Null and empty texts have no words: all measures are 0 and the rule few_words fails. Ties don't occur: a
document's row depends on its own text alone, and repeated rows each give a row. Input columns other than
doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import let

WINDOW = 5

#: Rule names by bit, and the condition under which a document fails, over the measurements (Spark and DuckDB).
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars > 50 * n_words OR 2 * word_chars < 3 * n_words",
    "capitals": "10 * n_upper > 6 * word_chars",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: the rules that each enforces.
POLICIES = {"base": BASE, "2024-1": BASE | BIT["symbols"] | BIT["repeated_lines"], "2024-2": (1 << len(RULES)) - 1}
PRODUCTION = "2024-2"


def repeat_words(words: Column, windows: Column) -> Column:
    """Number of words in windows that occur more than once; windows[i] stands for words i to i+4.

    Sorting (window, position) puts equal windows side by side; the covered words are counted over the
    ascending positions of such windows, in n log n steps for any text.
    """

    def covered(p: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(p) - 1)
        gaps = F.transform(steps, lambda k: F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)))
        return F.lit(WINDOW) + F.when(F.size(p) > 1, F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0)

    def positions(s: Column) -> Column:
        h = lambda k: F.get(s, k)["h"]
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: ((k > 0) & (h(k - 1) == h(k))) | ((k < F.size(s) - 1) & (h(k + 1) == h(k))))
        return let(F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"])), covered)

    by_window = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), 0).otherwise(let(by_window, positions))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger: doc_id, the measurements and failed."""
    t = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("words", F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)))
    t = t.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    w = F.col("words")
    at = lambda i, k: F.get(w, i + k)
    windows = F.when(F.size(w) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))
    )
    t = t.withColumn("windows", windows)
    t = t.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(w, F.col("windows")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
    )
    bits = [F.when(F.expr(rule), BIT[name]).otherwise(0) for name, rule in RULES.items()]
    return t.withColumn("failed", sum(bits[1:], bits[0]))


def stored_ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger as a table, for several policies or ablations."""
    return common.stored(measure(df, id_col, text_col), "ledger")


def apply_policy(ledger: DataFrame, policy: str | int = PRODUCTION) -> DataFrame:
    """The ledger with base_failed and the policy's kept."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    failed = F.col("failed")
    return ledger.withColumn("base_failed", failed.bitwiseAND(BASE) != 0).withColumn("kept", failed.bitwiseAND(mask | BASE) == 0)


def ablate(ledger: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """policy, without (a rule, or null for the whole policy), n_docs, n_kept.

    The texts' masks are first counted by distinct mask; the policies and rules are a few literals.
    """
    policies = policies or POLICIES
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(r).cast("string").alias("without"), F.lit(mask & ~BIT.get(r, 0)).alias("mask")) for p, mask in policies.items() for r in (None, *(n for n in RULES if mask & BIT[n]))]
    seen = ledger.groupBy("failed").agg(F.count("*").alias("n"))
    return seen.select("failed", "n", F.inline(F.array(*cases))).groupBy("policy", "without").agg(
        F.sum("n").alias("n_docs"), F.sum(F.when(F.col("failed").bitwiseAND(F.col("mask")) == 0, F.col("n")).otherwise(0)).alias("n_kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(measure(common.documents(spark, sf_dir)))


ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
one AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
win AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e FROM one WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c, d, e) AS n FROM win WHERE e IS NOT NULL) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  (length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')))::BIGINT AS n_upper FROM w LEFT JOIN cover USING (r)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items())})::INT AS failed FROM m)
SELECT *, (failed & {BASE}) <> 0 AS base_failed, (failed & {POLICIES[PRODUCTION] | BASE}) = 0 AS kept FROM f
"""
