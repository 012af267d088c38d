"""Quality rules: a threshold table compiled into one projection.

Every measure is a built-in expression over the whole text; the table's rows
become one boolean each, and their conjunction is the verdict. No user
function runs.

Defined results: null text and text without words have all counts 0 and fail
the base rule; rows that repeat are judged alike; a rule whose measure has no
denominator, or whose text has fewer words than the rule asks for, holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
WINDOW = 5
#: Frequent words of four languages (fixed values).
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "was", "this", "from", "by", "at", "or", "as", "are", "not",
    "der", "die", "das", "und", "ist", "nicht", "von", "zu", "mit", "den", "des", "ein", "eine", "im", "auf", "sich", "dem", "als", "auch",
    "le", "la", "les", "de", "et", "un", "une", "que", "qui", "dans", "est", "pour", "pas", "au", "aux", "du",
    "el", "los", "las", "y", "en", "que", "por", "una", "con", "no", "para", "se", "su", "lo", "mi",
)


@dataclass(frozen=True)
class Rule:
    """measure <= or >= bound, asked of texts with at least min_words words."""

    name: str
    measure: str
    op: str
    bound: float
    min_words: int = 0


#: The threshold table. Measures: mean_word, symbol_ratio, stop_ratio, dup_line_ratio.
RULES = (
    Rule("word_length_low", "mean_word", ">=", 2.0),
    Rule("word_length_high", "mean_word", "<=", 24.0),
    Rule("symbols", "symbol_ratio", "<=", 0.1),
    Rule("stop_words", "stop_ratio", ">=", 0.02, 40),
    Rule("repeated_lines", "dup_line_ratio", "<=", 0.5),
)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+`; null has none."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use; each level materialises what the next refers to more than once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    rows = rows.withColumns({"_w": words(F.col("_t")), "_l": F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    window = lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW)))
    rows = rows.withColumn("_h", F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), window)).otherwise(F.array().cast("array<bigint>")))
    # only texts with some repeated window are sorted
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    rows = rows.withColumn("_s", F.when(some, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.get("_s", j)["h"].eqNullSafe(F.get("_s", k)["h"])
    rows = rows.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.filter(F.transform("_s", lambda s, j: F.when((same(j, j + 1) & (j + 1 < F.size("_s"))) | (same(j, j - 1) & (j > 0)), s["i"])), lambda p: p.isNotNull()))))
    covered = F.aggregate("_p", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n")))
    long = lambda c: c.cast("long")
    return rows.select(
        "doc_id",
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.regexp_count("_t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.coalesce(covered["n"], F.lit(0).cast("long")).alias("n_repeat_words"),
        long(F.size("_l")).alias("n_lines"),
        long(F.size(F.filter("_w", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS)))))).alias("n_stop_words"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, failed_rules and kept."""
    value = {"mean_word": _ratio("word_chars", "n_words"), "symbol_ratio": _ratio("n_symbols", "n_words"), "stop_ratio": _ratio("n_stop_words", "n_words"), "dup_line_ratio": _ratio("n_dup_lines", "n_lines")}
    holds = {r.name: F.coalesce((value[r.measure] <= r.bound if r.op == "<=" else value[r.measure] >= r.bound) | (F.col("n_words") < r.min_words), F.lit(True)) for r in rules}
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in holds.items())))
    out = measures(docs).withColumns({"base_failed": base, "failed_rules": F.array_join(failed, ",") if rules else F.lit("")})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over a view `documents`, in the SQL of an independent engine."""
    value = {"mean_word": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words", "stop_ratio": "n_stop_words / n_words", "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)"}
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    failed = ", ".join(f"CASE WHEN NOT coalesce(({value[r.measure]}) {r.op} {r.bound} OR n_words < {r.min_words}, true) THEN '{r.name}' END" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT g.doc_id, g.i FROM g JOIN rep ON g.doc_id = rep.doc_id AND g.s = rep.s) x, (SELECT unnest(range(0, 5)) AS k) y GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN n_words = 0 THEN '' ELSE concat_ws(',', {failed}) END AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM f
"""
