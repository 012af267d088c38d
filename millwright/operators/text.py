"""Cell-wise text cleaning, tokens, n-grams, vocabularies and term weights."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import Roles, text_columns
from .base import Fitted, columnwise, step

#: Frequent English words (fixed values).
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Formats that count as dates.
DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")


def lower(c: str) -> Column:
    return F.lower(c)


def no_punctuation(c: str) -> Column:
    """Without everything but letters, digits, underscores and white space."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")


def squeeze(c: str) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def no_stop_words(c: str, words: tuple[str, ...] = STOP_WORDS) -> Column:
    kept = F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: (w != "") & ~F.lower(w).isin(*words))
    return F.array_join(kept, " ")


def ascii_only(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F]", ""), r"[^A-Za-z0-9_\s]", "")


def no_quotes(c: str) -> Column:
    return F.translate(c, "\"'", "")


def date_slashes(c: str) -> Column:
    """Cells that are dates get slashes for dashes."""
    parsed = F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS))
    return F.when(parsed.isNotNull(), F.replace(F.col(c), F.lit("-"), F.lit("/"))).otherwise(F.col(c))


def collapse_runs(c: str) -> Column:
    """Runs of three or more equal characters become two."""
    return F.regexp_replace(c, r"(.)\1{2,}", "$1$1")


CLEANERS: dict[str, Callable[[str], Column]] = {"lowercase": lower, "punctuation": no_punctuation, "whitespace": squeeze, "stopword": no_stop_words, "special_character": ascii_only, "quotes": no_quotes, "date_separator": date_slashes}


def _cleaner(name: str):
    @step(name, "apply", "none")
    def clean(df: DataFrame, roles: Roles = Roles(), strategy: str = "apply", columns: list[str] | None = None) -> Fitted:
        names = [] if strategy == "none" else columns or text_columns(df, roles)
        return Fitted(columnwise({c: CLEANERS[name](c) for c in names}))

    return clean


for _name in CLEANERS:
    _cleaner(_name)


def words(c: str | Column) -> Column:
    """Whitespace tokens."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def word_tokens(c: str | Column) -> Column:
    """Runs of word characters, and single marks."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


@step("tokenizer", "whitespace", "nltk", "none")
def tokenise(df: DataFrame, roles: Roles = Roles(), strategy: str = "whitespace", columns: list[str] | None = None) -> Fitted:
    f = words if strategy == "whitespace" else word_tokens
    return Fitted(columnwise({} if strategy == "none" else {c: f(c) for c in columns or text_columns(df, roles)}))


def plain(c: str | Column) -> Column:
    """Lower case, everything but letters and digits to a space, spaces collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def runs_of(items: Column, n: int, join: str) -> Column:
    """Every n neighbouring items, joined; shifted copies are zipped, so the items are computed n times and not once an item."""
    size = F.greatest(F.size(items) - (n - 1), F.lit(0))
    out = F.slice(items, F.lit(1), size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, F.lit(k + 1), size), lambda a, b: F.concat(a, F.lit(join), b))
    return out


def word_ngrams(c: str | Column, n: int) -> Column:
    return runs_of(F.filter(F.split(plain(c), " "), lambda x: x != ""), n, "_")


def char_ngrams(c: str | Column, n: int) -> Column:
    return runs_of(F.filter(F.split(F.replace(plain(c), F.lit(" "), F.lit("")), ""), lambda x: x != ""), n, "")


@step("ngram_extractor", "word", "char")
def ngrams(df: DataFrame, roles: Roles = Roles(), strategy: str = "word", n: int = 2, columns: list[str] | None = None) -> Fitted:
    f = word_ngrams if strategy == "word" else char_ngrams
    return Fitted(columnwise({f"{c}__ngrams": f(c, n) for c in columns or text_columns(df, roles)}))


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf) from an array of terms.

    The rows are dealt by key while they are still texts; their terms are then
    counted where they are, without a second shuffle of (key, term) rows.
    """
    return df.repartition(key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(df: DataFrame, terms: Column) -> DataFrame:
    return df.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(df: DataFrame, key: str, terms: Column, strategy: str = "min_df", min_df: float = 1, max_df: float = 1.0, k: int = 1000) -> DataFrame:
    """(term, weight) of the kept terms: by document frequency, the k most frequent, or the k of largest summed log-tf-idf."""
    def least(x: float, n: int) -> int:
        return math.floor(x * n) if isinstance(x, float) else x

    if strategy == "top_k_tfidf":
        counts = term_counts(df, key, terms)
        freq, n = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), df.count()
        scored = counts.join(freq, "term").groupBy("term").agg(F.sum(F.log1p("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("weight"))
        return scored.orderBy(F.desc(F.round("weight", 9)), "term").limit(k)
    freq = document_frequency(df, terms).select("term", F.col("df").alias("weight"))
    if strategy == "top_k":
        return freq.orderBy(F.desc("weight"), "term").limit(k)
    n = df.count() if isinstance(min_df, float) or isinstance(max_df, float) else 0
    low, high = least(min_df, n) if "min" in strategy else None, least(max_df, n) if "max" in strategy else None
    return freq.where((F.col("weight") >= low if low is not None else F.lit(True)) & (F.col("weight") <= high if high is not None else F.lit(True)))


@step("vocabulary_pruning", "min_df", "max_df", "min_max_df", "top_k", "top_k_tfidf", "none")
def prune(df: DataFrame, roles: Roles, strategy: str = "min_df", columns: list[str] | None = None, **how) -> Fitted:
    """Keeps only vocabulary words in the text columns, in their order."""
    names, key = columns or text_columns(df, roles), roles.row_id
    if strategy == "none":
        return Fitted(lambda d: d)
    kept = vocabulary(df, key, words(F.concat_ws(" ", *names)), strategy, **how).select("term")

    def apply(d: DataFrame) -> DataFrame:
        for c in names:
            at = d.select(key, F.posexplode(words(c)).alias("p", "term")).join(kept, "term")
            text = at.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "term"))), lambda x: x["term"]), " ").alias("_t"))
            d = d.join(text, key, "left").withColumn(c, F.when(F.col(c).isNotNull(), F.coalesce("_t", F.lit("")))).drop("_t")
        return d

    return Fitted(apply)


def tokens2(c: str | Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def tfidf(df: DataFrame, key: str, terms: Column, n: int | None = None) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each row to length 1."""
    counts = term_counts(df, key, terms)
    n = df.count() if n is None else n
    freq = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = counts.join(freq, "term").select(key, "term", (F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


@step("embedding", "tfidf", "count", "hash")
def embed(df: DataFrame, roles: Roles, strategy: str = "tfidf", column: str = "text", features: int = 1 << 18) -> Fitted:
    """Long term tables (row id, term, weight): tf-idf, counts, or hashed counts to length 1."""
    key = roles.row_id
    if strategy == "tfidf":
        return Fitted(lambda d: tfidf(d, key, tokens2(column)))
    if strategy == "count":
        return Fitted(lambda d: term_counts(d, key, tokens2(column)))

    def hashed(d: DataFrame) -> DataFrame:
        slot = F.transform(tokens2(column), lambda t: F.pmod(F.hash(t), F.lit(features)).cast("string"))
        counts = term_counts(d, key, slot)
        norm = counts.groupBy(key).agg(F.sqrt(F.sum((F.col("tf") * F.col("tf")).cast("double"))).alias("norm"))
        return counts.join(norm, key).select(key, "term", (F.col("tf") / F.col("norm")).alias("weight"))

    return Fitted(hashed)


@step("spell_checker", "frequency", "none")
def spell(df: DataFrame, roles: Roles, strategy: str = "frequency", column: str = "text", common: int = 20, rare: int = 1) -> Fitted:
    """A word seen at most `rare` times becomes the most frequent common word that one deletion on either side makes equal (which covers one edit)."""
    key = roles.row_id
    if strategy == "none":
        return Fitted(lambda d: d)
    freq = df.select(F.explode(words(F.lower(column))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.length("w") > 2)
    deletions = F.array_union(F.array("w"), F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substr("w", F.lit(1), i - 1), F.substr("w", i + 1))))
    good = freq.where(F.col("n") >= common).select(F.col("w").alias("good"), F.col("n").alias("gn"), F.explode(deletions).alias("d"))
    bad = freq.where(F.col("n") <= rare).select("w", F.explode(deletions).alias("d"))
    fix = bad.join(good, "d").where(F.levenshtein("w", "good") <= 1).groupBy("w").agg(F.min_by("good", F.struct(-F.col("gn"), F.col("good"))).alias("good"))

    def apply(d: DataFrame) -> DataFrame:
        at = d.select(key, F.posexplode(words(column)).alias("p", "t")).withColumn("w", F.lower("t")).join(fix, "w", "left")
        text = at.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("good", "t").alias("t")))), lambda x: x["t"]), " ").alias("_t"))
        return d.join(text, key, "left").withColumn(column, F.coalesce("_t", column)).drop("_t")

    return Fitted(apply)


#: Endings that a lemma drops, and what replaces them, longest first (fixed values).
SUFFIXES = (("sses", "ss"), ("ies", "y"), ("ing", ""), ("ed", ""), ("ss", "ss"), ("s", ""))


def lemma(word: str) -> str:
    for end, new in SUFFIXES:
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: len(word) - len(end)] + new
    return word


@step("lemmatizer", "suffix", "plugin", "none")
def lemmatise(df: DataFrame, roles: Roles = Roles(), strategy: str = "suffix", columns: list[str] | None = None, plugin: Callable[[str], str] | None = None) -> Fitted:
    """Each whitespace token to its lemma: by suffix rules, or by a function given."""
    names = columns or text_columns(df, roles)
    if strategy == "none":
        return Fitted(lambda d: d)
    if strategy == "suffix":
        def one(w: Column) -> Column:
            out = w
            for end, new in reversed(SUFFIXES):
                out = F.when(F.endswith(w, F.lit(end)) & (F.length(w) >= len(end) + 3), F.concat(F.substr(w, F.lit(1), F.length(w) - len(end)), F.lit(new))).otherwise(out)
            return out

        return Fitted(columnwise({c: F.array_join(F.transform(words(c), one), " ") for c in names}))
    of = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else " ".join(map(plugin, t.split()))), "string")
    return Fitted(columnwise({c: of(F.col(c)) for c in names}))


#: Frequent short words by language (fixed values).
MARKERS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "on", "this", "from", "by"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "von", "den", "mit", "zu", "ein", "eine", "auf", "im", "des"),
    "fr": ("le", "la", "les", "et", "des", "est", "une", "que", "dans", "pour", "qui", "un", "du", "au", "aux"),
    "es": ("el", "los", "las", "que", "una", "por", "con", "para", "del", "es", "se", "no", "lo", "su", "en"),
}


@step("language_detector", "ld", "none")
def detect_language(df: DataFrame, roles: Roles = Roles(), strategy: str = "ld", column: str = "text", markers: dict[str, tuple[str, ...]] = MARKERS) -> Fitted:
    """Adds `<column>__lang`: the language with most marker words; none is null, ties go to the smaller name."""
    if strategy == "none":
        return Fitted(lambda d: d)
    w = F.split(F.lower(column), r"[^\p{L}]+")

    def vote(lang: str, own: tuple[str, ...]) -> Column:
        return F.struct((-F.size(F.filter(w, lambda x: x.isin(*own)))).alias("n"), F.lit(lang).alias("lang"))

    votes = F.array(*(vote(k, m) for k, m in sorted(markers.items())))
    best = F.array_min(votes)
    return Fitted(columnwise({f"{column}__lang": F.when(best["n"] < 0, best["lang"])}))


@step("language_translator", "plugin", "none")
def translate(df: DataFrame, roles: Roles = Roles(), strategy: str = "none", columns: list[str] | None = None, plugin: Callable[[str], str] | None = None) -> Fitted:
    """A translation function given, over Arrow batches; without one texts stay as they are."""
    if strategy == "none" or plugin is None:
        return Fitted(lambda d: d)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else plugin(t))

    of = F.pandas_udf(run, "string")
    return Fitted(columnwise({c: of(F.col(c)) for c in columns or text_columns(df, roles)}))


def strip_html(c: str | Column) -> Column:
    """Text of a page: scripts, styles and tags removed, spaces collapsed."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def recode(c: str, mapping: dict, missing: str | None = "?") -> Column:
    """Values by a dictionary, others unchanged; the missing mark becomes NULL."""
    table = F.create_map(*(x for k, v in mapping.items() for x in (F.lit(k), F.lit(v)))) if mapping else None
    out = F.coalesce(F.try_element_at(table, F.col(c)), F.col(c)) if mapping else F.col(c)
    return F.when(~(F.col(c) == F.lit(missing)), out) if missing is not None else out


def typo(c: str, key: str, seed: int = 1) -> Column:
    """Swaps two neighbouring letters at a place that follows from the key; short cells stay."""
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(F.length(c) - 1, F.lit(1)).cast("long")).cast("int") + 1
    swapped = F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + 1, F.lit(1)), F.substr(c, at, F.lit(1)), F.substr(c, at + 2))
    return F.when(F.length(c) > 1, swapped).otherwise(F.col(c))


def synonyms(c: str, table: dict[str, str]) -> Column:
    """Whole words by a table of synonyms."""
    m = F.create_map(*(x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(v))))
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.try_element_at(m, F.lower(w)), w)), " ")


def dashes(c: str) -> Column:
    return F.replace(F.col(c), F.lit(" "), F.lit("-"))


