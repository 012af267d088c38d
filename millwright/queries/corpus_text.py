"""Queries of text cleaning, tokens, n-grams, vocabularies and term weights, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data import Roles, table
from ..operators import text as T
from ..operators.base import fit
from .registry import query

DOC = Roles(row_id="doc_id", exclude=("lang", "source"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _clean(name: str, step: str, sql: str) -> None:
    @query(name, f"SELECT doc_id, {sql} AS text FROM documents")
    def run(spark, d):
        df = _docs(spark, d)
        return fit(step, "apply", df, DOC)(df)


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_clean("text_lower", "lowercase", "lower(text)")
_clean("text_punct", "punctuation", "regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', '', 'g')")
_clean("text_whitespace", "whitespace", "trim(regexp_replace(text, '\\s+', ' ', 'g'))")
_clean("text_stopword", "stopword", f"array_to_string(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND lower(w) NOT IN ({_STOP})), ' ')")
_clean("text_ascii", "special_character", "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_\\s]', '', 'g')")
_clean("text_quotes", "quotes", "replace(replace(text, '\"', ''), '''', '')")


@query("text_dates", "SELECT o_orderkey AS rid, replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-', '/') AS cell FROM orders UNION ALL SELECT c_custkey AS rid, c_name AS cell FROM customer")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("cell"))
    df = orders.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_name").alias("cell")))
    return fit("date_separator", "apply", df, Roles(row_id="rid"))(df)


@query("text_tokens", "SELECT doc_id, CAST(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) AS BIGINT) AS n, array_to_string(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> ''), '|') AS tokens FROM documents")
def _(spark, d):
    df = _docs(spark, d)
    out = fit("tokenizer", "whitespace", df, DOC)(df)
    return out.select("doc_id", F.size("text").cast("long").alias("n"), F.array_join("text", "|").alias("tokens"))


@query("text_word_tokens", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS BIGINT) AS n FROM documents")
def _(spark, d):
    df = _docs(spark, d)
    return fit("tokenizer", "nltk", df, DOC)(df).select("doc_id", F.size("text").cast("long").alias("n"))


_PLAIN = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query("ngrams_word", f"WITH w AS (SELECT doc_id, list_filter(string_split({_PLAIN}, ' '), lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(list_transform(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda z: z[1] || '_' || z[2]), ' ') AS ngrams FROM w")
def _(spark, d):
    df = _docs(spark, d)
    return fit("ngram_extractor", "word", df, DOC, n=2)(df).select("doc_id", F.array_join("text__ngrams", " ").alias("ngrams"))


@query("ngrams_char", f"WITH s AS (SELECT doc_id, replace({_PLAIN}, ' ', '') AS s FROM documents), i AS (SELECT doc_id, s, unnest(range(1, greatest(length(s) - 1, 1))) AS i FROM s), g AS (SELECT substr(s, CAST(i AS INTEGER), 3) AS g FROM i) SELECT g, count(*) AS n FROM g GROUP BY g")
def _(spark, d):
    return _docs(spark, d).select(F.explode(T.char_ngrams("text", 3)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


_W = "list_filter(string_split_regex(trim(lower(text)), '\\s+'), lambda w: w <> '')"
_DF = f"SELECT t AS term, count(*) AS weight FROM (SELECT unnest(list_distinct({_W})) AS t FROM documents) GROUP BY t"


def _terms():
    return T.words(F.lower("text"))


@query("vocab_min_df", f"SELECT * FROM ({_DF}) WHERE weight >= 5")
def _(spark, d):
    return T.vocabulary(_docs(spark, d), "doc_id", _terms(), "min_df", min_df=5)


@query("vocab_max_df", f"SELECT * FROM ({_DF}) WHERE weight <= (SELECT floor(0.5 * count(*)) FROM documents)")
def _(spark, d):
    return T.vocabulary(_docs(spark, d), "doc_id", _terms(), "max_df", max_df=0.5)


@query("vocab_min_max_df", f"SELECT * FROM ({_DF}) WHERE weight >= 5 AND weight <= (SELECT floor(0.5 * count(*)) FROM documents)")
def _(spark, d):
    return T.vocabulary(_docs(spark, d), "doc_id", _terms(), "min_max_df", min_df=5, max_df=0.5)


@query("vocab_top_k", f"SELECT * FROM ({_DF}) ORDER BY weight DESC, term LIMIT 100")
def _(spark, d):
    return T.vocabulary(_docs(spark, d), "doc_id", _terms(), "top_k", k=100)


_TF = f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_W}) AS t FROM documents) GROUP BY doc_id, t"


@query("vocab_tfidf", f"WITH c AS ({_TF}), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS n FROM documents) SELECT c.term, round(sum(ln(1 + tf) * (ln((1 + n.n) / (1.0 + df)) + 1)), 4) AS weight FROM c JOIN f ON f.term = c.term, n GROUP BY c.term ORDER BY round(sum(ln(1 + tf) * (ln((1 + n.n) / (1.0 + df)) + 1)), 9) DESC, c.term LIMIT 50")
def _(spark, d):
    return T.vocabulary(_docs(spark, d), "doc_id", _terms(), "top_k_tfidf", k=50).select("term", F.round("weight", 4).alias("weight"))


@query("vocab_prune", f"WITH v AS ({_DF}), k AS (SELECT term FROM v WHERE weight >= 50), t AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM (SELECT doc_id, list_filter(string_split_regex(trim(lower(text)), '\\s+'), lambda x: x <> '') AS w FROM documents)), j AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS text FROM t JOIN k ON k.term = t.t GROUP BY doc_id) SELECT d.doc_id, coalesce(j.text, '') AS text FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id")
def _(spark, d):
    df = _docs(spark, d).withColumn("text", F.lower("text"))
    return fit("vocabulary_pruning", "min_df", df, DOC, min_df=50)(df)


_T2 = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
_C2 = f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_T2}) AS t FROM documents) GROUP BY doc_id, t"


@query("tfidf_long", f"WITH c AS ({_C2}), f AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, c.term, tf * (ln((1 + n.n) / (1.0 + df)) + 1) AS raw FROM c JOIN f ON f.term = c.term, n), l AS (SELECT doc_id, sqrt(sum(raw * raw)) AS l FROM r GROUP BY doc_id) SELECT r.doc_id, term, round(raw / l, 6) AS weight FROM r JOIN l ON l.doc_id = r.doc_id")
def _(spark, d):
    df = _docs(spark, d)
    return fit("embedding", "tfidf", df, DOC)(df).select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query("term_counts", _C2)
def _(spark, d):
    df = _docs(spark, d)
    return fit("embedding", "count", df, DOC)(df)


@query("term_hashes")
def _(spark, d):
    df = _docs(spark, d)
    return fit("embedding", "hash", df, DOC)(df)


@query("spell_check")
def _(spark, d):
    df = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rid"), "text")
    return fit("spell_checker", "frequency", df, Roles(row_id="rid"), column="text")(df)


def _lemma() -> str:
    cases = " ".join(f"WHEN ends_with(w, '{end}') AND length(w) >= {len(end) + 3} THEN substr(w, 1, length(w) - {len(end)}) || '{new}'" for end, new in T.SUFFIXES)
    return f"array_to_string(list_transform(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> ''), lambda w: CASE {cases} ELSE w END), ' ')"


@query("lemmatize", f"SELECT doc_id, {_lemma()} AS text FROM documents")
def _(spark, d):
    df = _docs(spark, d)
    return fit("lemmatizer", "suffix", df, DOC)(df)


def _votes() -> str:
    return ", ".join(f"{{'n': -len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in T.MARKERS[k])}))), 'lang': '{k}'}}" for k in sorted(T.MARKERS))


@query("detect_language", f"WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}]+') AS w FROM documents), v AS (SELECT doc_id, list_sort([{_votes()}])[1] AS v FROM w) SELECT doc_id, CASE WHEN v.n < 0 THEN v.lang END AS lang FROM v")
def _(spark, d):
    df = _docs(spark, d)
    return fit("language_detector", "ld", df, DOC)(df).select("doc_id", F.col("text__lang").alias("lang"))


@query("translate_identity", "SELECT doc_id, text FROM documents")
def _(spark, d):
    df = _docs(spark, d)
    return fit("language_translator", "none", df, DOC)(df)


@query("html_strip", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html("html").alias("text"))


@query("recode_values", "SELECT o_orderkey AS rid, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' WHEN 'P' THEN NULL ELSE o_orderstatus END AS status FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), T.recode("o_orderstatus", {"F": "final", "O": "open"}, missing="P").alias("status"))


@query("noise_dashes", "SELECT p_partkey AS rid, replace(p_name, ' ', '-') AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("rid"), T.dashes("p_name").alias("name"))


@query("noise_typo")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("rid"), T.typo("p_name", "p_partkey").alias("name"))


@query("noise_synonyms", "SELECT p_partkey AS rid, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE lower(w) WHEN 'red' THEN 'crimson' WHEN 'small' THEN 'little' WHEN 'large' THEN 'big' ELSE w END), ' ') AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("rid"), T.synonyms("p_name", {"red": "crimson", "small": "little", "large": "big"}).alias("name"))
