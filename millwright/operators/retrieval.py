"""Retrieval for question answering: normalise, retrieve, rerank, build context, answer, profile."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..data import shared_folder
from . import postings
from .text import STOP_WORDS, collapse_runs, no_punctuation, runs_of, squeeze, term_counts, words


def normalise(c: str, strategy: str = "none") -> Column:
    """none; lower+strip_punct; spellfix_light (also collapses runs of letters)."""
    if strategy == "none":
        return F.col(c)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return plain if strategy == "lower+strip_punct" else F.regexp_replace(plain, r"(.)\1{2,}", "$1$1")


def kept_words(c: str) -> Column:
    """Words of two or more characters without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda x: ~x.isin(*STOP_WORDS))


def word_terms(c: str) -> Column:
    """Words of two or more characters without stop words, and their neighbouring pairs."""
    w = kept_words(c)
    return F.concat(w, runs_of(w, 2, " "))


def char_terms(c: str, low: int = 3, high: int = 5) -> Column:
    """Character n-grams within words, each word between spaces."""
    padded = F.transform(words(F.lower(c)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(n: int) -> Column:
        def of(w: Column) -> Column:
            return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(padded, of))

    return F.concat(*(grams(n) for n in range(low, high + 1)))


TERMS = {"bm25": word_terms, "dense": char_terms}


def document_terms(docs: DataFrame, kind: str) -> DataFrame:
    """(doc, term, tf), counted where the document's text was dealt to; character n-grams are cut once a distinct word of it."""
    if kind != "dense":
        return term_counts(docs, "doc", TERMS[kind]("_text"))
    own = term_counts(docs, "doc", words(F.lower("_text"))).select("doc", F.explode(char_terms("term")).alias("gram"), "tf")
    return own.groupBy("doc", F.col("gram").alias("term")).agg(F.sum("tf").alias("tf"))


#: Terms whose weights are broadcast (a larger vocabulary is joined); asking (query, term) rows that are scored as a matrix (more are joined); cells of such a matrix.
VOCABULARY, ASKING, CELLS = 1_000_000, 400_000, 4_000_000
#: Bytes of text whose terms are weighed in one task.
BUCKET = 6_500_000
#: The session's largest k that is kept a task; retrieve() raises it.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


class Index:
    """What retrieval needs of a column of documents (each key once): its texts as words, the number of documents, and how long tf-idf vectors are.

    For character n-grams of a small vocabulary (grams: their keys and numbers
    of documents) lengths are found with the scores; else they are a written
    table (doc, dn). Terms are 64-bit numbers there. tables() has the terms
    themselves.
    """

    def __init__(self, docs: DataFrame, root: str, kind: str):
        spark = docs.sparkSession
        self.docs, self.root, self.kind, self.spark = docs, root, kind, spark
        text = F.lower("_text") if kind == "dense" else F.array_join(kept_words("_text"), " ")
        few = docs.rdd.getNumPartitions() < 4 * spark.sparkContext.defaultParallelism
        self.texts = (docs.repartition(4 * spark.sparkContext.defaultParallelism) if few else docs).select("doc", text.alias("_text"))
        if kind != "dense":  # words are cut once
            self.texts = self.written(self.texts, "texts")
        row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("size")).first()
        self.n, self.grams, self.norms, self._tables = row["n"], None, None, None
        if kind == "dense":
            known = self.texts.mapInArrow(postings.document_numbers(kind), "key long, df long").groupBy("key").agg(F.sum("df").alias("df"))
            got = self.written(known, "numbers").limit(VOCABULARY + 1).toArrow()
            if got.num_rows <= VOCABULARY:
                key = got.column("key").to_numpy().view(np.uint64)
                order = np.argsort(key)
                self.grams = key[order], got.column("df").to_numpy()[order]
        if self.grams is None:
            bits = min(16, max(0, row["size"] // BUCKET).bit_length())
            doc = docs.schema["doc"].dataType.simpleString()
            lots = self.texts.mapInArrow(postings.dealt(kind, bits), f"bucket int, docs array<{doc}>, at array<int>, keys array<long>, tf array<int>")
            part = lots.groupBy("bucket").applyInArrow(postings.squares(self.n), f"doc {doc}, part double")
            self.norms = self.written(part.groupBy("doc").agg(F.sqrt(F.sum("part")).alias("dn")), "lengths")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(doc, term, tf), (term, idf) and (doc, dn), written when they are first asked for."""
        if self._tables is None:
            counts = self.written(document_terms(self.docs, self.kind), "counts")
            idf = self.written(counts.groupBy("term").agg((F.log((1 + F.lit(self.n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf")), "idf")
            weight = F.col("tf") * F.col("idf")
            self._tables = counts, idf, self.written(counts.join(_sized(idf), "term").groupBy("doc").agg(F.sqrt(F.sum(weight * weight)).alias("dn")), "norms")
        return self._tables

    def scores(self, asked: list[tuple], q_type, k: int) -> DataFrame:
        """(q, doc, score) of at least the first k of each query of [(q, term, tf)]."""
        spark, context = self.spark, self.spark.sparkContext
        key = postings.term_keys([t for _, t, _ in asked], self.kind)
        own, place = np.unique(key, return_inverse=True)
        if self.grams is not None:
            keys, numbers = self.grams
            at, hit = postings.found(keys, own)
            df = np.where(hit, numbers[at] if len(numbers) else 0, 0)
        else:
            got = self.texts.mapInArrow(postings.document_numbers(self.kind, context.broadcast(own)), "key long, df long").groupBy("key").agg(F.sum("df").alias("df")).toArrow()
            df = np.zeros(len(own), np.int64)
            df[np.searchsorted(own, got.column("key").to_numpy().view(np.uint64))] = got.column("df").to_numpy()
            keys, numbers, at = own, df, np.arange(len(own))
        idf = np.where(df > 0, postings.idf(df, self.n), 0.0)
        names = sorted({q for q, _, _ in asked})
        number = {q: i for i, q in enumerate(names)}
        query = np.array([number[q] for q, _, _ in asked])
        tf = np.array([n for _, _, n in asked], float)
        qn = np.sqrt(np.bincount(query, np.square(tf * idf[place]), len(names)))
        some = np.flatnonzero(df[place] > 0)  # terms of no document have no part in a query's vector
        term = at[place[some]]
        order = np.argsort(term, kind="stable")
        first = np.searchsorted(term[order], np.arange(len(keys) + 1))
        value = (tf * idf[place] ** 2)[some][order]
        names = pa.array(names, to_arrow_type(q_type))
        shared = context.broadcast((names, keys, np.square(postings.idf(numbers, self.n)), first, query[some][order], value, np.where(qn > 0, qn, 1.0), self.norms is not None))
        rows = self.texts
        if self.norms is not None:
            rows = rows.join(F.broadcast(self.norms) if self.n <= VOCABULARY else self.norms, "doc")  # a number a document
        # each task gives the first k of every query, so there are no more tasks than run at once
        return rows.coalesce(context.defaultParallelism).mapInArrow(postings.ranked(self.kind, shared, k, CELLS), f"q {q_type.simpleString()}, doc {rows.schema['doc'].dataType.simpleString()}, score double")


def index(docs: DataFrame, key: str, column: str, kind: str = "bm25", folder: str | None = None) -> Index:
    """Builds the index of a column below the folder (by default one that the cluster shares); it serves any number of queries."""
    root = f"{(folder or shared_folder(docs.sparkSession)).rstrip('/')}/index-{kind}-{uuid.uuid4().hex}"
    return Index(docs.select(F.col(key).alias("doc"), F.col(column).alias("_text")), root, kind)


def _sized(idf: DataFrame) -> DataFrame:
    """The term table, broadcast while it is small."""
    return F.broadcast(idf) if idf.limit(VOCABULARY + 1).count() <= VOCABULARY else idf


def retrieve(queries: DataFrame, docs: DataFrame | Index, kind: str = "bm25", k: int = 10, qkey: str = "qid", dkey: str = "doc_id", qtext: str = "query", dtext: str = "text") -> DataFrame:
    """(qid, doc_id, score, rank): the k documents of largest tf-idf cosine; only shared terms meet, ties go to the smaller id.

    docs may be an Index. A query set of at most ASKING distinct (query, term)
    rows is scored text by text, as products of matrices, and a task keeps the
    first k of each query; a larger one is joined by term.
    """
    own = docs if isinstance(docs, Index) else index(docs, dkey, dtext, kind)
    asked = queries.select(F.col(qkey).alias("q"), F.explode(TERMS[own.kind](qtext)).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("tf"))
    few = asked.limit(ASKING + 1).collect()
    if len(few) <= ASKING:
        scored = own.scores([(r["q"], r["term"], r["tf"]) for r in few], queries.schema[qkey].dataType, k).select("q", "doc", F.round("score", 6).alias("score"))
    else:
        counts, idf, norms = own.tables()
        ask = asked.join(idf, "term").withColumn("qw", F.col("tf") * F.col("idf")).select("q", "term", "idf", "qw")
        qn = ask.groupBy("q").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
        dot = counts.join(ask, "term").groupBy("q", "doc").agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot"))
        scored = dot.join(norms, "doc").join(qn, "q").select("q", "doc", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score"))
    spark = queries.sparkSession
    if int(spark.conf.get(GROUP_LIMIT)) < k:  # each task keeps the first k of a query before a shuffle; beyond this limit Spark would sort all scores of a query in one task
        spark.conf.set(GROUP_LIMIT, str(k))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("q").alias(qkey), F.col("doc").alias(dkey), "score", "rank")


def retrieve_local(df: DataFrame, strategy: str = "bm25@10", query: str = "query", docs: str = "docs") -> DataFrame:
    """Adds retrieved (texts) and retrieval_scores: a row's own documents by the number of distinct query words that each has.

    The strategy is a name and a depth. Ties keep the documents' order; a single
    text is a list of one; without a documents column both lists are empty.
    """
    depth = int(strategy.partition("@")[2]) if strategy.partition("@")[2].isdigit() else 10
    texts, numbers = F.array().cast("array<string>"), F.array().cast("array<double>")
    if docs not in df.columns or query not in df.columns:
        return df.withColumns({"retrieved": texts, "retrieval_scores": numbers})
    is_list = df.schema[docs].dataType.typeName() == "array"
    held = F.coalesce(F.col(docs), texts) if is_list else F.when(F.col(docs).isNotNull(), F.array(docs)).otherwise(texts)
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    asked = tokens(F.coalesce(F.col(query), F.lit("")))

    def scored(text: Column, i: Column) -> Column:
        own = tokens(F.coalesce(text, F.lit("")))
        hits = F.size(F.filter(asked, lambda w: F.array_contains(own, w))).cast("double")
        return F.struct((-hits).alias("s"), i.alias("i"), text.alias("t"))

    best = F.slice(F.array_sort(F.transform(held, scored)), 1, depth)
    return df.withColumn("_best", best).withColumns({"retrieved": F.transform("_best", lambda x: x["t"]), "retrieval_scores": F.transform("_best", lambda x: -x["s"])}).drop("_best")


def fuse(a: DataFrame, b: DataFrame, k: int = 10, qkey: str = "qid", dkey: str = "doc_id", base: int = 60) -> DataFrame:
    """Reciprocal ranks of two rankings added."""
    x = a.select(qkey, dkey, F.col("rank").alias("ra"))
    y = b.select(qkey, dkey, F.col("rank").alias("rb"))
    part = lambda c: F.coalesce(1.0 / (base + F.col(c)), F.lit(0.0))
    both = x.join(y, [qkey, dkey], "full").select(qkey, dkey, F.round(part("ra") + part("rb"), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), dkey))
    return both.withColumn("rank", place).where(F.col("rank") <= k)


def rerank(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10, qkey: str = "qid", dkey: str = "doc_id", qtext: str = "query", dtext: str = "text") -> DataFrame:
    """The first k of each query in the order of a tf-idf cosine whose document frequencies are local to the query's k documents."""
    first = found.where(F.col("rank") <= k).select(qkey, dkey)
    d = first.join(docs.select(dkey, F.col(dtext).alias("_d")), dkey).select(qkey, dkey, F.explode(word_terms("_d")).alias("term")).groupBy(qkey, dkey, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = first.groupBy(qkey).agg(F.count(F.lit(1)).alias("n"))
    idf = d.groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("df")).join(n, qkey).select(qkey, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = d.join(idf, [qkey, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = w.groupBy(qkey, dkey).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    q = queries.select(qkey, F.explode(word_terms(qtext)).alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("qtf")).join(idf, [qkey, "term"]).select(qkey, "term", (F.col("qtf") * F.col("idf")).alias("qw"))
    qn = q.groupBy(qkey).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dot = w.join(q, [qkey, "term"]).groupBy(qkey, dkey).agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    score = F.coalesce(F.col("dot") / (F.col("dn") * F.col("qn")), F.lit(0.0))
    full = first.join(norm, [qkey, dkey], "left").join(qn, qkey, "left").join(dot, [qkey, dkey], "left").select(qkey, dkey, F.round(score, 6).alias("score"))
    return full.withColumn("rank", F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), dkey)))


def context(found: DataFrame, docs: DataFrame, budget: int, n: int = 5, unit: str = "chars", strategy: str = "fixed_chunk_top", qkey: str = "qid", dkey: str = "doc_id", dtext: str = "text") -> DataFrame:
    """(qid, context, n_docs): the first n documents while they fit the budget of tokens or characters.

    mmr_diverse takes every other document first. The sum only grows, so the
    first that does not fit ends the context. A query whose first document
    does not fit has an empty context.
    """
    size = F.length("_d") if unit == "chars" else F.size(words(F.col("_d")))
    rows = found.where(F.col("rank") <= n).join(docs.select(dkey, F.col(dtext).alias("_d")), dkey).withColumn("_n", size)
    order = F.col("rank") if strategy == "fixed_chunk_top" else F.when(F.col("rank") % 2 == 1, F.col("rank")).otherwise(F.col("rank") + 100_000)
    upto = F.sum("_n").over(Window.partitionBy(qkey).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumns({"_o": order, "_u": upto})
    held = F.filter(F.array_sort(F.collect_list(F.struct("_o", "_u", "_d"))), lambda x: x["_u"] <= budget)
    return kept.groupBy(qkey).agg(held.alias("_h")).select(qkey, F.array_join(F.transform("_h", lambda x: x["_d"]), "\n\n").alias("context"), F.size("_h").alias("n_docs"))


def diverse_context(found: DataFrame, docs: DataFrame, budget: int, n: int = 10, overlap: float = 0.6, qkey: str = "qid", dkey: str = "doc_id", dtext: str = "text") -> DataFrame:
    """(qid, context, n_docs): the first n documents in order, without those of whose distinct words more than `overlap` are in one taken before; the last is cut to the budget of characters."""
    kind = found.schema[qkey].dataType.simpleString()
    rows = found.where(F.col("rank") <= n).join(docs.select(dkey, F.col(dtext).alias("_d")), dkey).where(F.length("_d") > 0)
    lists = rows.groupBy(qkey).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_d"))), lambda x: x["_d"]).alias("_l"))  # n texts a query

    def build(batches):
        for batch in batches:
            texts, counts = [], []
            for own in batch.column("_l").to_pylist():
                taken, kept, size = [], [], 0
                for text in own:
                    words = set(text.split())
                    if size >= budget or any(len(words & other) > overlap * max(1, len(words)) for other in taken):
                        continue
                    kept.append(text[: budget - size])
                    taken.append(words)
                    size += len(kept[-1])
                texts.append("\n\n".join(kept))
                counts.append(len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(qkey), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[qkey, "context", "n_docs"])

    return lists.mapInArrow(build, f"{qkey} {kind}, context string, n_docs int")


def answer(query: str, ctx: str, strategy: str = "concise") -> Column:
    """A template: the first 40 (concise) or 120 (detailed) context words, and up to 8 key words of the query."""
    n = 40 if strategy == "concise" else 120
    keys = F.slice(F.filter(F.array_distinct(words(F.lower(query))), lambda w: ~w.isin(*STOP_WORDS)), 1, 8)
    return F.format_string("%s [key words: %s]", F.array_join(F.slice(words(F.col(ctx)), 1, n), " "), F.array_join(keys, ", "))


def grounding(query: str, ctx: str) -> Column:
    """Share of the query's tokens that the context holds."""
    q = F.array_distinct(words(F.lower(query)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, F.array_distinct(words(F.lower(ctx))))).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def rewrite(c: str, strategy: str = "none") -> Column:
    """prefix marks a translation, suffix asks for key words, dual holds both."""
    if strategy == "prefix":
        return F.concat(F.lit("[EN_TRANSLATED] "), F.col(c))
    if strategy == "suffix":
        return F.concat(F.col(c), F.lit(" (keywords)"))
    return F.concat(F.col(c), F.lit(" || [EN_TRANSLATED] "), F.col(c)) if strategy == "dual" else F.col(c)


def recall(found: DataFrame, truth: DataFrame, k: int = 10, qkey: str = "qid", dkey: str = "doc_id") -> DataFrame:
    """(qid, recall): share of the relevant documents among the first k."""
    hit = found.where(F.col("rank") <= k).select(qkey, dkey, F.lit(1).alias("_hit"))
    return truth.select(qkey, dkey).distinct().join(hit, [qkey, dkey], "left").groupBy(qkey).agg(F.round(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), 6).alias("recall"))


def quoting(docs: DataFrame, items: DataFrame, qkey: str = "qid", dkey: str = "doc_id", qtext: str = "query", dtext: str = "text", width: int = 5, shortest: int = 10_000) -> DataFrame:
    """(qid, doc_id): documents whose text contains the whole item.

    A document that quotes an item has all its inner words, between the first
    and the last, one after another. So pairs meet on a run of up to `width`
    inner words of the item, and only they are compared. Items of one or two
    words have no inner word; they are compared with all documents, and more
    than `shortest` of them are an error. An empty item is in every document
    that has a text.
    """
    inner = lambda c: F.slice(words(c), F.lit(2), F.greatest(F.size(words(c)) - 2, F.lit(0)))
    asked = items.select(F.col(qkey).alias("_q"), F.col(qtext).alias("_item")).where(F.col(qtext).isNotNull()).withColumn("_w", inner("_item"))
    asked = asked.withColumn("_n", F.least(F.size("_w"), F.lit(width)))
    anchored = asked.where("_n > 0").withColumn("_run", F.array_min(runs_of_size("_w", F.col("_n")))).select("_q", "_item", "_n", "_run")
    sizes = [r["_n"] for r in anchored.select("_n").distinct().collect()]  # at most `width` numbers
    texts = docs.select(F.col(dkey).alias("_d"), F.col(dtext).alias("_text")).where(F.col(dtext).isNotNull())
    found = None
    for n in sizes:
        runs = texts.select("_d", F.explode(F.array_distinct(runs_of(words("_text"), n, " "))).alias("_run"))
        near = runs.join(anchored.where(F.col("_n") == n), "_run").select("_d", "_q", "_item").distinct()
        found = near if found is None else found.unionByName(near)
    out = None
    if found is not None:
        out = found.join(texts, "_d").where(F.contains("_text", "_item")).select(F.col("_q").alias(qkey), F.col("_d").alias(dkey))
    short = asked.where("_n = 0").select("_q", "_item")
    many = short.limit(shortest + 1).count()
    if many > shortest:
        raise ValueError(f"more than {shortest} items of one or two words")
    if many:
        plain = texts.join(F.broadcast(short), F.contains("_text", "_item")).select(F.col("_q").alias(qkey), F.col("_d").alias(dkey))  # a table of checked size
        out = plain if out is None else out.unionByName(plain)
    return (out if out is not None else texts.join(short, F.lit(False)).select(F.col("_q").alias(qkey), F.col("_d").alias(dkey))).distinct()


def runs_of_size(c: str, n: Column) -> Column:
    """Runs of n neighbouring items of an array, n being a column."""
    return F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(F.col(c), i, n), " "))


def score_profile(found: DataFrame, qkey: str = "qid", k: int = 10) -> DataFrame:
    """(qid, max_softmax, score_spread): the largest share of the first k scores under softmax, and their variance about their mean."""
    s = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    lists = found.where(F.col("rank") <= k).groupBy(qkey).agg(s.alias("_s"))
    top = F.array_max("_s")
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    mean = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / F.size("_s")
    spread = F.aggregate("_s", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size("_s")
    return lists.select(qkey, F.round(1 / total, 6).alias("max_softmax"), F.round(spread, 6).alias("score_spread"))


def foreign_share(c: str) -> Column:
    """Share of the tokens that are not words of a-z and apostrophes."""
    w = words(F.lower(c))
    return F.round(F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: ~x.rlike(r"^[a-z']+$"))).cast("double"), F.size(w).cast("double")), F.lit(0.0)), 6)


def query_profile(queries: DataFrame, found: DataFrame, qkey: str = "qid", qtext: str = "query", k: int = 10) -> DataFrame:
    """Non-ASCII token and character shares, and gap and variance of the first k scores."""
    w = words(F.col(qtext))
    texts = queries.select(qkey, F.round(F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: x.rlike(r"[^\x00-\x7F]"))).cast("double"), F.size(w).cast("double")), F.lit(0.0)), 6).alias("foreign_tokens"), F.round(F.coalesce(F.try_divide(F.length(F.regexp_replace(qtext, r"[\x00-\x7F]", "")).cast("double"), F.length(qtext).cast("double")), F.lit(0.0)), 6).alias("unicode_share"))
    first = found.where(F.col("rank") <= k).groupBy(qkey).agg(F.round(F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)), 6).alias("gap"), F.round(F.var_pop("score"), 4).alias("score_variance"))
    return texts.join(first, qkey, "left")


__all__ = ["Index", "answer", "char_terms", "collapse_runs", "context", "diverse_context", "foreign_share", "fuse", "grounding", "index", "no_punctuation", "normalise", "query_profile", "quoting", "recall", "rerank", "retrieve", "retrieve_local", "rewrite", "score_profile", "squeeze", "word_terms"]
