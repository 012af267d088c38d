"""Retrieval for question answering as a plan: normaliser, retriever, reranker, context, generator, and steps that may be inserted."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data import shared_folder
from ..operators import retrieval as R

#: Strategies of each step by 1-based place, a name and a depth or budget (fixed values).
STRATEGIES: dict[str, tuple[str, ...]] = {
    "query_normalizer": ("none", "lower+strip_punct", "spellfix_light"),
    "retriever": ("bm25@10", "bm25@20", "dense@10", "dense@20", "hybrid_rrf@10", "hybrid_rrf@20"),
    "reranker": ("none", "cross_encoder@20", "cross_encoder@50"),
    "context_builder": ("fixed_chunk_top@1500", "fixed_chunk_top@3000", "mmr_diverse@1500", "mmr_diverse@3000"),
    "generator": ("grounded_concise", "grounded_detailed"),
    "translator_rewriter": ("none", "prefix", "suffix", "dual"),
    "lang_retrieval_wrapper": ("none", "rrf"),
}
ORDER = ("query_normalizer", "retriever", "reranker", "context_builder", "generator")
INSERTED = ("translator_rewriter", "lang_retrieval_wrapper")


@dataclass(frozen=True)
class Answering:
    """A plan as strategies by step; steps without one take the first. Inserted steps do nothing unless named."""

    strategies: dict[str, str]

    def of(self, step: str) -> str:
        found = self.strategies.get(step, STRATEGIES[step][0])
        if found not in STRATEGIES[step]:
            raise ValueError(f"unknown strategy {step}/{found}")
        return found


def from_vector(vector: tuple[int, ...], order: tuple[str, ...] = ORDER) -> Answering:
    """Places outside 1 .. n become the nearest one."""
    return Answering({s: STRATEGIES[s][min(max(1, v), len(STRATEGIES[s])) - 1] for s, v in zip(order, vector, strict=True)})


#: Documents of each ranking that a fusion reads.
FUSED = 2000


class Corpus:
    """Documents with their two indexes, built when a plan first needs them, and the rankings that plans share."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", indexes: dict[str, R.Index] | None = None):
        self.docs, self.key, self.text, self.indexes = docs, key, text, dict(indexes or {})
        self.rankings: list[tuple[str, DataFrame, DataFrame]] = []

    def index(self, kind: str) -> R.Index:
        if kind not in self.indexes:
            self.indexes[kind] = R.index(self.docs, self.key, self.text, kind)
        return self.indexes[kind]

    def ranking(self, queries: DataFrame, kind: str) -> DataFrame:
        """(qid, doc_id, score, rank) of the first FUSED documents, written once for equal queries; shallower plans read its beginning."""
        for known, asked_, table in self.rankings:
            if known == kind and asked_.sameSemantics(queries):
                return table
        spark = self.docs.sparkSession
        ranked = R.retrieve(queries, self.index(kind), k=FUSED)
        path = f"{shared_folder(spark)}/ranking-{uuid.uuid4().hex}"
        ranked.write.parquet(path)
        self.rankings.append((kind, queries, spark.read.schema(ranked.schema).parquet(path)))
        return self.rankings[-1][2]


def _depth(strategy: str) -> tuple[str, int]:
    name, _, depth = strategy.partition("@")
    return name, int(depth or 10)


def asked(plan: Answering, queries: DataFrame) -> DataFrame:
    """(qid, query): rewritten, if that step is inserted, then normalised."""
    out = queries.select("qid", R.rewrite("query", plan.of("translator_rewriter")).alias("query"))
    return out.select("qid", R.normalise("query", plan.of("query_normalizer")).alias("query"))


def found(plan: Answering, queries: DataFrame, corpus: Corpus) -> DataFrame:
    """(qid, doc_id, score, rank) after retrieval and reranking."""
    kind, k = _depth(plan.of("retriever"))
    if plan.of("lang_retrieval_wrapper") == "rrf":  # whatever the language: both indexes, fused
        kind = "hybrid_rrf"
    if kind == "hybrid_rrf":
        first = R.fuse(corpus.ranking(queries, "bm25"), corpus.ranking(queries, "dense"), k)
    else:
        first = corpus.ranking(queries, kind).where(F.col("rank") <= k)
    reranker, depth = _depth(plan.of("reranker"))
    return first if reranker == "none" else R.rerank(first, queries, corpus.docs.select(F.col(corpus.key).alias("doc_id"), F.col(corpus.text).alias("text")), min(depth, k))


def run(plan: Answering, queries: DataFrame, corpus: Corpus) -> DataFrame:
    """(qid, context, n_docs, answer) of each query that finds a document."""
    rows = asked(plan, queries)
    hits, docs = found(plan, rows, corpus), corpus.docs.select(F.col(corpus.key).alias("doc_id"), F.col(corpus.text).alias("text"))
    builder, budget = _depth(plan.of("context_builder"))
    held = R.diverse_context(hits, docs, budget, 20) if builder == "mmr_diverse" else R.context(hits, docs, budget, 20)
    detailed = "detailed" if plan.of("generator") == "grounded_detailed" else "concise"
    return held.join(rows, "qid").withColumn("answer", R.answer("query", "context", detailed)).select("qid", "context", "n_docs", "answer")


def utility(plan: Answering, queries: DataFrame, corpus: Corpus, truth: DataFrame, k: int = 10) -> float:
    """1 - mean recall of the relevant documents among the first k, over the queries that have one; lower is better."""
    got = R.recall(found(plan, asked(plan, queries), corpus), truth, k).agg(F.avg("recall")).first()[0]
    return 1.0 if got is None else round(1 - got, 6)
