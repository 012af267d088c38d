"""A training-data pipeline of five corpus operators, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import bpe, mixing, neardup, pii, quality
from millwright.llm.queries import PII_KEY, TARGETS, labelled_domains, tokenizer_path
from millwright.llm.store import Scratch


_OWN = ("doc_id", "text")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one, so that no name meets an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in _OWN]
    return docs.select(*_OWN, (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order and types."""
    return rows.select(*((F.col(c) if c in _OWN else F.col("_rest")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws."""
    model = quality.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(quality.draw(spark, _packed(docs), model).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component; of rows that repeat, one."""
    kept = neardup.near_duplicates(spark, docs).where("kept").select("doc_id").distinct()
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        out = out.withColumn("_near_dedup", digest).dropDuplicates(["doc_id", "_near_dedup"]).drop("_near_dedup")
    return out


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    out = _unpacked(pii.replaced(_packed(docs), PII_KEY), docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix wants them."""
    model = mixing.fit(spark, docs, labelled_domains(docs), TARGETS)
    rated = mixing.rate(spark, _packed(docs), model).where("copies > 0")
    return _unpacked(rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("pii", pseudonyms),
    ("mixing", mixture),
    ("bpe", encoded),
]
#: Gumbel keys, keyed permutations and the descent have no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
