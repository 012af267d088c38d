"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, licenses, mixing, neardup, pii, quality, rules, urls

#: Key of the pseudonyms; a deployment sets its own.
PII_KEY = b"millwright demonstration key"
#: Target weights of the mix over the domains that documents.lang labels.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
_WORDS = r"'[^\x20\x09-\x0D]+'"


def tokenizer_path() -> str:
    """The byte-level BPE file of the installed tokenizer files."""
    return importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def labelled_domains(docs: DataFrame) -> DataFrame:
    """The labelled table of the mix: documents whose lang is known."""
    return docs.select("doc_id", "text", F.col("lang").alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.mix(spark, docs, labelled_domains(docs), TARGETS)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, _table(spark, sf_dir, "embeddings"))


OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.r = l.x),
k AS (SELECT doc_id, min(r) AS component_id FROM r GROUP BY doc_id)
SELECT k.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id, k.doc_id = k.component_id AS kept
FROM k LEFT JOIN n ON n.doc_id = k.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_pii, op3_bpe, op4_minhash_near_dedup, op5_url_filters, op6_mixing, op7_quality_classifier, op8_license_scans, op9_language_id, op10_nearest_neighbours)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": rules.sql(), "op4_minhash_near_dedup": OP4_SQL, "op5_url_filters": urls.sql(), "op8_license_scans": licenses.sql()}
