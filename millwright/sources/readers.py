"""Readers and writers of the formats that pipelines meet."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType, TimestampNTZType, TimestampType

from ..functions.quantiles import quantiles
from ..operators.features import classes, label_code, missing_ratios


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "ISO-8859-1", sep: str = ",") -> DataFrame:
    """With a header; bad lines are dropped; the schema is inferred unless given."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_any(spark: SparkSession, path: str, **how) -> DataFrame:
    """By extension: csv, json (lines), parquet, orc; xls and hdf5 through pandas where it can read them."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if kind in ("csv", "txt"):
        return read_csv(spark, path, **how)
    if kind in ("json", "jsonl"):
        return spark.read.json(path, **how)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path, **how)
    if kind in ("xls", "xlsx", "h5"):
        import pandas as pd

        return spark.createDataFrame(pd.read_hdf(path) if kind == "h5" else pd.read_excel(path))
    raise ValueError(f"unknown format: {path}")


def train_test(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Two files cut to their common columns, in the order of the first."""
    a, b = read_any(spark, train), read_any(spark, test)
    both = [c for c in a.columns if c in b.columns]
    return a.select(*both), b.select(*both)


def task(df: DataFrame, target: str) -> str:
    """classification for text or at most two values, else regression."""
    if isinstance(df.schema[target].dataType, StringType):
        return "classification"
    return "classification" if df.select(target).where(F.col(target).isNotNull()).distinct().limit(3).count() <= 2 else "regression"


def csv_to_parquet(spark: SparkSession, source: str, target: str, **how) -> None:
    read_csv(spark, source, **how).write.mode("overwrite").option("compression", "snappy").parquet(target)


def encode_union(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text columns of both frames to codes over the sorted union of their values."""
    texts = [f.name for f in train.schema.fields if isinstance(f.dataType, StringType)]
    known = {c: classes(train.select(c).union(test.select(c)), c) for c in texts}
    out = {c: label_code(c, v) for c, v in known.items()}
    return (train.withColumns(out), test.withColumns(out)) if out else (train, test)


def drop_sparse(df: DataFrame, most: float = 0.4) -> DataFrame:
    """Without the columns of which more than this share is missing."""
    return df.drop(*(c for c, r in missing_ratios(df).items() if r > most))


def explode_lists(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """List cells to columns c_item<i>, as many as the 90th percentile of lengths."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType)]
    sizes = quantiles(df.select(*(F.when(F.col(c).isNotNull(), F.size(c)).alias(c) for c in names)), names, [0.9])
    for c in names:
        df = df.withColumns({f"{c}_item{i}": F.get(c, F.lit(i)) for i in range(int(sizes[c][0] or 0))}).drop(c)
    return df


def date_parts(c: str) -> dict[str, Column]:
    """Seconds since 2017, year, month, day, weekday (Monday 0) and fractional hour, all as doubles."""
    t = F.col(c).cast("timestamp")
    seconds = (F.unix_micros(t) - F.unix_micros(F.lit("2017-01-01 00:00:00").cast("timestamp"))) / 1e6
    hour = F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600
    parts = {"TIMESTAMP": seconds, "YEAR": F.year(t), "MONTH": F.month(t), "DAY": F.day(t), "DAYOFWEEK": F.weekday(t), "HOUR": hour}
    return {f"{c}_{k}": x.cast("double") for k, x in parts.items()}


def explode_dates(df: DataFrame) -> DataFrame:
    for c in [f.name for f in df.schema.fields if isinstance(f.dataType, (TimestampType, TimestampNTZType))]:
        df = df.withColumns(date_parts(c)).drop(c)
    return df


def passages(topics: DataFrame) -> DataFrame:
    """(query_id, docid, title, text, relevance) from topics with lists of positive and negative passages."""
    def side(name: str, relevance: int) -> DataFrame:
        return topics.select("query_id", F.explode(name).alias("p")).select("query_id", "p.docid", "p.title", "p.text", F.lit(relevance).alias("relevance"))

    return side("positive_passages", 1).unionByName(side("negative_passages", 0))


def product_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Lines of literal dictionaries or JSON: five fields of the products whose brand no earlier batch has.

    Batches are the pieces in which the input is read, in order of file and
    place (spark.sql.files.maxPartitionBytes sets their size). Products without
    a brand are left out.
    """
    schema = "asin string, title string, price double, brand string, categories array<array<string>>"
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(F.from_json("value", schema, {"allowSingleQuotes": "true"}).alias("x"), at.alias("_batch")).select("x.*", "_batch").where("brand is not null and brand <> ''")
    first = lines.groupBy("brand").agg(F.min("_batch").alias("_first"))
    return lines.join(first, "brand").where(F.col("_batch") == F.col("_first")).select("asin", "title", "price", "brand", "categories")


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """History, profile, similarity and metric tables with a header; lists become JSON text."""
    wide = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, StructType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*wide).write.mode(mode).option("header", True).csv(path)


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def write_runs(runs: DataFrame, path: str) -> None:
    """One JSON object a line."""
    runs.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def good_bad_counts(runs: DataFrame, parameters: list[str], result: str = "result") -> DataFrame:
    """(param, value, good, bad) over all runs; a result is good if it is true or the text 'True'."""
    ok = F.lower(F.col(result).cast("string")) == "true"
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in parameters)))
    return runs.select(pairs.alias("x"), ok.alias("ok")).groupBy("x.param", "x.value").agg(F.count_if(F.col("ok")).alias("good"), F.count_if(~F.col("ok")).alias("bad"))
