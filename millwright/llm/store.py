"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset on a single machine, as in tests, a local folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="millwright-")
        spark.conf.set("spark.checkpoint.dir", found)
        weakref.finalize(spark.sparkContext, shutil.rmtree, found[7:], True)
    return found.rstrip("/")


class Scratch:
    """Writes tables below the shared folder; a written table has no lineage to recompute.

    A lazy result may read them as long as the session lives, so they are
    removed when the driver's program ends, or earlier by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._end)

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later frame reads."""
        for t in tables:
            self._delete(t._scratch_path)


#: Rows and bytes of an Arrow batch of texts, which bound what a Python worker and the JVM beside it hold at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to sizes that suit texts; lower settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id and text only."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_columns(df: DataFrame, of: Callable[[pa.RecordBatch], list[pa.Array]], fields: str) -> DataFrame:
    """df and, after its columns, those that `of` gives for each Arrow batch."""
    small_batches(df.sparkSession)
    more = _parse_datatype_string(fields)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *of(batch)], names=[*batch.schema.names, *names])

    names = more.names
    return df.mapInArrow(run, StructType([*df.schema.fields, *more.fields]))
