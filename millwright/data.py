"""Tables by name, and the roles of their columns."""

from __future__ import annotations

import re
import shutil
import tempfile
import weakref
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset on a single machine a local folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="millwright-")
        spark.conf.set("spark.checkpoint.dir", found)
        weakref.finalize(spark.sparkContext, shutil.rmtree, found[7:], True)
    return found.rstrip("/")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Roles:
    """What the columns of a frame are for. Label and sensitive attribute stay columns of the same frame."""

    target: str | None = None
    sensitive: str | None = None
    row_id: str | None = None
    exclude: tuple[str, ...] = field(default=())
    categorical: tuple[str, ...] = field(default=())

    def kept_out(self) -> set[str]:
        return {c for c in (self.target, self.sensitive, self.row_id, *self.exclude, *self.categorical) if c}


def numeric_columns(df: DataFrame, roles: Roles = Roles()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in roles.kept_out()]


def text_columns(df: DataFrame, roles: Roles = Roles()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in roles.kept_out()]


def without_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One missing concept: NaN and infinities become NULL."""
    found = columns if columns is not None else [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in found}) if found else df
