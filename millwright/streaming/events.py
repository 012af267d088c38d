"""Streams: windows with watermarks, first-seen filter, drift. An extension; every result has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..data import shared_folder


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum by window and type; the same plan serves a batch frame, where the watermark has no effect."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    out = timed.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, key: str, order: str = "event_id", horizon: str | None = None) -> DataFrame:
    """The first event of each key. A batch takes the smallest order.

    A stream keeps one flag a key, for ever unless a horizon is given: then
    state is kept for that span of event time only, and a key that comes back
    later counts as new.
    """
    if not events.isStreaming:
        lowest = events.groupBy(key).agg(F.min(order).alias(order))
        return events.join(lowest, [key, order], "left_semi").select(key, order)
    if horizon is not None:
        return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark([key]).select(key, order)

    def once(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low = min(b[order].min() for b in batches)
        if not state.exists:
            state.update((True,))
            yield pd.DataFrame({key: [k[0]], order: [int(low)]})

    return events.groupBy(key).applyInPandasWithState(once, f"{key} long, {order} long", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def drift(events: DataFrame, value: str = "value", every: str = "1 day") -> DataFrame:
    """Mean and deviation of each window, for comparison with the next."""
    timed = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    out = timed.groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(F.col("w.start").alias("start"), "n", "mean", "std")


def replay(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its result, which each micro-batch writes to a folder of its own in the shared one.

    A batch that is run again replaces what it wrote. In complete mode the last
    batch has the whole result.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/replay-{name}-{uuid.uuid4().hex}"
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number:012d}")
        done.append(number)

    query = stream.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/state").start()
    query.awaitTermination()
    parts = sorted(set(done)) if mode == "append" else sorted(set(done))[-1:]
    if not parts:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{root}/out/{n:012d}" for n in parts))
