"""Streaming variants: windows over events with late data, upserts, merged facts, and interval maps in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.intervals import IntervalMap
from quillstone.sources.sinks import upsert_parquet


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Events of Parquet files as they arrive in a folder."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): counts and sums of windows; later data than ``late`` is dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): a user's events no more than ``gap`` apart."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_stream(rows: DataFrame, target: str, keys: list[str], position: str, checkpoint: str):
    """Each batch merged into the table at ``target``; a batch that runs again changes nothing."""
    spark = rows.sparkSession
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert_parquet(spark, target, batch, keys, position)).trigger(availableNow=True).start()


def interval_state(rows: DataFrame) -> DataFrame:
    """(key, n_periods, n_gaps, covered_days) after each batch that touched a key. ``rows``: (key string, start int, end int), a stream.

    The state of a key is its ordered disjoint intervals; insertions of a batch fuse into it by binary search.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = IntervalMap()
        if state.exists:
            held.starts, held.ends = (list(x) for x in state.get)
            held.many = [False] * len(held.starts)
        for b in batches:
            for s, e in zip(b["start"], b["end"]):
                if pd.notna(s) and pd.notna(e) and e > s:
                    held.insert(int(s), int(e))
        state.update((held.starts, held.ends))
        yield pd.DataFrame({"key": [key[0]], "n_periods": [len(held.starts)], "n_gaps": [max(0, len(held.starts) - 1)], "covered_days": [sum(e - s for s, e in zip(held.starts, held.ends))]})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, n_periods int, n_gaps int, covered_days bigint", "starts array<int>, ends array<int>", "update", "NoTimeout")
