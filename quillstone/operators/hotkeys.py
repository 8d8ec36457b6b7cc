"""Joins whose left side may hold a hot key, and prefix sums that no key can make uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_000  # at most so many keys can each hold more than a thousandth of the rows
HOT_ROWS = 250_000  # fewer rows of a key than this fit one task well


def hot_keys(left: DataFrame, key: str, rows: int | None = None) -> list:
    """Keys with more than ``HOT_ROWS`` rows of ``left`` and more than a thousandth of all, so at most ``HOT_KEYS``. ``rows``: the row count if known."""
    if rows is None:
        rows = left.count()
    if rows <= HOT_ROWS:
        return []
    limit = max(HOT_ROWS, rows // HOT_KEYS)
    return [r[0] for r in left.groupBy(key).count().where(F.col("count") > limit).select(key).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, hot: list | None = None) -> DataFrame:
    """``left`` joined with ``right`` (one row a key) on ``key``; rows of hot keys of ``left`` stay where they are.

    A key is hot with more than ``HOT_ROWS`` rows and more than a thousandth of all; so at most ``HOT_KEYS`` rows of
    ``right`` are broadcast, however large the tables. All other rows take a shuffle join. ``rows``: the row count of
    ``left`` if known; below ``HOT_ROWS`` no key can be hot. ``hot``: the hot keys if known.
    """
    if hot is None:
        hot = hot_keys(left, key, rows)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    apart = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return apart.unionByName(left.where(~F.coalesce(is_hot, F.lit(False))).join(right, key, how))


def prefix_sum(df: DataFrame, order: list[str], value: Column | None, name: str, scratch) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (bigint) over all rows before this one in the total order ``order``; without a value their number.

    Rows are range-partitioned once and summed in the pass that sorts them, so that a key that leads ``order`` may spread over
    many tasks and no second exchange follows. One sum a partition comes to the driver and goes back as a broadcast table of as
    many rows. ``order`` must tell all rows apart. Nulls in ``value`` count as 0.
    """
    spark = df.sparkSession
    rows = df if value is None else df.withColumn("_v", F.coalesce(value.cast("bigint"), F.lit(0)))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    if value is None:
        at = scratch.write(ordered.withColumn("_at", F.monotonically_increasing_id()))
        at = at.select("*", F.shiftright("_at", 33).cast("int").alias("_p"), F.col("_at").bitwiseAND(F.lit(2**33 - 1)).alias("_before"))
        sums = at.groupBy("_p").agg(F.count(F.lit(1)).alias("s")).collect()
    else:
        at = scratch.write(_running(ordered).withColumn("_p", F.spark_partition_id()))
        sums = at.groupBy("_p").agg(F.sum("_v").alias("s")).collect()
    before, total = [], 0
    for p, s in sorted((r[0], r[1]) for r in sums):
        before.append((p, total))
        total += s
    offsets = F.broadcast(spark.createDataFrame(before or [(0, 0)], "_p int, _offset bigint"))  # as many rows as partitions
    return at.join(offsets, "_p").select(*df.columns, (F.col("_offset") + F.col("_before")).alias(name))


def _running(ordered: DataFrame) -> DataFrame:
    """With ``_before``: the sum of ``_v`` over the rows before in the partition."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = 0
        for b in batches:
            v = b.column("_v").to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total + upto - v)], [*b.schema.names, "_before"])
            total += int(upto[-1]) if len(upto) else 0

    return ordered.mapInArrow(run, ordered.limit(0).withColumn("_before", F.lit(0).cast("bigint")).schema)
