"""Tables and queues written so that a run can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.registry import upsert_last


def upsert_parquet(spark: SparkSession, target: str, rows: DataFrame, keys: list[str], position: str) -> None:
    """Rows merged into the table at ``target``, the highest position a key winning; written beside it and then put in place."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(target)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    both = rows if not files.exists(at) else spark.read.parquet(target).unionByName(rows, allowMissingColumns=True)
    new, old = fs.Path(target + ".new"), fs.Path(target + ".old")
    files.delete(new, True)
    upsert_last(both, keys, position).write.parquet(new.toString())
    files.delete(old, True)
    if files.exists(at):
        files.rename(at, old)
    files.rename(new, at)
    files.delete(old, True)


def append_new_json(spark: SparkSession, target: str, rows: DataFrame, key: str) -> int:
    """JSON lines appended for keys that the queue lacks, the smallest row of a repeated key; the number written."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(target)
    known = rows.where(F.col(key).isNotNull())
    row = F.struct(*known.columns)
    once = known.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("_r")).select("_r.*")  # smallest as written
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        once = once.join(spark.read.json(target).select(key), key, "left_anti")
    once = once.cache()
    n = once.count()
    if n:
        once.write.mode("append").json(target)
    once.unpersist()
    return n


def move(spark: SparkSession, pending: str, done: str, decided: DataFrame, key: str) -> None:
    """Decided rows leave the pending queue for the done one. Not a transaction, but nothing is lost: after a crash in between, a row is in both and moves again.

    The new pending queue is written beside the old one and takes its place by renaming; a run that finds the old one set aside goes on from it.
    """
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, new, old = fs.Path(pending), fs.Path(pending + ".new"), fs.Path(pending + ".old")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at) and files.exists(old):
        files.rename(old, at)
    queue = spark.read.json(pending)
    append_new_json(spark, done, queue.join(decided, key), key)
    files.delete(new, True)
    spark.read.schema(queue.schema).json(pending).join(decided.select(key), key, "left_anti").write.json(new.toString())
    files.delete(old, True)
    files.rename(at, old)
    files.rename(new, at)
    files.delete(old, True)


def report(rows: DataFrame, title: str, limit: int = 50) -> str:
    """A Markdown table of the first rows, for a person to read."""
    head = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v).replace("|", "/") for v in r) + " |" for r in rows.limit(limit).collect())])
