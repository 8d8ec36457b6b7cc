"""Session factory and lineage cutting through tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` keys use ``__`` for dots and win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the session's Python workers, wherever they run, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_quillstone_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="quillstone-"), "quillstone.zip")
        atexit.register(shutil.rmtree, str(at.parent), True)
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(at))
        sc._quillstone_shipped = sc.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: ``spark.checkpoint.dir`` of the session. Only a session of one machine may do without and gets a folder of this process's own; any other raises."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillstone-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive the loss of executors.

    ``write`` runs the plan once and returns a scan of the result; ``drop`` removes a table no longer read.
    Tables still held when the process ends are removed then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", {}
        atexit.register(self.close)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def write_counting(self, df: DataFrame, *counts: Column) -> tuple[DataFrame, list[int]]:
        """``write``, along with aggregates of the rows taken in the same pass (``count_if`` and the like)."""
        seen = Observation()
        out = self.write(df.observe(seen, *(c.alias(f"c{i}") for i, c in enumerate(counts))))
        return out, [seen.get[f"c{i}"] or 0 for i in range(len(counts))]

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and id(t) in self.paths:
                self._delete(self.paths.pop(id(t))[0])

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        local = self.base.removeprefix("file://")
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
            return
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.base)
        except Exception:
            pass  # the session is gone; the cluster's own clean-up takes the folder
