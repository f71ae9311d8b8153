"""Writers of the warehouse: tables partitioned by run, replaced run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import select
from lodestone.plans import schemas

STATES = ("in_progress", "complete", "partial", "failed")


class Warehouse:
    """Parquet tables under a folder, one for each name of ``schemas``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def schema(self, name: str) -> str:
        return next(t[name] for t in (schemas.FACTS, schemas.CROSS, schemas.DIFFS) if name in t)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        """A table; one that was never written has no rows."""
        if not self.exists(name):
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(self.path(name))

    def replace_runs(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions of the runs that ``rows`` hold and no others."""
        columns = [c.split()[0] for c in _fields(self.schema(name))]
        wanted = rows.select(*columns)
        wanted.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path(name))

    def replace_diffs(self, name: str, rows: DataFrame, diffs: list[str]) -> None:
        """Replace what a table holds of the named differences; one without rows is emptied."""
        columns = [c.split()[0] for c in _fields(self.schema(name))]
        self._drop(name, "diff_id", diffs)
        rows.where(F.col("diff_id").isin(*diffs)).select(*columns).repartition("diff_id").write.mode("append").partitionBy("diff_id").parquet(self.path(name))

    def delete_diff(self, diff_id: str) -> list[str]:
        """Remove a difference from every table; returns those that held it."""
        return [name for name in schemas.DIFFS if self._drop(name, "diff_id", [diff_id])]

    def _drop(self, name: str, column: str, values: list[str]) -> bool:
        gone = False
        for value in values:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{column}={value}")
            gone |= path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return gone

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*(c.split()[0] for c in _fields(self.schema(name)))).write.mode("append").parquet(self.path(name))

    def delete_run(self, run_id: str) -> list[str]:
        """Remove a run from every table that is partitioned by run; the run's own events stay as history."""
        jvm, gone = self.spark.sparkContext._jvm, []
        for name in [*schemas.FACTS, *(t for t in schemas.CROSS if t not in ("run", "pattern", "annotation"))]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/run_id={run_id}")
            if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True):
                gone.append(name)
        return gone

    def mark_run(self, run_id: str, state: str, note: str | None = None) -> None:
        """Append a run's state; its current state is the last."""
        if state not in STATES:
            raise ValueError(f"unknown state {state!r}; one of {', '.join(STATES)}")
        self.append("run", self.spark.createDataFrame([(run_id, state, note)], "run_id string, state string, note string").withColumn("at", F.current_timestamp()))

    def runs(self) -> DataFrame:
        """Runs with their last state, and runs that only instances know; recorded ones first, the newest first."""
        known = select.latest(self.read("run"), ["run_id"], ["at"])
        seen = self.read("instance").select("run_id").distinct().join(known, "run_id", "left_anti")
        return known.select("run_id", "state", "at").unionByName(seen.select("run_id", F.lit(None).cast("string").alias("state"), F.lit(None).cast("timestamp").alias("at"))).orderBy(F.desc_nulls_last("at"), "run_id")

    def add_patterns(self, found: DataFrame) -> DataFrame:
        """Find or create patterns by their natural key; returns ``found`` with pattern_id, a hash of the key."""
        key = ["source_class", "sink_class", "shape", "fingerprint"]
        marked = found.withColumn("pattern_id", text.fingerprint(*map(F.col, key)))
        new = marked.select("pattern_id", *key).distinct().join(self.read("pattern").select("pattern_id"), "pattern_id", "left_anti")
        self.append("pattern", new)
        return marked


def _fields(schema: str) -> list[str]:
    depth, out, at = 0, [], 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return [*out, schema[at:].strip()]
