"""Annotations: an append-only log, its current state, and what to read next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import select
from lodestone.plans.warehouse import Warehouse

VERDICTS = ("exploitable", "suspicious", "inconclusive", "excluded", "safe")


def annotate(store: Warehouse, rows: list[dict]) -> int:
    """Append a batch of judgements, all of them or, where one is malformed, none."""
    wrong = [i for i, r in enumerate(rows) if r.get("verdict") not in VERDICTS or not r.get("anchor_ref") or not r.get("rationale")]
    if wrong:
        raise ValueError(f"nothing written; rows without a known verdict, an anchor or a rationale: {wrong}")
    if len({(r.get("anchor_kind", "candidate"), r["anchor_ref"]) for r in rows}) < len(rows):
        raise ValueError("nothing written; an anchor is judged twice in one batch")
    return _append(store, [{**r, "cleared": False} for r in rows])


def clear(store: Warehouse, anchors: list[tuple[str, str]]) -> int:
    """Append that anchors have no judgement any more; history stays."""
    return _append(store, [{"anchor_kind": k, "anchor_ref": r, "cleared": True} for k, r in anchors])


def _append(store: Warehouse, rows: list[dict]) -> int:
    columns = ("anchor_kind", "anchor_ref", "verdict", "rationale", "basis", "attributed_to", "cleared")
    data = [tuple(r.get(c, "candidate" if c == "anchor_kind" else None) for c in columns) + (i,) for i, r in enumerate(rows)]
    store.append("annotation", store.spark.createDataFrame(data, "anchor_kind string, anchor_ref string, verdict string, rationale string, basis string, attributed_to string, cleared boolean, seq long").withColumn("at", F.current_timestamp()))
    return len(rows)


def current(log: DataFrame) -> DataFrame:
    """Each anchor's last judgement, those cleared left out."""
    return select.latest(log, ["anchor_kind", "anchor_ref"], ["at", "seq"]).where("NOT cleared")


def units(entries: DataFrame, by: list[str], k: int, workers: int, batch: int = 16) -> DataFrame:
    """Work units of a review (entry, must_read, position and the columns ``by``): unit, worker and tier of each entry.

    Entries to be read first, and the first k of each group, are units of their own;
    the rest go in batches. A unit's id is the hash of its sorted entries, and its
    worker follows from the id.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("position", "entry")
    placed = entries.withColumn("n", F.row_number().over(w)).withColumn("first", F.col("must_read") | (F.col("n") <= k))
    later = F.row_number().over(Window.partitionBy(*by, "first").orderBy("position", "entry")) - 1
    grouped = placed.withColumn("slot", F.when(F.col("first"), F.col("n")).otherwise(-1 - F.floor(later / batch)))
    made = grouped.groupBy(*by, "slot", "first").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    unit = F.sha2(F.array_join(F.col("entries").cast("array<string>"), "|"), 256)
    return made.select(*by, F.substring(unit, 1, 16).alias("unit"), text.shard(unit, workers).alias("worker"), F.when(F.col("first"), 1).otherwise(2).alias("tier"), "entries")
