"""How far a caller controls what reaches a sink, from the sink's provenance records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"controllable": 5, "likely": 4, "free": 3, "constrained": 2, "unknown": 1, "const": 0}


def fold_record(kind: Column, classes: Column, dominating: Column, withdraw: Column) -> Column:
    """One record's class from its writers' classes (arrays, all of them and those that dominate).

    controllable if any dominating writer is; const only if every dominating and every
    other writer is, and nothing withdraws it; otherwise the highest rank that any has;
    unknown without a writer. A record that is no buffer has its own kind.
    """
    best = F.lit("unknown")
    for name in ("constrained", "free", "likely"):
        best = F.when(F.array_contains(classes, name), name).otherwise(best)
    every = F.forall(classes, lambda c: c.eqNullSafe(F.lit("const"))) & F.forall(dominating, lambda c: c.eqNullSafe(F.lit("const")))
    return F.when(kind != "buffer", kind).when((F.size(classes) <= 0) & (F.size(dominating) <= 0), "unknown").when(F.array_contains(dominating, "controllable"), "controllable").when(every & ~F.coalesce(withdraw, F.lit(False)), "const").otherwise(best)


def controllability(records: Column, anchored: Column) -> Column:
    """A candidate's verdict from its records' classes: any controllable, any likely, const where the anchored sink left a record and all are, then free, constrained, unknown."""
    has = lambda n: F.array_contains(records, n)
    const = F.coalesce(anchored, F.lit(False)) & (F.size(records) > 0) & F.forall(records, lambda c: c.eqNullSafe(F.lit("const")))
    return F.when(has("controllable"), "controllable").when(has("likely"), "likely").when(const, "const").when(has("free"), "free").when(has("constrained"), "constrained").otherwise("unknown")


def rank_of(verdict: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in RANK.items():
        out = F.when(verdict == name, rank).otherwise(out)
    return out


def sink_summary(records: DataFrame, by: list[str], site: str | None = None) -> DataFrame:
    """One short row for each sink record (sink, sink_addr, kind, writers, nearest): what was resolved, and how many writers dominate.

    writers: an array of (writer, dominates, fmt), null where none were looked for, whose
    count is then null too. ``nearest_fmt`` is the format of the nearest dominating
    writer. With ``site``, a column of the candidate's own (sink, address), ``own`` says
    which record is its own.
    """
    near = F.filter("writers", lambda w: (w["writer"] == F.col("nearest")) & w["fmt"].isNotNull())
    kind = F.coalesce("kind", F.lit("unknown"))
    dominating = F.when(F.col("writers").isNotNull(), F.size(F.filter("writers", lambda w: F.coalesce(w["dominates"], F.lit(False)))))
    own = [] if site is None else [F.coalesce((F.col("sink") == F.col(f"{site}.sink")) & (F.col("sink_addr") == F.col(f"{site}.address")), F.lit(False)).alias("own")]
    return records.select(*by, "sink", "sink_addr", kind.alias("kind"), (~kind.isin("indirect_unresolved", "unresolved")).alias("resolved"), F.when(F.col("writers").isNotNull(), F.size("writers")).alias("writers"), dominating.alias("dominating_writers"), "nearest", F.get(near, F.lit(0))["fmt"].alias("nearest_fmt"), *own)
