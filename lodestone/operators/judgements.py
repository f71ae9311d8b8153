"""Judgements on a difference's subjects, met with the subjects as they are now, and how far a review has come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moved_fields(then: Column, now: Column) -> Column:
    """Names of the fields that two maps of facts tell differently, sorted; a map that is null has no fields."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(then, empty), F.coalesce(now, empty)
    names = F.array_union(F.map_keys(a), F.map_keys(b))
    same = lambda k: F.map_contains_key(a, k) & F.map_contains_key(b, k) & F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))
    return F.array_sort(F.filter(names, lambda k: ~same(k)))


def judged(judgements: DataFrame, subjects: DataFrame) -> DataFrame:
    """Every anchor that is judged or there now, with its state and the fields that moved.

    judgements: (diff_id, anchor_ref, verdict, facts, withheld, source_stale); subjects:
    (diff_id, anchor_ref, facts, listed); facts are maps, as of the judgement and now.
    diff_withheld; anchor_unresolved without a subject; subject_unlisted where the
    source is known not to be stale and the subject is there but not listed; changed
    with the fields; unchanged; unseen for a listed subject that nobody judged.
    Subjects that are neither listed nor judged have no row.
    """
    then = judgements.select("diff_id", "anchor_ref", "verdict", F.col("facts").alias("then"), "withheld", "source_stale", F.lit(True).alias("held"))
    now = subjects.select("diff_id", "anchor_ref", F.col("facts").alias("now"), "listed", F.lit(True).alias("there"))
    both = then.join(now, ["diff_id", "anchor_ref"], "full").where(F.col("held") | F.col("listed"))
    moved = moved_fields(F.col("then"), F.col("now"))
    state = (
        F.when(F.col("held").isNull(), "unseen")
        .when(F.coalesce("withheld", F.lit(False)), "diff_withheld")
        .when(F.col("there").isNull(), "anchor_unresolved")
        .when(F.col("source_stale").eqNullSafe(F.lit(False)) & ~F.coalesce("listed", F.lit(False)), "subject_unlisted")
        .when(F.size(moved) > 0, "changed")
        .otherwise("unchanged")
    )
    return both.select("diff_id", "anchor_ref", "verdict", state.alias("state"), F.when(state.isin("changed", "subject_unlisted"), moved).otherwise(F.array().cast("array<string>")).alias("moved"))


def progress(items: DataFrame, scope: str, size: int) -> DataFrame:
    """Totals of each scope, and of each of its buckets: looked_at, not_looked_at, pages and pages that remain.

    items: (scope, bucket, state), state unseen where nobody looked. A row whose bucket is
    null and ``whole`` is the scope's own.
    """
    small = items.groupBy(scope, "bucket").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "unseen").alias("not_looked_at"))
    sums = small.groupBy(scope).agg(F.sum("total").alias("total"), F.sum("not_looked_at").alias("not_looked_at")).withColumns({"bucket": F.lit(None).cast("string"), "whole": F.lit(True)})
    pages = lambda c: F.ceil(F.col(c) / size)
    return small.withColumn("whole", F.lit(False)).unionByName(sums).select(scope, "bucket", "whole", "total", (F.col("total") - F.col("not_looked_at")).alias("looked_at"), "not_looked_at", pages("total").alias("pages"), pages("not_looked_at").alias("pages_remaining"))


def tallies(items: DataFrame, scope: str) -> DataFrame:
    """How many of each scope's items have each state, and each verdict among those judged: scope, kind, value, items."""
    listed = items.select(scope, F.explode(F.array(F.struct(F.lit("state").alias("kind"), F.col("state").alias("value")), F.struct(F.lit("verdict").alias("kind"), F.col("verdict").alias("value")))).alias("t"))
    return listed.where("t.value IS NOT NULL").groupBy(scope, "t.kind", "t.value").agg(F.count("*").alias("items"))


def next_page(items: DataFrame, size: int, order: list[str], positions: DataFrame | None = None) -> DataFrame:
    """The first entries nobody looked at, in the order of a page where it is known (entry_id, position), then in their own."""
    unseen = items.where("state = 'unseen'")
    if positions is None:
        return unseen.orderBy(*order, "entry_id").limit(size)
    met = unseen.join(positions.select("entry_id", "position"), "entry_id", "left")
    return met.orderBy(F.asc_nulls_last("position"), *order, "entry_id").limit(size).drop("position")
