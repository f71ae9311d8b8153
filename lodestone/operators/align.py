"""Two runs side by side: pairing, differences, as-of and range lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENT = 0.9


def alignment_state(confidence: Column, gap_a: Column, gap_b: Column) -> Column:
    """aligned if confident and no side has an export gap; similarity has no say."""
    return F.when((confidence >= CONFIDENT) & ~F.coalesce(gap_a, F.lit(False)) & ~F.coalesce(gap_b, F.lit(False)), "aligned").otherwise("undetermined")


def one_sided(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys that only one side has, nulls equal to nulls."""
    marked = a.select(*key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    return marked.groupBy(*key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b")).where("__a <> __b").withColumn("side", F.when(F.col("__a") == 1, "a").otherwise("b")).drop("__a", "__b")


def multiset_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys with different numbers of rows on both sides, in one pass and with partial sums."""
    n = a.select(*key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    return n.groupBy(*key).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b")).where("n_a <> n_b")


def pair_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """Files (path, sha256, each path once) by path; then by a hash that one left file of each side has; the rest alone.

    Columns: path_a, path_b, basis (path, sha256, alone, sha_ambiguous), status
    (same, content_differs, undetermined, renamed, a_only, b_only).
    """
    both = a.select(F.col("path").alias("path_a"), F.col("sha256").alias("sha_a"), F.col("path").alias("path")).join(b.select(F.col("path").alias("path_b"), F.col("sha256").alias("sha_b"), F.col("path").alias("path")), "path", "full")
    met = both.where("path_a IS NOT NULL AND path_b IS NOT NULL").select("path_a", "path_b", F.lit("path").alias("basis"), F.when(F.col("sha_a").isNull() | F.col("sha_b").isNull(), "undetermined").when(F.col("sha_a") == F.col("sha_b"), "same").otherwise("content_differs").alias("status"))
    left = both.where("path_a IS NULL OR path_b IS NULL").withColumn("sha", F.coalesce("sha_a", "sha_b"))
    hashes = left.where("sha IS NOT NULL").groupBy("sha").agg(F.count("path_a").alias("in_a"), F.count("path_b").alias("in_b"), F.min("path_a").alias("one_a"), F.min("path_b").alias("one_b"))
    renamed = hashes.where("in_a = 1 AND in_b = 1").select(F.col("one_a").alias("path_a"), F.col("one_b").alias("path_b"), F.lit("sha256").alias("basis"), F.lit("renamed").alias("status"))
    alone = left.join(hashes, "sha", "left").where("NOT coalesce(in_a = 1 AND in_b = 1, false)")
    ambiguous = F.coalesce((F.col("in_a") > 0) & (F.col("in_b") > 0), F.lit(False))
    rest = alone.select("path_a", "path_b", F.when(ambiguous, "sha_ambiguous").otherwise("alone").alias("basis"), F.when(F.col("path_a").isNotNull(), "a_only").otherwise("b_only").alias("status"))
    return met.unionByName(renamed).unionByName(rest)


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, carry: list[str]) -> DataFrame:
    """left with ``carry`` of the right row of its group at or last below its place, by one sort and no pairs.

    Of right rows at one place the one with the largest carried values counts.
    """
    values = F.struct(at, *carry)
    none = F.lit(None).cast(right.select(values.alias("v")).schema["v"].dataType)
    rows = F.struct(*left.columns)
    empty = F.lit(None).cast(left.select(rows.alias("r")).schema["r"].dataType)
    both = right.select(*by, at, F.lit(0).alias("__turn"), values.alias("__v"), empty.alias("__r")).unionByName(left.select(*by, at, F.lit(1).alias("__turn"), none.alias("__v"), rows.alias("__r")))
    w = Window.partitionBy(*by).orderBy(F.col(at), F.col("__turn"), F.col("__v")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__turn = 1")
    return found.select("__r.*", *(F.col(f"__v.{c}").alias(f"asof_{c}") for c in [at, *carry]))


def owners(points: DataFrame, spans: DataFrame, by: list[str], at: str) -> DataFrame:
    """points with the span (lo, hi inclusive, owner; not overlapping in a group) that covers them, else null."""
    found = as_of(points, spans.withColumnRenamed("lo", at), by, at, ["hi", "owner"])
    return found.withColumn("owner", F.when(F.col(at) <= F.col("asof_hi"), F.col("asof_owner"))).drop(f"asof_{at}", "asof_hi", "asof_owner")


def delta(a: DataFrame, b: DataFrame, key: list[str], value: str, complete_a: Column, complete_b: Column) -> DataFrame:
    """added, removed, changed or unchanged for each key; undetermined where the side that lacks it did not report itself complete."""
    both = a.select(*key, F.col(value).alias("value_a"), F.lit(True).alias("__a")).join(b.select(*key, F.col(value).alias("value_b"), F.lit(True).alias("__b")), key, "full")
    state = F.when(F.col("__a").isNull(), F.when(complete_a, "added").otherwise("undetermined")).when(F.col("__b").isNull(), F.when(complete_b, "removed").otherwise("undetermined")).when(F.col("value_a").isNull() | F.col("value_b").isNull(), "undetermined").when(F.col("value_a") == F.col("value_b"), "unchanged").otherwise("changed")
    return both.withColumn("state", state).drop("__a", "__b")
