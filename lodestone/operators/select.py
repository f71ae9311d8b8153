"""Selectors, guards and filters that rank rather than remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_generation(df: DataFrame, stamp: str, by: list[str] | None = None) -> DataFrame:
    """Rows of the last generation; where no row has a stamp, all rows."""
    last = df.groupBy(*(by or [])).agg(F.max(stamp).alias("__last"))
    if by:
        found = df.join(last, by)
    else:
        found = df.crossJoin(F.broadcast(last))  # one row
    return found.where(F.col("__last").isNull() | (F.col(stamp) == F.col("__last"))).drop("__last")


def tiered(df: DataFrame, tiers: list[Column]) -> DataFrame:
    """Rows of the first tier that any row matches; ``ambiguous`` where there are several, which a caller refuses."""
    tier = F.coalesce(*(F.when(t, F.lit(i)) for i, t in enumerate(tiers)))
    ranked = df.withColumn("tier", tier).where("tier IS NOT NULL")
    best = ranked.agg(F.min("tier").alias("__best"))
    found = ranked.join(F.broadcast(best), ranked.tier == best["__best"]).drop("__best")
    count = found.agg((F.count("*") > 1).alias("ambiguous"))
    return found.crossJoin(F.broadcast(count))


def resolved_for_all(df: DataFrame, dimensions: list[str], unresolved: tuple[str, ...] = ("unknown", "undetermined")) -> DataFrame:
    """One row: for every dimension, whether it is resolved for every row, so that pruning on it hides nothing unknown."""
    return df.agg(*(F.coalesce(F.bool_and(F.col(d).isNotNull() & ~F.coalesce(F.col(d), F.lit("")).isin(*unresolved)), F.lit(True)).alias(d) for d in dimensions))


def float_bands(df: DataFrame, wanted: dict[str, str], safe: Column) -> DataFrame:
    """``band``: 0 matches all that is wanted, 1 does not, 2 proven safe; no row is removed. ``a+b`` holds both a and b."""
    hit = F.lit(True)
    for dim, value in wanted.items():
        hit = hit & F.coalesce(F.array_contains(F.split(F.col(dim), r"\+"), value) | (F.col(dim) == value), F.lit(False))
    return df.withColumn("band", F.when(F.coalesce(safe, F.lit(False)), 2).when(hit, 0).otherwise(1))


def with_columns_or_null(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns with their types; null where the table does not have one."""
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row for each key: an append-only log's current state."""
    w = Window.partitionBy(*key).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
