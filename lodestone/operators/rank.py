"""Orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers of impact by class of sink; others have tier 0.
IMPACT = {"cmd": 3, "fmt_string": 3, "path_sink": 3, "copy": 2, "format": 1, "log": 1}
PAGE_BYTES = 48_000
PAGE_ROWS = 200


def parse_impact_order(spec: str) -> dict[str, int]:
    """Tiers from ``a=b,c``: a comma goes a tier down, an equals sign stays on it."""
    tiers = [[x.strip() for x in part.split("=") if x.strip()] for part in spec.split(",")]
    return {x: len(tiers) - i for i, part in enumerate(tiers) for x in part}


def impact(sink: Column, order: dict[str, int] | None = None) -> Column:
    out = F.lit(0)
    for name, tier in (IMPACT if order is None else order).items():
        out = F.when(sink == name, tier).otherwise(out)
    return out


def annotation_band(verdict: Column, basis: Column) -> Column:
    """-1 exploitable; 0 suspicious, or settled on a basis that changed; 1 open or none; 2 settled and still valid."""
    settled = verdict.isin("excluded", "safe")
    return F.when(verdict == "exploitable", -1).when((verdict == "suspicious") | (settled & ~basis.eqNullSafe(F.lit("unchanged"))), 0).when(settled, 2).otherwise(1)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows of one page by a total order."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(limit, PAGE_ROWS))


def round_robin(df: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """``position``: the r-th rows of all streams come before the next; ``turn`` is r."""
    turn = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    return df.withColumn("turn", turn)


def first_of_each(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("turn") <= k)


def byte_budget(df: DataFrame, size: str, by: list[str], order: list[str], budget: int = PAGE_BYTES) -> DataFrame:
    """Rows of each group while their sizes fit a page, one row at least."""
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("so_far", so_far).withColumn("place", F.row_number().over(w)).where((F.col("so_far") <= budget) | (F.col("place") == 1))


def islands(df: DataFrame, by: list[str], at: str, stride: int = 1) -> DataFrame:
    """Maximal series of a group's places, ``stride`` apart: first, last and length of each."""
    places = df.select(*by, at).distinct()
    rank = F.row_number().over(Window.partitionBy(*by, F.pmod(F.col(at), F.lit(stride))).orderBy(at))
    return places.withColumn("__g", F.col(at) - rank * stride).groupBy(*by, "__g").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("__g")
