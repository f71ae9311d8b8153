"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def density(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Candidates per group, null groups kept."""
    return candidates.groupBy(*by).agg(F.count("*").alias("candidates"))


def recurrence(patterns: DataFrame, instances: DataFrame, pattern: str, run: str, body: str, own: Column) -> DataFrame:
    """Per pattern: ``spread`` runs, and ``breadth`` distinct bodies of instances whose origin counts; patterns without instances have zeros."""
    sums = instances.groupBy(pattern).agg(F.countDistinct(run).alias("spread"), F.countDistinct(F.when(own, F.col(body))).alias("breadth"), F.count("*").alias("instances"))
    return patterns.join(sums, pattern, "left").na.fill(0, ["spread", "breadth", "instances"])


def coverage_state(verdict: Column, basis: Column, words: tuple[str, ...]) -> Column:
    """unseen without a verdict; needs_relabel for a retired word; needs_recheck when its basis moved; open; concluded."""
    return F.when(verdict.isNull(), "unseen").when(~verdict.isin(*words), "needs_relabel").when(~F.coalesce(basis, F.lit("")).isin("unchanged", "unverifiable"), "needs_recheck").when(verdict == "inconclusive", "open").otherwise("concluded")


def strict_sum(value: Column) -> Column:
    """A sum that is null when any input is: an unrecorded count is never zero."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def session_tally(log: DataFrame, session: str, tool: str, size: Column) -> DataFrame:
    """Calls, distinct tools and bytes of each session; bytes are null when a call has none recorded."""
    return log.groupBy(session).agg(F.count("*").alias("calls"), F.countDistinct(tool).alias("tools"), strict_sum(size).alias("bytes"))
