"""Words, records and strided runs of byte images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words(blocks: DataFrame, size: int = 4, big: bool = False) -> DataFrame:
    """Aligned words of blocks (binary, address, data): binary, address, value. Bytes of a block's torn edges are left out; words of 8 bytes are unsigned decimals."""
    start = F.pmod(-F.col("address"), F.lit(size))
    count = F.floor((F.octet_length("data") - start) / size)
    at = blocks.where(count > 0).select("binary", "address", "data", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i"), start.alias("s"))
    raw = F.substring(F.col("data"), (F.col("s") + F.col("i") * size + 1).cast("int"), F.lit(size))
    digits = F.hex(raw)
    turned = digits if big else F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))
    return at.select("binary", (F.col("address") + F.col("s") + F.col("i") * size).alias("address"), F.conv(turned, 16, 10).cast("decimal(20,0)" if size > 7 else "long").alias("value"))


def records(found: DataFrame, address: int, stride: int, size: int = 4, field: int = 0) -> DataFrame:
    """Words as records of ``stride`` bytes around an address: record (0 holds it at ``field``), offset in it, value."""
    base = F.col("address") - F.lit(address - field)
    return found.select("binary", F.floor(base / stride).cast("long").alias("record"), F.pmod(base, F.lit(stride)).alias("offset"), "address", "value")


def entry_runs(found: DataFrame, entries: DataFrame, size: int = 4, most: int = 8, least: int = 3) -> DataFrame:
    """Of every stride up to ``most`` words the longest series of words that are function entries: binary, stride, first, length.

    A word counts under the smallest stride that gives it a series of ``least``.
    entries: (binary, value). Series come from one sort for each stride.
    """
    hits = found.join(entries.select("binary", "value").distinct(), ["binary", "value"])
    strided = hits.select("binary", "address", F.explode(F.array(*(F.lit(size * k) for k in range(1, most + 1)))).alias("stride"))
    w = Window.partitionBy("binary", "stride", F.pmod("address", F.col("stride"))).orderBy("address")
    series = strided.withColumn("first", F.col("address") - F.col("stride") * (F.row_number().over(w) - 1))
    sized = series.withColumn("length", F.count("*").over(Window.partitionBy("binary", "stride", F.pmod("address", F.col("stride")), "first"))).where(F.col("length") >= least)
    best = sized.groupBy("binary", "address").agg(F.min("stride").alias("stride"))
    kept = sized.join(best, ["binary", "address", "stride"])
    return kept.groupBy("binary", "stride", F.pmod("address", F.col("stride")).alias("phase"), "first", "length").agg(F.min("address").alias("start"), F.count("*").alias("words")).select("binary", "stride", "start", "length", "words")
