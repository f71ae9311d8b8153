"""Files of an image: inventory, hashes, kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes up to which a file's text is read.
MAX_TEXT = 5 << 20


def read_image(spark: SparkSession, root: str) -> DataFrame:
    """path, size, sha256 and content of every file under a root, empty files excepted, which Spark's reader leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.lower(F.sha2("content", 256)).alias("sha256"), "content")


def file_type(head: Column, size: Column) -> Column:
    """A type label by a file's first bytes."""
    starts = lambda h: F.hex(F.substring(head, 1, len(h) // 2)) == h
    return F.when(size == 0, "empty").when(starts("7F454C46"), "elf").when(starts("2321"), "script").when(starts("1F8B"), "gzip").when(starts("504B0304"), "zip").when(starts("89504E47"), "image").when(F.is_valid_utf8(head.cast("string")), "text").otherwise("data")


def unique_binaries(image: DataFrame) -> DataFrame:
    """Executable files, one for each content, by the smallest path."""
    elf = image.where(file_type(F.col("content"), F.col("size")) == "elf")
    return elf.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.min("size").alias("size"))


def inventory(image: DataFrame) -> DataFrame:
    """Every file with how it was taken in or why it was not; exactly one of the two is set."""
    kind = file_type(F.col("content"), F.col("size"))
    first = F.min("path").over(Window.partitionBy("sha256"))
    taken = F.when((kind == "elf") & (F.col("path") == first), "binary").when(kind.isin("text", "script") & (F.col("size") <= MAX_TEXT), "text")
    why = F.when(taken.isNull(), F.when(kind == "elf", "same_content_as_another").when(F.col("size") > MAX_TEXT, "too_large").otherwise(F.concat(F.lit("type_"), kind)))
    return image.select("path", "sha256", "size", kind.alias("file_type"), taken.alias("inventoried_as"), why.alias("not_inventoried_reason"))

