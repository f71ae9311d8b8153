"""Symbolic links of an image: where they lead, and why some lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import staged

CHAIN = 40
PLACEHOLDER = "/dev/null"


def normal_path(path):
    """An absolute path without empty parts, ``.`` and ``..``; null where it climbs out of the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(acc.isNull() | ((p == "..") & (F.size(acc) == 0)), F.lit(None).cast("array<string>")).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.when(kept.isNotNull(), F.concat(F.lit("/"), F.array_join(kept, "/")))


def classify(links: DataFrame, paths: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Each link (path, target): what it resolves to and, in this order, why not: placeholder, escapes, broken_parent, dangling, chain_limit.

    paths: all files and folders (path, absolute within the image). Links to links are
    followed one round at a time, all of them at once.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    full = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(folder, F.lit("/"), F.col("target")))
    first = staged(links.select("path", "target", normal_path(full).alias("at")), "links")
    real = paths.select(F.col("path").alias("at")).distinct().withColumn("there", F.lit(True))
    step = first.select(F.col("path").alias("at"), F.col("at").alias("next")).withColumn("is_link", F.lit(True))
    now, done = first.withColumn("hops", F.lit(0)), None
    for _ in range(chain):
        met = staged(now.join(step, "at", "left"), "links")
        ended = met.where("is_link IS NULL").drop("next", "is_link")
        done = ended if done is None else done.unionByName(ended)
        now = met.where("is_link").select("path", "target", F.col("next").alias("at"), (F.col("hops") + 1).alias("hops"))
        if now.isEmpty():
            break
    done = done.withColumn("cut", F.lit(False)).unionByName(now.withColumn("cut", F.lit(True)))
    parent = F.when(F.regexp_replace("at", "/[^/]*$", "") == "", "/").otherwise(F.regexp_replace("at", "/[^/]*$", ""))
    homes = real.select(F.col("at").alias("parent"), F.col("there").alias("parent_there"))
    found = done.join(real, "at", "left").withColumn("parent", parent).join(homes, "parent", "left")
    why = F.when(F.col("target") == PLACEHOLDER, "placeholder").when(F.col("at").isNull(), "escapes").when(~F.col("cut") & F.col("there").isNull() & F.col("parent_there").isNull() & (F.col("parent") != "/"), "broken_parent").when(~F.col("cut") & F.col("there").isNull(), "dangling").when(F.col("cut"), "chain_limit")
    return found.select("path", "target", F.when(why.isNull(), F.col("at")).alias("resolved"), why.alias("damage"))
