"""Binaries that one run of two holds alone, and functions that may belong to another counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import review

#: Unique strings, and keys with one handler, from which another counterpart is told.
STRING_MIN = 5
KEY_MIN = 1
#: Lines that a body must have more of to be told by itself.
TWIN_MIN_LINES = 5


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def endpoint_name(path: Column) -> Column:
    """The last segment of a web path without query and fragment."""
    return base_name(F.regexp_replace(F.regexp_replace(path, "[?#][\\s\\S]*$", ""), "/+$", ""))


def _other(side: str = "side") -> Column:
    return F.when(F.col(side) == "a", "b").otherwise("a")


def held_alone(binaries: DataFrame, paths: DataFrame, diffed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Binaries (side, name, path, sha256) without anything on the other side that could be their counterpart, with their candidates.

    A counterpart has the same content, name or path; a file or link (paths: side, path)
    at the path counts too. diffed: (side, name, sha256) of differences, which a
    binary without candidates (side, path) must not be in by name or content.
    """
    there = binaries.select(_other().alias("side"), "name", "path", "sha256")
    keyed = lambda df: df.select("side", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("name", "path", "sha256")))).alias("x")).select("side", "x.k", "x.v").where("v IS NOT NULL")
    other = keyed(there).unionByName(paths.select(_other().alias("side"), F.lit("path").alias("k"), F.col("path").alias("v"))).distinct()
    mine = binaries.select("side", "path", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("name", "path", "sha256")))).alias("x")).select("side", "path", "x.k", "x.v")
    matched = mine.join(other, ["side", "k", "v"], "left_semi").select("side", "path").distinct()
    held = candidates.groupBy("side", "path").agg(F.count("*").alias("candidates"))
    by_name = diffed.where("name IS NOT NULL").select("side", "name").distinct().withColumn("n", F.lit(True))
    by_sha = diffed.where("sha256 IS NOT NULL").select("side", "sha256").distinct().withColumn("s", F.lit(True))
    alone = binaries.join(matched, ["side", "path"], "left_anti").join(held, ["side", "path"], "left").join(by_name, ["side", "name"], "left").join(by_sha, ["side", "sha256"], "left")
    return alone.where("candidates IS NOT NULL OR (n IS NULL AND s IS NULL)").select("side", "name", "path", "sha256", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def referenced_by(alone: DataFrame, references: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded references to each such binary (side, name) in its own run, with their state on the other side.

    references: (side, path, kind, target, line), target a command of a script_call or a
    web_endpoint's path; files: (side, path, sha256). file_absent where the other side
    has no such file; present where it has the same content or names the binary;
    not_recorded where it has references of the kind to others only; else undetermined.
    """
    named = references.withColumn("name", F.when(F.col("kind") == "web_endpoint", endpoint_name(F.col("target"))).otherwise(base_name(F.trim("target"))))
    mine = named.join(alone.select("side", "name").distinct(), ["side", "name"]).select("side", "name", "path", "kind", "line")
    own = files.select("side", "path", F.col("sha256").alias("own_sha"))
    other = files.select(_other().alias("side"), "path", F.col("sha256").alias("other_sha"), F.lit(True).alias("there"))
    any_ = named.select(_other().alias("side"), "path", "kind").distinct().withColumn("some", F.lit(True))
    same = named.select(_other().alias("side"), "path", "kind", "name").distinct().withColumn("same", F.lit(True))
    met = mine.join(own, ["side", "path"], "left").join(other, ["side", "path"], "left").join(any_, ["side", "path", "kind"], "left").join(same, ["side", "path", "kind", "name"], "left")
    state = F.when(F.col("there").isNull(), "file_absent").when((F.col("own_sha") == F.col("other_sha")) | F.col("same"), "present").when(F.col("some"), "not_recorded").otherwise("undetermined")
    return met.select("side", "name", "path", "kind", "line", state.alias("other_side"))


def anchored_elsewhere(anchors: DataFrame, partner: DataFrame, most: int = STRING_MIN) -> DataFrame:
    """Functions that ``most`` anchors at least put with one function of the other side that is not their partner: diff_id, a, b, evidence.

    anchors: (diff_id, side, value, function); only a value that exactly one function of
    each side holds counts. partner: (diff_id, a, b). A pair is told where it is the
    partner of neither.
    """
    sole = anchors.groupBy("diff_id", "value").agg(*(F.min(F.when(F.col("side") == s, F.col("function"))).alias(s) for s in "ab"), *(F.max(F.when(F.col("side") == s, F.col("function"))).alias(f"{s}_last") for s in "ab"))
    one = sole.where("a = a_last AND b = b_last").groupBy("diff_id", "a", "b").agg(F.count("*").alias("evidence")).where(F.col("evidence") >= most)
    return one.join(partner.select("diff_id", "a", "b").distinct(), ["diff_id", "a", "b"], "left_anti")


def short_body(body: Column) -> Column:
    """Whether a body is too short to be told by itself: few lines, or nothing but returns after its first line, braces aside."""
    lines = F.filter(F.transform(F.split(text.skeleton(body), "\r\n|\r|\n"), F.trim), lambda x: x != "")
    rest = F.filter(F.slice(lines, 2, 1 << 30), lambda x: ~x.isin("{", "}"))
    return (F.size(lines) <= TWIN_MIN_LINES) | F.forall(rest, lambda x: x.startswith("return"))


def twins(bodies: DataFrame, partner: DataFrame, images: DataFrame) -> DataFrame:
    """Functions whose body stands on the other side, in another function than their partner: diff_id, side, function, count, target, basis.

    bodies: (diff_id, side, function, body, incomplete); partner: (diff_id, a, b); images:
    (diff_id, a, b), one row each, arrays of lo, hi where addresses may move. No row
    where the partner has this body, or nobody has. Without a target the basis says
    what first kept it back: decompile_incomplete, not_unique, short_body,
    literal_values_differ. Bodies meet by the hash of their skeleton, counted first, so
    a body of many copies is never paired.
    """
    known = bodies.where("body <> ''").select("diff_id", "side", "function", text.skeleton_key(F.col("body")).alias("key"), short_body(F.col("body")).alias("short"), text.large_literals(F.col("body")).alias("literals"), F.coalesce("incomplete", F.lit(False)).alias("incomplete"))
    one = known.groupBy("diff_id", "key", "side").agg(F.count("*").alias("n"), F.bool_or("incomplete").alias("cut"), F.min("function").alias("only"), F.min("literals").alias("literals"))
    there = one.select("diff_id", "key", _other().alias("side"), F.col("n").alias("count"), F.col("cut").alias("cut_there"), F.col("only").alias("there"), F.col("literals").alias("literals_there"))
    mate = lambda x, y: partner.select("diff_id", F.lit(x).alias("side"), F.col(x).alias("function"), F.col(y).alias("mate"))
    mates = mate("a", "b").unionByName(mate("b", "a"))
    held = known.select("diff_id", _other().alias("side"), F.col("function").alias("mate"), F.col("key").alias("mate_key"))
    own = known.join(one.select("diff_id", "key", "side", F.col("n").alias("own")), ["diff_id", "key", "side"])
    met = own.join(mates, ["diff_id", "side", "function"], "left").join(held, ["diff_id", "side", "mate"], "left").join(there, ["diff_id", "key", "side"]).join(images.select("diff_id", F.col("a").alias("image_a"), F.col("b").alias("image_b")), "diff_id", "left")
    mine = F.col("side") == "a"
    here = F.when(mine, F.col("image_a")).otherwise(F.col("image_b"))
    across = F.when(mine, F.col("image_b")).otherwise(F.col("image_a"))
    alike = review.same_literals(F.col("literals"), F.col("literals_there"), here, across) == "same"
    basis = (
        F.when(F.col("incomplete") | F.col("cut_there"), "decompile_incomplete")
        .when((F.col("own") != 1) | (F.col("count") != 1), "not_unique")
        .when(F.col("short"), "short_body")
        .when(~alike, "literal_values_differ")
    )
    return met.where("mate_key IS NULL OR mate_key <> key").select("diff_id", "side", "function", "count", F.when(basis.isNull(), F.col("there")).alias("target"), basis.alias("basis"))
