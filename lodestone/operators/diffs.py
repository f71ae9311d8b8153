"""Stored differences of two runs: what is aligned, what one side has alone, deltas, and their counts.

A row that could not be decided is kept apart from one that did not change, and what
one side lacks is never read as removed while its analysis has a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text

#: Kinds of a constant size.
CONSTANT_SIZES = ("const", "cap_const")
SIDES = ("both", "a_only", "b_only", "neither")


def deltas(stored: DataFrame, diff_id: str, binary: str | None = None, dimension: str | None = None, delta_kind: str | None = None) -> DataFrame:
    """A difference's deltas; those of candidates belong to the overlay and are left out."""
    asked = {"binary": binary, "dimension": dimension, "delta_kind": delta_kind}
    rows = stored.where((F.col("diff_id") == diff_id) & (F.col("subject_kind") != "candidate"))
    for column, value in asked.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def full_deltas(stored: DataFrame, capability: DataFrame) -> DataFrame:
    """Deltas, and one undecided row for each dimension that a difference could not look at.

    capability: (diff_id, dimension, state_a, state_b, delta_supported).
    """
    columns = ["diff_id", "dimension", "subject_kind", "subject_key", "delta_kind", "undetermined_scope", "undetermined_reason", "capability_ref"]
    absent = capability.where(~F.col("delta_supported") | (F.col("state_a") != "present") | (F.col("state_b") != "present"))
    why = F.when(~F.col("delta_supported"), "delta_not_implemented").otherwise("capability_absent")
    rows = absent.select("diff_id", "dimension", F.lit("dimension").alias("subject_kind"), F.col("dimension").alias("subject_key"), F.lit("delta_undetermined").alias("delta_kind"), F.lit("capability").alias("undetermined_scope"), why.alias("undetermined_reason"), F.col("dimension").alias("capability_ref"))
    return stored.select(*columns).unionByName(rows)


def counterparts(alignment: DataFrame, diff_id: str, function: str, side: str) -> DataFrame:
    """A function's pairs on the other side, by its name or its address in any spelling: the columns of alignment, how it was found, and whether several functions were."""
    if side not in ("a", "b"):
        raise ValueError(f"no side {side!r}; there are a, b")
    at, name = F.col(f"addr_{side}"), F.col(f"name_{side}")
    by_name, by_address = F.coalesce(name == function, F.lit(False)), F.array_contains(text.address_candidates(F.lit(function)), at.cast("decimal(20,0)"))
    found = alignment.where(F.col("diff_id") == diff_id).withColumn("matched_by", F.when(by_name & by_address, "name+addr").when(by_name, "name").when(by_address, "addr")).where("matched_by IS NOT NULL")
    several = found.agg((F.countDistinct(f"addr_{side}") > 1).alias("ambiguous"))
    return found.crossJoin(F.broadcast(several))  # one row


def browse(diffs: DataFrame, alignment: DataFrame, presence: DataFrame) -> DataFrame:
    """Each difference with its counts: aligned pairs, those below full similarity or without one, undecided pairs, and one-sided functions by side and state.

    Counts are made before they meet the differences; a difference that failed has none.
    """
    below = F.col("similarity").isNull() | (F.col("similarity") < 1)
    aligned = F.col("alignment_state") == "aligned"
    pairs = alignment.groupBy("diff_id").agg(F.count_if(aligned).alias("aligned"), F.count_if(aligned & below).alias("aligned_similarity_below_1"), F.count_if(~aligned).alias("alignment_undetermined"))
    states = presence.groupBy("diff_id", "side", F.coalesce("presence_state", F.lit("unrecorded")).alias("state")).agg(F.count("*").alias("n"))
    alone = states.groupBy("diff_id").agg(F.array_sort(F.collect_list(F.struct("side", "state", "n"))).alias("one_sided"))  # two sides by a few states
    out = diffs.join(pairs, "diff_id", "left").join(alone, "diff_id", "left")
    counts = ("aligned", "aligned_similarity_below_1", "alignment_undetermined")
    return out.select(*diffs.columns, *(F.when(F.col("diff_ok"), F.coalesce(c, F.lit(0))).alias(c) for c in counts), F.when(F.col("diff_ok"), F.coalesce("one_sided", F.array())).alias("one_sided"))


def side_presence(baseline: DataFrame, matched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions of one side that no pair holds, with what their analysis allows to say, and addresses of pairs that the inventory does not have.

    baseline: (diff_id, addr, name, size, decompiled, export_gap); matched: (diff_id, addr).
    """
    key = ["diff_id", "addr"]
    pairs = matched.select(*key).distinct()
    whole = F.col("export_gap").isNull() & F.col("size").isNotNull() & F.coalesce("decompiled", F.lit(False))
    alone = baseline.join(pairs, key, "left_anti").withColumn("presence_state", F.when(whole, "unmatched_analysis_complete").otherwise("unmatched_analysis_incomplete"))
    return alone, pairs.join(baseline.select(*key), key, "left_anti")


def size_delta(kind_a: Column, value_a: Column, kind_b: Column, value_b: Column) -> Column:
    """A constant size of one kind that has another value on side b; null for all else."""
    number = lambda v: F.when(F.lower(v).rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(F.lower(v), 3, 15), 16, 10).cast("long")).when(v.rlike("^-?[0-9]{1,18}$"), v.try_cast("long"))
    changed = kind_a.isin(*CONSTANT_SIZES) & (kind_a == kind_b) & (number(value_a) != number(value_b))
    return F.when(changed, F.struct(kind_a.alias("size_kind"), value_a.alias("from"), value_b.alias("to")))


def kind_shift(kind_a: Column, kind_b: Column) -> Column:
    """Another kind of size on side b, where both sides have one."""
    return F.when(kind_a != kind_b, F.struct(kind_a.alias("from_kind"), kind_b.alias("to_kind")))


def row_side(a: Column, b: Column) -> Column:
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(has(a) & has(b), "both").when(has(a), "a_only").when(has(b), "b_only").otherwise("neither")


def overlay_rows(rows: DataFrame, reason: str | None = None, side: str | None = None) -> DataFrame:
    """Overlay rows of a reason and a side."""
    if side is not None and side not in SIDES:
        raise ValueError(f"no side {side!r}; there are {', '.join(SIDES)}")
    rows = rows if reason is None else rows.where(F.col("presence_reason") == reason)
    return rows if side is None else rows.where(row_side(F.col("a_ref"), F.col("b_ref")) == side)


def overlay_summary(rows: DataFrame) -> DataFrame:
    """Overlay rows counted by presence, with reason, with side, by granularity, by class and by binary: grouping, key and count, from one pass."""
    reason = F.coalesce("presence_reason", F.lit("-"))
    keys = {
        "presence": F.col("presence"),
        "presence_reason": F.concat_ws("|", "presence", reason),
        "presence_reason_side": F.concat_ws("|", F.col("presence"), reason, row_side(F.col("a_ref"), F.col("b_ref"))),
        "key_granularity": F.col("key_granularity"),
        "sink_class": F.col("sink_class"),
        "binary": F.coalesce("binary", F.lit("(none)")),
    }
    # A few groupings: counted before anything is shuffled.
    listed = rows.select(F.explode(F.array(*(F.struct(F.lit(g).alias("grouping"), k.alias("key")) for g, k in keys.items()))).alias("k"))
    return listed.groupBy("k.grouping", "k.key").agg(F.count("*").alias("n"))


def overlay_order() -> list[Column]:
    """The order of overlay rows, which ranks nothing."""
    return [F.asc_nulls_first(c) for c in ("diff_id", "binary", "key_granularity", "sink_class", "a_ref", "b_ref")]


def not_represented(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """What breaks the law that an overlay holds every candidate of both sides (side, ref) once: side, ref and times it is held."""
    held = rows.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_ref").alias("ref")), F.struct(F.lit("b").alias("side"), F.col("b_ref").alias("ref")))).alias("r")).select("r.*").where("ref IS NOT NULL")
    both = candidates.select("side", "ref").distinct().withColumn("n", F.lit(0)).unionByName(held.withColumn("n", F.lit(1)))
    known = candidates.select("side", "ref").distinct().withColumn("known", F.lit(1))
    sums = both.groupBy("side", "ref").agg(F.sum("n").alias("times")).join(known, ["side", "ref"], "left")
    return sums.where((F.col("times") != 1) | F.col("known").isNull()).select("side", "ref", "times")


def staleness_summary(sides: DataFrame) -> DataFrame:
    """Differences by the reason for which a source is stale: reason and number of differences. sides: (diff_id, stale_reason)."""
    return sides.where("stale_reason IS NOT NULL").groupBy(F.col("stale_reason").alias("reason")).agg(F.countDistinct("diff_id").alias("diffs"))


def not_diffed(binaries: DataFrame, diffed: DataFrame) -> DataFrame:
    """Binaries (side, sha256, name) of no difference (name, sha256), with the reason: the other side has the same content, another of its name was compared, or it was not compared."""
    other = binaries.select(F.when(F.col("side") == "a", "b").otherwise("a").alias("side"), "sha256").distinct().withColumn("same", F.lit(True))
    names = diffed.select("name").distinct().withColumn("shadowed", F.lit(True))
    rows = binaries.join(diffed.select("sha256").distinct(), "sha256", "left_anti").join(other, ["side", "sha256"], "left").join(names, "name", "left")
    why = F.when(F.col("same"), "identical_on_other_side").when(F.col("shadowed"), "shadowed_by_name_collision").otherwise("binary_not_diffed")
    return rows.select("side", "sha256", "name", why.alias("reason"))


def changes_by_kind(files: DataFrame) -> DataFrame:
    """Compared files (kind, change) counted as a matrix of kinds and changes."""
    return files.groupBy("kind").pivot("change", ["same", "content_differs", "a_only", "b_only", "undetermined"]).count().na.fill(0)
