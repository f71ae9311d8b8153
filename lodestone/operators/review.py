"""Reading a difference of two runs: counterparts, landings, significance, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import align, graph


def overlaps(lo: Column, hi: Column, spans: Column) -> Column:
    """Whether [lo, hi] meets any span (array of lo, hi inclusive); null for spans that are not known."""
    return F.exists(spans, lambda s: (s["lo"] <= hi) & (lo <= s["hi"]))


def counterparts(unmatched: DataFrame, pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """Where each unmatched function (diff, address, size) of one side would be on the other, and what is there.

    pairs: (diff, address, address_b); functions of the other side: (diff, lo, hi, owner,
    paired, kind) with kind function or stub. Columns of ``unmatched`` stubs, leftovers
    and undisassembled (arrays of spans of the other side, null unknown) decide what is
    no function: unmappable without a pair at or below; occupied by a paired function
    or a stub; unpaired; coverage_unknown; residual_code; undisassembled_bytes; uncovered.
    """
    near = align.as_of(unmatched, pairs, ["diff"], "address", ["address_b"])
    placed = near.withColumn("there", F.col("asof_address_b") + F.col("address") - F.col("asof_address")).drop("asof_address", "asof_address_b")
    points = placed.withColumnRenamed("address", "own_address").withColumnRenamed("there", "address")
    spans = functions.select("diff", F.col("lo").alias("address"), "hi", F.struct("owner", "paired", "kind").alias("o"))
    found = align.as_of(points, spans, ["diff"], "address", ["hi", "o"])
    owner = F.when(F.col("address") <= F.col("asof_hi"), F.col("asof_o"))
    end = F.col("address") + F.greatest(F.col("size"), F.lit(1)) - 1
    state = (
        F.when(F.col("address").isNull(), "unmappable")
        .when(owner.isNotNull(), F.when(owner["paired"] | (owner["kind"] == "stub"), "occupied").otherwise("unpaired"))
        .when(F.coalesce(overlaps(F.col("address"), F.col("address"), F.col("stubs")), F.lit(False)), "occupied")
        .when(F.col("stubs").isNull() | F.col("leftovers").isNull(), "coverage_unknown")
        .when(overlaps(F.col("address"), end, F.col("leftovers")), "residual_code")
        .when(F.coalesce(overlaps(F.col("address"), end, F.col("undisassembled")), F.lit(False)), "undisassembled_bytes")
        .otherwise("uncovered")
    )
    # The state is worked out before "address" is given to another column.
    return found.withColumn("state", state).withColumn("owner", owner["owner"]).select("diff", "own_address", "address", "owner", "state").toDF("diff", "address", "there", "owner", "state")


def overlay_reason(matched: Column, has_instructions: Column, candidate: Column, callee: Column, callee_b: Column, degraded: Column, site: Column) -> Column:
    """Whether a candidate is still there at its matched instruction, by the first that holds.

    ``candidate`` says that there is one at the match, ``degraded`` that only a coarser
    one is; ``site`` is the call-site fact that is left otherwise: absent, stale, none,
    ambiguous, unresolved, same or different.
    """
    return (
        F.when(~matched, F.when(F.coalesce(has_instructions, F.lit(False)), "instruction_unmatched").otherwise("crossside_match_degraded"))
        .when(candidate, F.when(callee_b.isNull(), "callee_unreadable").when(callee == callee_b, "persisted").otherwise("present_different_callee"))
        .when(degraded, "crossgranularity_unresolved")
        .otherwise(F.concat(F.lit("callsite_"), F.coalesce(site, F.lit("absent"))))
    )


def landing(reason: Column, same_callee_elsewhere: Column) -> Column:
    """The bucket of an overlay row; null for rows that stay unbucketed; an unknown reason lands in B and says so in ``unmapped``."""
    unbucketed = reason.isin("persisted", "crossside_match_degraded")
    different = reason.isin("present_different_callee", "callsite_different")
    known = reason.isin("instruction_unmatched", "callee_unreadable", "crossgranularity_unresolved", "count_mismatch", "callsite_absent", "callsite_stale", "callsite_none", "callsite_ambiguous", "callsite_unresolved", "callsite_same")
    bucket = F.when(unbucketed, None).when(different, F.when(same_callee_elsewhere.eqNullSafe(F.lit(False)), "A").otherwise("B")).when(reason == "function_unmatched", "P").when(reason == "low_confidence", "R").otherwise("B")
    return F.struct(bucket.alias("bucket"), (~(unbucketed | different | known | reason.isin("function_unmatched", "low_confidence"))).alias("unmapped"))


def attention(bucket: Column, constant_delta: Column, callee_swap: Column, count_delta: Column, supported_lift: Column, no_visible_delta: Column, micro: Column, same_text: Column, judged_up: Column, lost_callers: Column) -> Column:
    """How soon an entry is to be read, 0 first: the first that holds."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(bucket == "E", 1)
        .when((bucket == "A") | yes(constant_delta), 0)
        .when((bucket != "R") & (yes(callee_swap) | yes(count_delta)), 0)
        .when((bucket == "R") & yes(supported_lift), 0)
        .when(yes(no_visible_delta) | (bucket == "S") | yes(micro), 1)
        .when(yes(same_text) | (bucket == "C"), F.when((bucket == "R") | yes(judged_up) | yes(lost_callers), 1).otherwise(2))
        .otherwise(1)
    )


def same_literals(la: Column, lb: Column, image_a: Column, image_b: Column) -> Column:
    """same, different or unknown by two bodies' large literals, each in its own side's image (see ``same_body``)."""
    within = lambda v, image: F.exists(image, lambda s: (s["lo"] <= v) & (v < s["hi"]))
    moved = F.forall(F.zip_with(la, lb, lambda x, y: (x == y) | (within(x, image_a) & within(y, image_b))), lambda ok: ok)
    return F.when(F.size(la) != F.size(lb), "different").when(la == lb, "same").when(image_a.isNull() | image_b.isNull(), "unknown").when(moved, "same").otherwise("different")


def same_body(a: Column, b: Column, image_a: Column, image_b: Column) -> Column:
    """same, different or unknown by skeletons and large literals.

    Literals at one place may differ only when both values lie in their own side's
    image (arrays of lo, hi, half open; null unknown).
    """
    literals = same_literals(text.large_literals(a), text.large_literals(b), image_a, image_b)
    return F.when(a.isNull() | b.isNull(), "unknown").when(text.skeleton(a) != text.skeleton(b), "different").otherwise(literals)


def standing_claims(claims: DataFrame) -> DataFrame:
    """Claims (a, b, basis, ratio, ratio_a, ratio_b) that two functions belong together and stand.

    Those by key or same body stand; those by strings alone stand if their ratio beats
    the lower of both functions' present ones, or a ratio is not known.
    """
    lower = F.least("ratio_a", "ratio_b")
    unread = F.col("ratio").isNull() | F.col("ratio_a").isNull() | F.col("ratio_b").isNull()
    return claims.where(F.col("basis").isin("key", "same_body") | unread | (F.col("ratio") > lower))


def superseded(claims: DataFrame) -> DataFrame:
    """Members (side, function) of connected standing claims: their component, whether it has a conflict, and whether they are superseded.

    A conflict is a function with two counterparts; a member is superseded where there
    is none and all its claims are by key or same body.
    """
    made = standing_claims(claims).select(F.concat(F.lit("a:"), "a").alias("src"), F.concat(F.lit("b:"), "b").alias("dst"), F.col("basis").isin("key", "same_body").alias("firm"))
    both = made.unionByName(made.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "firm"))
    degree = both.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("counterparts"), F.bool_and("firm").alias("firm"))
    members = graph.components(made).join(degree, "node")
    conflict = members.groupBy("component").agg((F.max("counterparts") > 1).alias("conflict"))
    return members.join(conflict, "component").select(F.substring("node", 1, 1).alias("side"), F.expr("substring(node, 3)").alias("function"), "component", "conflict", (~F.col("conflict") & F.col("firm")).alias("superseded"))


def stale_by(stored: dict[str, Column], now: dict[str, Column]) -> Column:
    """The first axis on which two known stamps differ; null if none does, as unknown never means stale."""
    out = F.lit(None).cast("string")
    for axis in reversed(list(stored)):
        a, b = stored[axis], now[axis]
        known = a.isNotNull() & b.isNotNull() & ~a.startswith("mixed:") & ~b.startswith("mixed:")
        out = F.when(F.coalesce(known & (a != b), F.lit(False)), axis).otherwise(out)
    return out


def compare_stamps(stored: Column, now: Column) -> Column:
    """Leaves (maps of path to value) on which a stored stamp differs from the present one, and those that cannot be compared: on one side only, or unknown on one; a stamp that is null is unknown as a whole."""
    names = F.array_sort(F.array_union(F.map_keys(stored), F.map_keys(now)))
    value = lambda m, k: F.try_element_at(m, k)
    known = lambda m, k: F.coalesce(value(m, k) != "unknown", F.lit(False))
    open_ = F.filter(names, lambda k: ~(known(stored, k) & known(now, k)))
    moved = F.filter(names, lambda k: known(stored, k) & known(now, k) & (value(stored, k) != value(now, k)))
    told = F.transform(moved, lambda k: F.struct(k.alias("leaf"), value(stored, k).alias("was"), value(now, k).alias("now")))
    whole = stored.isNotNull() & now.isNotNull()
    return F.struct(F.when(whole, told).otherwise(F.array()).alias("differing"), F.when(whole, open_).otherwise(F.array(F.lit("scan stamp"))).alias("unknown"))


def content_stamp(files: DataFrame, by: list[str]) -> DataFrame:
    """One hash of each program's files (path, content), whatever their order."""
    # A program's own sources: few and small, and only their hashes meet.
    each = files.select(*by, F.struct("path", F.sha2("content", 256).alias("digest")).alias("f"))
    return each.groupBy(*by).agg(F.sha2(F.to_json(F.array_sort(F.collect_list("f"))), 256).alias("stamp"))
