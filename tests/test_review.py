"""Counterparts, landings, significance and claims, by their rules."""

from pyspark.sql import functions as F

from lodestone.operators import review


def test_counterparts(spark):
    span = "array<struct<lo:long,hi:long>>"
    rows = [(5, 4, [], [], []), (100, 10, [], [], []), (140, 10, [], [], []), (160, 10, [], [], []), (200, 10, [(1200, 1204)], [], []), (220, 10, None, [], []), (240, 10, [], [(1245, 1260)], []), (260, 10, [], [], [(1269, 1280)]), (280, 10, [], [], [])]
    unmatched = spark.createDataFrame([("d", *r) for r in rows], f"diff string, address long, size long, stubs {span}, leftovers {span}, undisassembled {span}")
    pairs = spark.createDataFrame([("d", 10, 1010), ("d", 150, 1150)], "diff string, address long, address_b long")
    functions = spark.createDataFrame([("d", 1100, 1120, "f", True, "function"), ("d", 1140, 1145, "g", False, "function"), ("d", 1160, 1170, "h", False, "stub")], "diff string, lo long, hi long, owner string, paired boolean, kind string")
    got = {r.address: (r.state, r.owner) for r in review.counterparts(unmatched, pairs, functions).collect()}
    assert got == {5: ("unmappable", None), 100: ("occupied", "f"), 140: ("unpaired", "g"), 160: ("occupied", "h"), 200: ("occupied", None), 220: ("coverage_unknown", None), 240: ("residual_code", None), 260: ("undisassembled_bytes", None), 280: ("uncovered", None)}


def test_reasons_and_landings(spark):
    cases = [(False, True, None, None, None, None, None, "instruction_unmatched", "B"), (False, None, None, None, None, None, None, "crossside_match_degraded", None), (True, True, True, "f", None, None, None, "callee_unreadable", "B"), (True, True, True, "f", "f", None, None, "persisted", None), (True, True, True, "f", "g", None, None, "present_different_callee", "A"), (True, True, False, "f", None, True, None, "crossgranularity_unresolved", "B"), (True, True, False, "f", None, False, "stale", "callsite_stale", "B"), (True, True, False, "f", None, False, None, "callsite_absent", "B")]
    df = spark.createDataFrame(cases, "m boolean, i boolean, c boolean, x string, y string, d boolean, s string, want string, bucket string")
    c = F.col
    out = df.withColumn("reason", review.overlay_reason(c("m"), c("i"), c("c"), c("x"), c("y"), c("d"), c("s"))).withColumn("l", review.landing(c("reason"), F.lit(False)))
    assert all(r.reason == r.want and r.l.bucket == r.bucket and not r.l.unmapped for r in out.collect())
    odd = spark.range(1).select(review.landing(F.lit("surprise"), F.lit(None).cast("boolean")).alias("l"), review.landing(F.lit("present_different_callee"), F.lit(None).cast("boolean")).alias("k")).first()
    assert (odd.l.bucket, odd.l.unmapped, odd.k.bucket) == ("B", True, "B")


def test_attention(spark):
    names = ("constant_delta", "callee_swap", "count_delta", "supported_lift", "no_visible_delta", "micro", "same_text", "judged_up", "lost_callers")
    for bucket, on, want in [("E", ("constant_delta",), 1), ("A", (), 0), ("B", ("constant_delta",), 0), ("B", ("callee_swap",), 0), ("R", ("callee_swap",), 1), ("R", ("supported_lift",), 0), ("S", (), 1), ("C", (), 2), ("C", ("lost_callers",), 1), ("R", ("same_text",), 1), ("B", ("same_text",), 2), ("B", (), 1)]:
        flags = {n: F.lit(True) if n in on else F.lit(None).cast("boolean") for n in names}
        assert spark.range(1).select(review.attention(F.lit(bucket), **flags)).first()[0] == want, (bucket, on)


def test_bodies_claims_staleness(spark):
    image = [(0x400000, 0x500000)]
    cases = [("f(0x401000)", "f(0x402000)", image, image, "same"), ("f(0x401000)", "f(0x902000)", image, image, "different"), ("f(0x401000)", "f(0x402000)", None, image, "unknown"), ("f(1)", "f(2)", image, image, "different"), ("f(0x401000)", "f(0x401000)", None, None, "same"), (None, "x", image, image, "unknown")]
    df = spark.createDataFrame(cases, "a string, b string, ia array<struct<lo:long,hi:long>>, ib array<struct<lo:long,hi:long>>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", review.same_body(F.col("a"), F.col("b"), F.col("ia"), F.col("ib"))).collect())
    claims = spark.createDataFrame([("f1", "g1", "key", None, None, None), ("f2", "g2", "strings", 0.5, 0.6, 0.7), ("f3", "g3", "strings", 0.9, 0.6, 0.95), ("f4", "g4", "same_body", None, None, None), ("f4", "g5", "key", None, None, None)], "a string, b string, basis string, ratio double, ratio_a double, ratio_b double")
    got = {(r.side, r.function): (r.conflict, r.superseded) for r in review.superseded(claims).collect()}
    assert got == {("a", "f1"): (False, True), ("b", "g1"): (False, True), ("a", "f3"): (False, False), ("b", "g3"): (False, False), ("a", "f4"): (True, False), ("b", "g4"): (True, False), ("b", "g5"): (True, False)}
    s = spark.createDataFrame([("1", "2", "x", "x"), (None, "2", "x", "y"), ("mixed:2", "2", "x", None)], "a string, b string, c string, d string")
    assert [r[0] for r in s.select(review.stale_by({"extraction": F.col("a"), "scan": F.col("c")}, {"extraction": F.col("b"), "scan": F.col("d")})).collect()] == ["extraction", "scan", None]
