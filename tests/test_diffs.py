"""Stored differences, the candidate map and references, case by case."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import refs
from lodestone.operators import diffs, graph, lens
from lodestone.plans.warehouse import Warehouse
from lodestone.tools import Refusal, Tools


def test_refusals_and_views(spark):
    assert lens.refusal("to-verify", "impact", "reachable-only", ("source=nvram",)) is None
    for bad in ({"status": "done"}, {"sort_by": "size"}, {"view": "all"}, {"fragments": ("source",)}, {"fragments": ("colour=red",)}):
        assert lens.refusal(**bad)
    columns = "evidence_ref string, function string, sink_class string, sink_anchor string, status string, controllability string, controllability_state string, source string, source_kind string, reachability string, writer string, completeness string, proven_safe boolean"
    rows = [
        ("r1", "f", "cmd", "system", "to-verify", "unknown", None, "param", "free_string", "unknown", None, None, False),
        ("r2", "f", "cmd", "popen", "to-verify", "controllable", "likely", None, None, "unknown", None, None, False),
        ("r3", "f", "cmd", "system", "reachable", "controllable", "proven", None, None, "entry:web+script", None, None, None),
        ("r4", "f", "log", "syslog", "to-verify", "free", None, "nvram", None, "entry:web", "located", "complete", False),
        ("r5", "f", "cmd", "system", "to-verify", "controllable", "proven", None, None, "entry:web", None, None, True),
        ("r6", "f", "cmd", "system", "other", None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, columns)
    read = lambda *a, **k: [r.evidence_ref for r in (lambda x: x[0].orderBy(*x[1]))(lens.viewed(df, *a, **k)).collect()]
    assert read() == ["r3", "r2", "r1", "r6", "r4", "r5"]
    assert read("reachable-first") == ["r3", "r4", "r2", "r1", "r6", "r5"] == read("reachable-only")
    assert read("nvram-source")[0] == "r4" and read(fragments=("reachability=entry:script",))[0] == "r3"
    assert read(sort_by="reachability")[:2] == ["r3", "r4"]
    assert {r.evidence_ref for r in lens.filtered(df, sink="SYSTEM").collect()} == {"r1", "r3", "r5"}
    assert {r.evidence_ref for r in lens.filtered(df, status="reachable").collect()} == {"r3"} and lens.filtered(df).count() == 5
    with pytest.raises(ValueError):
        lens.viewed(df, "none")


def test_references_and_anchors(spark):
    df = spark.createDataFrame([("run#bin:00401000@cmd@-0x10",), ("run#bin:00401000@cmd_via_wrapper@0x8",), ("run#bin:00401000@cmd#3",), ("run#bin:00401000@cmd",), ("run#fn7",), (None,)], "ref string")
    got = df.select(refs.ref_parts(F.col("ref")).alias("p"), refs.call_address(F.col("ref")).alias("a"), refs.call_address(F.col("ref"), wrapped=True).alias("w")).collect()
    assert [tuple(r.p) if r.p else None for r in got] == [(0x401000, "cmd", -16, None), (0x401000, "cmd_via_wrapper", 8, None), (0x401000, "cmd", None, 3), (0x401000, "cmd", None, None), None, None]
    assert [(r.a, r.w) for r in got] == [(0x400FF0, None), (None, 0x401008), (None, None), (None, None), (None, None), (None, None)]
    made = spark.range(1).select(refs.anchor(F.lit("r1"), F.lit("r2"), "function_pair", F.lit("web"), F.lit("10"), F.lit("20")).alias("a"), refs.anchor(F.lit("r1"), F.lit("r2"), "binary_presence", F.lit("a_only"), F.lit("bin/x"), F.lit("10")).alias("b")).first()
    assert made == ("r1..r2#function_pair#web::10::20", "r1..r2#binary_presence#a_only:bin/x::10")
    split = spark.createDataFrame([made], "a string, b string").select(refs.split_anchor(F.col("b")).alias("s")).first().s
    assert tuple(split) == ("r1..r2", "binary_presence", "a_only:bin/x::10")


def test_sizes_and_kinds(spark):
    df = spark.createDataFrame([("const", "0x40", "const", "63"), ("const", "64", "const", "0x40"), ("const", "8", "cap_const", "9"), ("strlen", "a", "strlen", "b"), (None, None, "const", "1")], "ka string, va string, kb string, vb string")
    got = df.select(diffs.size_delta(F.col("ka"), F.col("va"), F.col("kb"), F.col("vb")).alias("d"), diffs.kind_shift(F.col("ka"), F.col("kb")).alias("s")).collect()
    assert [(r.d and tuple(r.d), r.s and tuple(r.s)) for r in got] == [(("const", "0x40", "63"), None), (None, None), (None, ("const", "cap_const")), (None, None), (None, None)]


def test_stored_differences(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    t = Tools(store)
    store.append("diff", spark.createDataFrame([("d1", "a", "b", "web", True, "ok", False), ("d2", "a", "b", "dns", False, "failed", False)], store.schema("diff")))
    from decimal import Decimal as D

    pairs = [("d1", D(16), D(32), "main", "main", 1.0, 1.0, "aligned"), ("d1", D(17), D(33), "twin", None, 0.9, None, "aligned"), ("d1", D(18), D(34), "twin", None, 0.2, 0.5, "alignment_undetermined")]
    store.replace_diffs("function_alignment", spark.createDataFrame(pairs, store.schema("function_alignment")), ["d1"])
    store.replace_diffs("function_presence", spark.createDataFrame([("d1", "a", D(99), "x", "unmatched_analysis_complete", True, None), ("d1", "b", D(98), None, None, None, None)], store.schema("function_presence")), ["d1"])
    deltas = [("d1", "key", "edge", "k1", "web", "1", "2", "layer_changed", None, None, None), ("d1", "key", "candidate", "k2", "web", "1", "2", "layer_changed", None, None, None), ("d9", "key", "edge", "k", "web", "1", "1", "layer_unchanged", None, None, None)]
    store.replace_diffs("dimension_delta", spark.createDataFrame(deltas, store.schema("dimension_delta")), ["d1", "d9"])
    store.replace_diffs("string_presence", spark.createDataFrame([("d1", "a", "s"), ("d1", "b", "s"), ("d1", "b", "new"), ("d1", "b", "new")], store.schema("string_presence")), ["d1"])
    listed = {r.diff_id: r for r in t.list_diffs("a").collect()}
    assert (listed["d1"].aligned, listed["d1"].aligned_similarity_below_1, listed["d1"].alignment_undetermined) == (2, 1, 1)
    assert [tuple(x) for x in listed["d1"].one_sided] == [("a", "unmatched_analysis_complete", 1), ("b", "unrecorded", 1)]
    assert listed["d2"].aligned is None and t.get_diff_meta("d1").count() == 1
    with pytest.raises(Refusal):
        t.get_diff_meta("d7")
    assert [r.subject_key for r in t.get_diff_deltas("d1", binary="web", dimension="key").collect()] == ["k1"]
    assert t.get_diff_deltas("d1", delta_kind="layer_unchanged").count() == 0
    assert [(r.side, r.value) for r in t.get_diff_string_delta("d1").collect()] == [("b", "new")]
    one = t.get_function_alignment("d1", "0x10", "a").collect()
    assert [(int(r.addr_b), r.matched_by, r.ambiguous) for r in one] == [(32, "addr", False)]
    assert [r.ambiguous for r in t.get_function_alignment("d1", "twin", "a").collect()] == [True, True]
    store.replace_diffs("function_alignment", spark.createDataFrame([], store.schema("function_alignment")), ["d1"])
    assert store.read("function_alignment").count() == 0 and store.read("dimension_delta").count() == 3
    assert store.delete_diff("d1") == ["function_presence", "dimension_delta", "string_presence"] and store.read("dimension_delta").count() == 1


def test_components_by_brute_force(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randint(0, 80), -rng.randint(1, 60)) for _ in range(70)] + [(5, 5), (7, 7)]
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == label
