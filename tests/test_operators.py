"""Cases of the operators that the driver's tables do not show."""

import json
import re

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import align, edges, graph, ledgers, rank, select
from lodestone.sources import files, textfiles
from lodestone.streaming import sessions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_config_sections_and_rules(spark):
    body = "; note\n[net]\npassword = x1\nbypass = y\n[svc]\ndebug on\ndebug=on\nssl_mode off\ncipher md5\n\n# x\nauth_required : no\n"
    df = spark.createDataFrame([("a.conf", body), ("b.conf", ""), ("c.conf", None)], "path string, text string")
    got = [(r.section, r.key, r.rule, r.sensitive) for r in textfiles.config_entries(df).orderBy("line").collect()]
    assert got == [("net", "password", "hardcoded_credential", True), ("svc", "debug", "debug_enabled", False), ("svc", "debug", "debug_enabled", False), ("svc", "cipher", "weak_crypto_setting", False)]


def test_endpoints_take_their_first_rule(spark):
    html = """<form action="/goform/a" method="post"><input name=u><input type="hidden" name="h"><textarea name='t'></textarea></form>
    fetch('/api/x'); axios.put("/api/y"); r.open("get", "/cgi-bin/z"); "/api/x" '/rest/q' <form><select name="s">"""
    df = spark.createDataFrame([("p", html), ("q", None)], "path string, text string")
    assert rows(textfiles.web_endpoints(df)) == [("p", "/api/x", None, "fetch"), ("p", "/api/y", "PUT", "axios"), ("p", "/cgi-bin/z", "GET", "xhr"), ("p", "/goform/a", "POST", "form"), ("p", "/rest/q", None, "literal")]
    assert rows(textfiles.form_fields(df)) == [("p", "s", "select"), ("p", "t", "textarea"), ("p", "u", "input")]


def test_line_pages_rejoin(spark):
    body = "\n".join("x" * (i % 9) for i in range(50))
    got = textfiles.line_pages(spark.createDataFrame([("p", body)], "path string, text string"), 40).orderBy("page").collect()
    assert "".join(r.text for r in got) == body and len(got) > 3 and all(len(r.text) <= 40 for r in got)


def test_folded_names_and_ledger(spark):
    exports = spark.createDataFrame([(i, "hot") for i in range(20)] + [(1, "cold"), (2, "cold")], "binary int, name string")
    calls = spark.createDataFrame([(i, "hot") for i in range(15, 25)] + [(1, "cold"), (9, "cold"), (9, "none")], "binary int, name string")
    made, ledger = edges.call_edges(calls, exports, edges=100)
    assert rows(made) == [(1, 2, "cold"), (9, 1, "cold"), (9, 2, "cold")]
    assert rows(ledger) == [("hot", 20, 10, 20 * 10 - 5)]
    made, ledger = edges.call_edges(calls, exports, edges=200)
    assert ledger.count() == 0 and made.where("name = 'hot'").count() == 195
    few = exports.where("binary < 15")
    assert edges.call_edges(calls, few, edges=1)[1].count() == 0
    assert edges.call_edges(calls.limit(0), exports.limit(0))[0].count() == 0


def test_name_tiers_and_own_name(spark):
    known = spark.createDataFrame([(1, "liba.so.1"), (2, "liba.so"), (3, "libb.so.2"), (4, "libb.so.2"), (5, "libc.so")], "binary int, name string")
    wanted = spark.createDataFrame([(9, "liba.so.1"), (9, "liba.so.7"), (9, "libb.so.2"), (5, "libc.so"), (9, "libz.so")], "binary int, soname string")
    one, many = edges.resolve_names(wanted, known)
    assert rows(one) == [(9, "liba.so.1", 1, 0)]
    assert rows(many) == [(9, "liba.so.7", [1, 2], 1), (9, "libb.so.2", [3, 4], 0)]


def test_strings_templates_formats_addresses(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    for v, want in [("AES_set_key", "crypto_hint"), ("/var/run/x", "ipc_sock"), ("mqtt://h", "url"), ("/etc/passwd", "path"), ("WAN_IP", "nvram_key"), ("n=%5d", "format_str"), ("", "misc"), (None, None), ("hi", "misc")]:
        assert one(text.string_class, v) == want
    assert [one(text.useful_shared_string, v) for v in ("/usr/lib", "/usr/lib/", "12345678", "short", "/var/run/a.sock")] == [False, False, False, False, True]
    pattern = one(text.template_pattern, "wl%d_key.%s")
    assert re.fullmatch(pattern, "wl0_key.a") and not re.fullmatch(pattern, "wlx_key.a") and not re.fullmatch(pattern, "wl0_keyxa")
    assert one(text.template_anchored, "%s_x") and not one(text.template_anchored, "%s%d")
    assert one(text.conversions, "%d %% %-5.3lf %*s") == ["d", "f", "s"] and one(text.arity, "%d %% %.*f %*s") == 5
    assert one(text.parse_address, "0x00010aFf") == 0x10AFF and one(text.parse_address, "zz") is None
    assert one(lambda c: text.hex_address(c.cast("long")), "68351") == "00010aff"
    assert one(text.skeleton, "f_00401234(0x40123456, 0x12)") == "f_@(0x#, 0x12)" and one(text.large_literals, "a(0x40123456)")[0] == 0x40123456


def test_pairing_of_files(spark):
    a = spark.createDataFrame([("/x", "1"), ("/y", "2"), ("/n", None), ("/old", "7"), ("/d1", "8"), ("/gone", "9")], "path string, sha256 string")
    b = spark.createDataFrame([("/x", "1"), ("/y", "3"), ("/n", "4"), ("/new", "7"), ("/d2", "8"), ("/d3", "8"), ("/null", None)], "path string, sha256 string")
    assert rows(align.pair_files(a, b)) == sorted([("/x", "/x", "path", "same"), ("/y", "/y", "path", "content_differs"), ("/n", "/n", "path", "undetermined"), ("/old", "/new", "sha256", "renamed"), ("/d1", None, "sha_ambiguous", "a_only"), (None, "/d2", "sha_ambiguous", "b_only"), (None, "/d3", "sha_ambiguous", "b_only"), ("/gone", None, "alone", "a_only"), (None, "/null", "alone", "b_only")], key=str)


def test_as_of_owner_delta(spark):
    points = spark.createDataFrame([("g", 5), ("g", 10), ("g", 16), ("h", 1)], "k string, at int")
    spans = spark.createDataFrame([("g", 4, 8, "f1"), ("g", 10, 12, "f2")], "k string, lo int, hi int, owner string")
    assert rows(align.owners(points, spans, ["k"], "at")) == [("g", 10, "f2"), ("g", 16, None), ("g", 5, "f1"), ("h", 1, None)]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "n"), (3, "q"), (5, "w")], "k int, v string")
    got = {r.k: r.state for r in align.delta(a, b, ["k"], "v", F.lit(True), F.lit(False)).collect()}
    assert got == {1: "unchanged", 2: "changed", 3: "undetermined", 4: "undetermined", 5: "added"}
    s = align.alignment_state(F.col("c"), F.col("g"), F.lit(None).cast("boolean"))
    assert [r[0] for r in spark.createDataFrame([(0.95, None), (0.8, None), (None, None), (0.95, True)], "c double, g boolean").select(s).collect()] == ["aligned", "undetermined", "undetermined", "undetermined"]


def test_unknown_is_never_zero(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "s string, n int")
    assert rows(df.groupBy("s").agg(ledgers.strict_sum(F.col("n")))) == [("a", None), ("b", 2)]
    grades = spark.createDataFrame([("web", None), ("cli", "x")], "e string, r string")
    assert select.resolved_for_all(grades, ["e", "r"]).first().asDict() == {"e": True, "r": False}
    assert [r.band for r in select.float_bands(grades.withColumn("e", F.lit("web+script")), {"e": "web"}, F.col("r") == "x").collect()] == [0, 2]
    assert select.current_generation(df, "n", ["s"]).count() == 2 and select.current_generation(df.where("n IS NULL"), "n").count() == 1
    assert select.with_columns_or_null(df, {"n": "long", "zz": "string"}).columns == ["n", "zz"]


def test_orders_and_fixpoints(spark):
    assert rank.parse_impact_order("cmd=copy,log") == {"cmd": 2, "copy": 2, "log": 1}
    places = spark.createDataFrame([("g", x) for x in (0, 4, 8, 20, 24, 5)], "g string, at int")
    assert rows(rank.islands(places, ["g"], "at", 4)) == [("g", 0, 8, 3), ("g", 20, 24, 2), ("g", 5, 5, 1)]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src int, dst int")
    assert rows(graph.closure(links, spark.createDataFrame([(1,), (5,)], "node int"))) == [(1, 1), (1, 2), (1, 3), (5, 6)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41)], "src int, dst int")
    assert {r.node: r.component for r in graph.components(chain).collect()} == {**{i: 0 for i in range(31)}, 40: 40, 41: 40}
    assert graph.components(chain.limit(0)).count() == 0


def test_image_inventory(spark, tmp_path):
    for name, data in {"bin/a": b"\x7fELFxx", "lib/b": b"\x7fELFxx", "etc/c": b"#!/bin/sh\n", "d.gz": b"\x1f\x8b\x00\xff", "t": b"text"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: (r.file_type, r.inventoried_as, r.not_inventoried_reason) for r in files.inventory(files.read_image(spark, str(tmp_path))).collect()}
    assert got == {"a": ("elf", "binary", None), "b": ("elf", None, "same_content_as_another"), "c": ("script", "text", None), "d.gz": ("gzip", None, "type_gzip"), "t": ("text", "text", None)}
    assert files.unique_binaries(files.read_image(spark, str(tmp_path))).first().copies == 2


def test_streamed_tally_equals_the_batch(spark, tmp_path):
    log = [{"at": f"2024-01-01T00:{m:02d}:00", "session": "s", "tool": t, "size": 10} for m, t in ((1, "a"), (2, "b"), (11, "a"))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, log)))
    stream = spark.readStream.schema("at timestamp, session string, tool string, size long").json(str(tmp_path / "in"))
    q = sessions.running_tally(stream, "at", "session", "tool", "size").writeStream.format("memory").queryName("tally").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.calls, r.tools, r.bytes) for r in spark.table("tally").orderBy("window_start").collect()] == [(2, 2, 20), (1, 1, 10)]
