"""What passes have read, judgements, upstream projects, one-sided binaries, other counterparts and keys through wrappers."""

from pyspark.sql import functions as F

from lodestone.functions import bodies, text
from lodestone.operators import calls, judgements, keyflow, presence, provenance, review, scans, upstream
from lodestone.plans.warehouse import Warehouse
from lodestone.sources import extracts
from lodestone.tools import Tools


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_binary_without_launches_has_a_status(spark):
    functions = spark.createDataFrame([("r", "a", "/a", ["system"], True, True), ("r", "a", "/a", ["system"], False, True), ("r", "b", "/b", None, False, None), ("r", None, None, ["system"], True, None)], "run_id string, binary string, path string, callees array<string>, has_text boolean, has_provenance boolean")
    edges = spark.createDataFrame([("r", "a"), ("r", "c"), ("r", None)], "run_id string, binary string")
    assert rows(scans.launch_status(functions, edges, ("system", "popen"))) == rows(spark.createDataFrame([("r", "a", "/a", False, 1), ("r", "b", "/b", True, 0), ("r", "c", None, True, 1), ("r", None, None, False, 1)], "a string, b string, c string, d boolean, e long"))
    status = spark.createDataFrame([(True, False, 0, 1, 0), (True, False, None, None, 2)], "scanned boolean, cap_hit boolean, found int, handler_unverified int, pairing_undetermined int")
    got = scans.scope_status(status).first()
    assert (got.statuses, got.not_scanned, got.found, got.handler_unverified, got.pairing_undetermined, got.reading) == (2, 0, 0, None, 2, "none")
    assert scans.scope_status(status.limit(0)).first().reading == "unknown"
    assert scans.scope_status(status.withColumn("cap_hit", F.lit(True))).first().reading == "unknown"
    binaries = spark.createDataFrame([("r", "a"), ("r", "z"), ("r", "z"), ("s", "a")], "run_id string, name string")
    assert rows(scans.without_status(binaries, edges)) == [("r", 1), ("s", 1)]


def test_no_reference_is_not_the_same_as_nobody_looked(spark):
    references = spark.createDataFrame([("a", True), ("a", None)], "scope string, truncated boolean")
    exports = spark.createDataFrame([("a", True), ("b", True), ("b", None), ("c", None)], "scope string, exported boolean")
    assert rows(scans.reference_state(references, exports)) == [("a", "found", 2, True), ("b", "no_resolved_dataref", 0, False), ("c", "string_refs_not_exported", 0, False)]


def test_unrecorded_is_never_zero(spark):
    data = [("r", True, 2, 3, 0, 1, None, None), ("r", True, 5, 0, 1, None, 1, 0), ("s", True, None, 4, 1, 1, 0, 0), ("s", False, 9, 9, 9, 9, 9, 9)]
    binaries = spark.createDataFrame(data, "run_id string, extracted boolean, created int, residual int, unowned int, recovered int, lost_bytes int, noreturn_flips int")
    got = {r.run_id: tuple(r)[1:] for r in scans.promotion_sums(binaries, ["run_id"]).collect()}
    assert got == {"r": (2, 0, 7, 3, 1, 1, 1, 1), "s": (1, 1, 0, 0, 0, 0, 1, 1)}
    gone = spark.createDataFrame([("r", True, 1, None, 0, 0, 0, 0)], binaries.schema)
    assert tuple(scans.promotion_sums(gone, ["run_id"]).first())[-2:] == (None, None)
    versions = spark.createDataFrame([("r", "1"), ("r", "1"), ("r", None), ("s", "1"), ("s", "2"), ("t", None)], "run_id string, v string")
    assert rows(scans.build_hash(versions, ["run_id"], "v")) == [("r", "1"), ("s", "mixed:2"), ("t", None)]


def test_unfinished_decompiles(spark):
    functions = spark.createDataFrame([("r", "x", 1, "timeout", None), ("r", "x", 2, "error", "payload_exceeded"), ("r", "x", 3, "ok", None), ("r", "x", 4, "skipped_micro", None), ("r", "x", 5, "error", None), ("s", "y", 10, "ok", None), ("s", "y", 20, "timeout", None)], "run_id string, sha256 string, address long, status string, error string")
    diffs = spark.createDataFrame([("d", "r", "x", "s", "y", True), ("bad", "r", "x", "s", "z", False)], "diff_id string, run_a string, sha_a string, run_b string, sha_b string, diff_ok boolean")
    alignment = spark.createDataFrame([("d", 1, 10, "aligned"), ("d", 2, 20, "aligned")], "diff_id string, addr_a long, addr_b long, alignment_state string")
    candidates = spark.createDataFrame([("s", "y", 10), ("s", "y", 10)], "run_id string, sha256 string, address long")
    got = {(r.run_id, r.address): (r.cause, r.other_address, r.counterpart, r.candidates) for r in scans.unfinished_decompiles(functions, diffs, alignment, candidates).collect()}
    assert got == {("r", 1): ("timeout", 10, "ok", 2), ("r", 2): ("payload_exceeded", 20, "timeout", None), ("r", 5): ("error", None, None, None), ("s", 20): ("timeout", 2, "payload_exceeded", None)}


def test_judgements_meet_their_subjects(spark):
    j = spark.createDataFrame([("d", "a", "safe", {"x": "1"}, False, False), ("d", "b", "safe", {"x": "1", "y": None}, False, False), ("d", "c", "safe", None, False, None), ("d", "gone", "safe", {}, False, False), ("d", "held", "safe", {}, True, False), ("d", "off", "safe", {"x": "1"}, False, False), ("d", "stale", "safe", {"x": "1"}, False, None)], "diff_id string, anchor_ref string, verdict string, facts map<string,string>, withheld boolean, source_stale boolean")
    s = spark.createDataFrame([("d", "a", {"x": "1"}, True), ("d", "b", {"x": "2", "z": "3"}, True), ("d", "c", {"x": "1"}, True), ("d", "off", {"x": "1"}, False), ("d", "stale", {"x": "1"}, False), ("d", "new", {}, True), ("d", "nobody", {}, False)], "diff_id string, anchor_ref string, facts map<string,string>, listed boolean")
    got = {r.anchor_ref: (r.state, r.moved) for r in judgements.judged(j, s).collect()}
    assert got == {"a": ("unchanged", []), "b": ("changed", ["x", "y", "z"]), "c": ("changed", ["x"]), "gone": ("anchor_unresolved", []), "held": ("diff_withheld", []), "off": ("subject_unlisted", []), "stale": ("unchanged", []), "new": ("unseen", [])}
    items = spark.createDataFrame([("d", "A", "unseen", None, "e1", 2), ("d", "A", "concluded", "safe", "e2", 1), ("d", "B", "unseen", None, "e3", 1), ("d", None, "open", "inconclusive", "e4", 0)], "diff_id string, bucket string, state string, verdict string, entry_id string, tier int")
    got = {(r.bucket, r.whole): (r.total, r.looked_at, r.not_looked_at, r.pages, r.pages_remaining) for r in judgements.progress(items, "diff_id", 2).collect()}
    assert got == {("A", False): (2, 1, 1, 1, 1), ("B", False): (1, 0, 1, 1, 1), (None, False): (1, 1, 0, 1, 0), (None, True): (4, 2, 2, 2, 1)}
    assert {(r.kind, r.value): r["items"] for r in judgements.tallies(items, "diff_id").collect()} == {("state", "unseen"): 2, ("state", "concluded"): 1, ("state", "open"): 1, ("verdict", "safe"): 1, ("verdict", "inconclusive"): 1}
    assert [r.entry_id for r in judgements.next_page(items, 5, ["tier"]).collect()] == ["e3", "e1"]
    assert [r.entry_id for r in judgements.next_page(items, 1, ["tier"], spark.createDataFrame([("e1", 0)], "entry_id string, position int")).collect()] == ["e1"]


def test_upstream_projects(spark):
    names = {"/lib/libssl.so.1.1": "openssl", "libcrypto.so": "openssl", "curl": "curl", "ip": "iproute2", "ip.so": None, "libuClibc-0.9.so": "uclibc", "libuClibc++-0.9.so": None, "web": None, "": None, None: None, "xlibz": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.l for r in df.select("n", upstream.library_of(F.col("n")).alias("l")).collect()} == names
    binaries = spark.createDataFrame([("s", "libssl.so", False), ("z", "libz.so.1", False), ("q", "libsqlite3.so", True), ("j", "libjson-c.so", False), ("w", "web", False), ("d", "dropbear", None)], "binary string, name string, strings_truncated boolean")
    strings = spark.createDataFrame([("s", "OpenSSL 1.0.2k  26 Jan"), ("s", "a OpenSSL 1.0.2k b"), ("z", "1.2.11"), ("z", " inflate 1.2.8 Copyright"), ("w", "OpenSSL 1.0.2k"), ("d", None), ("d", "dropbear_2019.78")], "binary string, value string")
    got = {r.binary: (r.library, r.version, r.reason, r.rule) for r in upstream.versions(binaries, strings).collect()}
    assert got == {"s": ("openssl", "1.0.2k", None, "OpenSSL <v>"), "z": ("zlib", "unknown", "several_versions", None), "q": ("sqlite", "unknown", "no_banner_string_in_what_was_kept", None), "j": ("json-c", "unknown", "no_banner_rule", None), "d": ("dropbear", "2019.78", None, "dropbear_<v>")}
    sides = upstream.versions(binaries, strings)
    diffs = spark.createDataFrame([("d1", "s", "s"), ("d2", "s", "z"), ("d3", "w", "d"), ("d4", "w", "w")], "diff_id string, binary_a string, binary_b string")
    both = upstream.combined(diffs, sides)
    assert rows(both) == [("d1", "openssl", False, "1.0.2k", "1.0.2k"), ("d2", None, True, "1.0.2k", "unknown"), ("d3", "dropbear", False, "unknown", "2019.78"), ("d4", None, False, "unknown", "unknown")]
    labelled = spark.createDataFrame([(f"d{i}", n, "openssl", "1", v) for i, (n, v) in enumerate([("b", "2"), ("a", "2"), ("c", "3")])] + [("e", "e", "zlib", "1", "1"), ("n", "n", None, "1", "1")], "diff_id string, binary string, library string, version_a string, version_b string")
    units = spark.createDataFrame([("d0", True, False), ("d0", False, True), ("e", True, None), ("n", True, True)], "diff_id string, must_read boolean, disposed boolean")
    got = [(r.library, r.diffs, r.units, r.must_read_units, r.open_units, r.first_diffs, [tuple(v) for v in r.versions]) for r in upstream.report(upstream.groups(labelled, units, 2)).collect()]
    assert got == [("openssl", 3, 2, 1, 1, ["d1", "d0"], [("1", "2", 2), ("1", "3", 1)]), ("zlib", 1, 1, 1, 1, ["e"], [("1", "1", 1)])]


def test_binaries_of_one_side(spark):
    binaries = spark.createDataFrame([("a", "web", "/bin/web", "1"), ("b", "web", "/x/web", "2"), ("a", "old", "/bin/old", "3"), ("a", "moved", "/bin/moved", "4"), ("b", "renamed", "/bin/renamed", "4"), ("a", "linked", "/bin/linked", "5"), ("a", "seen", "/bin/seen", "6"), ("a", "shadow", "/bin/shadow", "7"), ("b", "only", "/bin/only", None)], "side string, name string, path string, sha256 string")
    paths = spark.createDataFrame([("b", "/bin/linked")], "side string, path string")
    diffed = spark.createDataFrame([("a", "seen", None), ("a", "shadow", None)], "side string, name string, sha256 string")
    candidates = spark.createDataFrame([("a", "/bin/seen"), ("a", "/bin/seen")], "side string, path string")
    alone = presence.held_alone(binaries, paths, diffed, candidates)
    assert [(r[0], r[1], r[4]) for r in rows(alone)] == [("a", "old", 0), ("a", "seen", 2), ("b", "only", 0)]
    references = spark.createDataFrame([("a", "/rc", "script_call", " /bin/old ", 3), ("b", "/rc", "script_call", "/bin/x", 1), ("a", "/gone", "script_call", "old", 1), ("a", "/same", "web_endpoint", "/cgi/old?x=/y", None), ("a", "/mute", "web_endpoint", "/old#a?b", None), ("b", "/named", "script_call", "old", 9), ("a", "/named", "script_call", "old", 2)], "side string, path string, kind string, target string, line int")
    files = spark.createDataFrame([(s, p, h if p != "/same" else "k") for p in ("/rc", "/same", "/mute", "/named") for s, h in (("a", p), ("b", p + "2"))] + [("a", "/gone", "g")], "side string, path string, sha256 string")
    got = {r.path: r.other_side for r in presence.referenced_by(alone, references, files).where("name = 'old'").collect()}
    assert got == {"/rc": "not_recorded", "/gone": "file_absent", "/same": "present", "/mute": "undetermined", "/named": "present"}


def test_other_counterparts(spark):
    told = [("d", s, f"v{i}", f) for i in range(5) for s, f in (("a", "f"), ("b", "g"))] + [("d", "a", "v0", "f"), ("d", "a", "w", "f"), ("d", "b", "w", "h"), ("d", "b", "w", "g")]
    anchors = spark.createDataFrame(told, "diff_id string, side string, value string, function string")
    partner = spark.createDataFrame([("d", "f", "h")], "diff_id string, a string, b string")
    assert rows(presence.anchored_elsewhere(anchors, partner)) == [("d", "f", "g", 5)]
    assert presence.anchored_elsewhere(anchors, partner, 6).count() == 0
    assert presence.anchored_elsewhere(anchors, spark.createDataFrame([("d", "f", "g")], partner.schema)).count() == 0
    long = "int f(void)\n{\n a = 1;\n b = DAT_00401000;\n c = 0x401234;\n d = 2;\n return a;\n}"
    moved = long.replace("0x401234", "0x402234")
    data = [("d", "a", "f", long, None), ("d", "b", "g", moved, False), ("d", "b", "h", "int h(void)\n{\n return 1;\n}", None), ("d", "a", "s", "int h(void)\n{\n return 1;\n}", None), ("d", "a", "m", "x\n" * 9, None), ("d", "b", "m1", "x\n" * 9, None), ("d", "b", "m2", "x\n" * 9, None), ("d", "a", "p", "y\n" * 9, None), ("d", "b", "p", "y\n" * 9, None), ("d", "a", "i", "z\n" * 9, True), ("d", "b", "i2", "z\n" * 9, None), ("d", "a", "", "", None)]
    bodies = spark.createDataFrame(data, "diff_id string, side string, function string, body string, incomplete boolean")
    span = "array<struct<lo:long,hi:long>>"
    images = spark.createDataFrame([("d", [(0x400000, 0x500000)], [(0x400000, 0x500000)])], f"diff_id string, a {span}, b {span}")
    partner = spark.createDataFrame([("d", "f", "h"), ("d", "p", "p")], "diff_id string, a string, b string")
    got = {(r.side, r.function): (r["count"], r.target, r.basis) for r in presence.twins(bodies, partner, images).collect()}
    assert got == {("a", "f"): (1, "g", None), ("b", "g"): (1, "f", None), ("b", "h"): (1, None, "short_body"), ("a", "s"): (1, None, "short_body"), ("a", "m"): (2, None, "not_unique"), ("b", "m1"): (1, None, "not_unique"), ("b", "m2"): (1, None, "not_unique"), ("a", "i"): (1, None, "decompile_incomplete"), ("b", "i2"): (1, None, "decompile_incomplete")}
    unknown = {r.function: r.basis for r in presence.twins(bodies, partner, images.limit(0)).collect()}
    assert unknown["f"] == "literal_values_differ"


def test_keys_through_wrappers(spark):
    functions = spark.createDataFrame([("r", 1, "web", "/bin/web", "get"), ("r", 2, "web", "/bin/web", "main"), ("r", 3, "web", "/sbin/web", "main"), ("r", 4, "old", None, "get"), ("r", 5, "old", None, "main"), ("r", 6, "web", "/bin/web", "two"), ("r", 7, "web", "/bin/web", "two")], "run_id string, function_id int, binary string, path string, name string")
    wrappers = spark.createDataFrame([("r", 1, "read", "nv_get"), ("r", 4, "write", None), ("r", 6, "read", "x"), ("r", 7, "write", "x"), ("r", 2, "drop", "y")], "run_id string, function_id int, op string, api string")
    arguments = spark.createDataFrame([("r", 2, "get", "lan_ip", "constant"), ("r", 2, "get", "", "constant"), ("r", 2, "get", "wan%d_ip", "parametric"), ("r", 2, "get", "%s", "parametric"), ("r", 2, "get", "k", "unresolved"), ("r", 3, "get", "k", "constant"), ("r", 5, "get", "k", "constant"), ("r", 2, "two", "k", "constant"), ("r", 2, "main", "k", "constant")], "run_id string, function_id int, callee string, key string, key_kind string")
    got = rows(keyflow.wrapper_edges(functions, wrappers, arguments).select("key", "binary", "func", "op", "api", "via_wrapper"))
    assert got == [("k", "old", "main", "write", None, "get"), ("lan_ip", "web", "main", "read", "nv_get", "get"), ("wan%d_ip", "web", "main", "read", "nv_get", "get")]


def test_launches_and_string_edges(spark):
    edges = spark.createDataFrame([(1, "busybox"), (2, "usr/sbin/tool"), (3, None), (4, "rom/etc/svc.sh"), (5, "foobusybox")], "edge_id int, target_binary string")
    targets = spark.createDataFrame([("busybox",), ("/usr/sbin/tool",), ("tool",), ("/bin/busybox",), ("svc.sh",), ("/etc/svc.sh",)], "target string")
    assert rows(keyflow.launched_by(edges, targets).select("target", "edge_id")) == [("/bin/busybox", 1), ("/usr/sbin/tool", 2), ("busybox", 1), ("svc.sh", 4), ("tool", 2)]
    keyed = spark.createDataFrame([(1, "web", "/bin/web", "f"), (2, "web", None, "f"), (3, "web", "/sbin/web", "f"), (4, "x", None, "f")], "edge int, binary string, path string, callee string")
    wanted = spark.createDataFrame([("web", "/bin/web", "f")], "binary string, path string, function string")
    assert rows(keyflow.edges_reaching(keyed, wanted).select("edge", "matched_by")) == [(1, "path"), (2, "binary_name")]
    assert rows(keyflow.edges_reaching(keyed, wanted.withColumn("path", F.lit(None).cast("string"))).select("edge", "matched_by")) == [(1, "binary_name"), (2, "binary_name"), (3, "binary_name")]
    assert keyflow.edges_reaching(keyed, wanted.withColumn("binary", F.lit(None).cast("string"))).count() == 4
    assert keyflow.edges_reaching(keyed, wanted.withColumn("function", F.lit(""))).count() == 0


def test_constants_fill_formats_and_secrets_hide_text(spark):
    cases = [("%s '%s'", ["/usr/sbin/tool -j", None], "/usr/sbin/tool -j '%s'"), ("%d %s", ["1", "x"], "%d x"), ("%*s %s", ["a", "b", "c"], "%*s c"), ("100%% %s", ["x"], "100%% x"), ("%s", [], "%s"), ("", ["x"], ""), (None, ["x"], None), ("%-5s|", ["$1"], "$1|"), ("plain", None, "plain")]
    df = spark.createDataFrame(cases, "f string, v array<string>, want string")
    assert all(r.got == r.want for r in df.withColumn("got", text.fill_constants(F.col("f"), F.col("v"))).collect())
    hashed = "root:$6$abcdefgh$" + "x" * 20
    cases = [(["+" + hashed], True), (["@@ " + hashed], False), (["-s/$1$abc/"], False), ([" -----BEGIN RSA PRIVATE KEY-----"], True), ([], False), ([None, "+x"], False)]
    df = spark.createDataFrame(cases, "d array<string>, want boolean")
    assert all((r.got == "embedded_secret") == r.want for r in df.withColumn("got", text.shape_only(F.col("d"))).collect())


def test_sink_summary(spark):
    writer = "array<struct<writer:string,dominates:boolean,fmt:string>>"
    records = spark.createDataFrame([("e", "system", 16, "stack_buf", [("w1", True, None), ("w1", True, "%s"), ("w2", None, "x")], "w1"), ("e", "system", 32, None, None, None), ("e", "popen", 16, "unresolved", [], None)], f"ref string, sink string, sink_addr long, kind string, writers {writer}, nearest string")
    got = [tuple(r)[1:] for r in provenance.sink_summary(records.withColumn("c", F.struct(F.lit("system").alias("sink"), F.lit(16).alias("address"))), ["ref"], "c").collect()]
    assert got == [("system", 16, "stack_buf", True, 3, 2, "w1", "%s", True), ("system", 32, "unknown", True, None, None, None, None, False), ("popen", 16, "unresolved", False, 0, 0, None, None, False)]


def test_call_identities(spark):
    at = "binary string, address long"
    tokens = spark.createDataFrame([("b", i, t) for i, t in enumerate(["FUN_00001000", "FUN_00002000", "main", "two", "FUN_00003000", "puts", "FUN_00004000", "FUN_x", ""])] + [("b", 2, "main"), ("c", 0, "FUN_00001000")], f"{at}, token string")
    functions = spark.createDataFrame([("b", "main", 16), ("b", "main", 16), ("b", "two", 32), ("b", "two", 48), ("b", "FUN_00004000", 0x4000), ("b", "FUN_00002000", 0x2000)], "binary string, name string, address long")
    stubs = spark.createDataFrame([("b", 0x1000, "system")], f"{at}, import string")
    got = {(r.binary, r.address): (r.name, r.target and int(r.target), r.kind) for r in calls.call_identities(tokens, functions, stubs, spark.createDataFrame([("b", 0x2000)], at)).collect()}
    assert got == {("b", 0): ("system", 0x1000, "stub_resolved"), ("b", 1): ("FUN_00002000", 0x2000, "stub_unresolved"), ("b", 2): ("main", 16, "table_entry"), ("b", 3): ("two", None, "name_ambiguous"), ("b", 4): ("FUN_00003000", 0x3000, "fun_name_parsed"), ("b", 5): ("puts", None, "name_only"), ("b", 6): ("FUN_00004000", 0x4000, "table_entry"), ("b", 7): ("FUN_x", None, "name_only"), ("c", 0): ("FUN_00001000", 0x1000, "fun_name_parsed")}


def test_stamps(spark):
    df = spark.createDataFrame([({"a": "1", "b.c": "2", "d": "unknown", "e": "1"}, {"a": "1", "b.c": "3", "d": "1", "f": "1"}), (None, {"a": "1"})], "s map<string,string>, n map<string,string>")
    got = [r[0] for r in df.select(review.compare_stamps(F.col("s"), F.col("n"))).collect()]
    assert [tuple(x) for x in got[0].differing] == [("b.c", "2", "3")] and got[0].unknown == ["d", "e", "f"] and (got[1].differing, got[1].unknown) == ([], ["scan stamp"])
    files = [("p", "a", b"1"), ("p", "b", b"2"), ("q", "b", b"2"), ("q", "a", b"1"), ("r", "a", b"2")]
    stamps = {r.p: r.stamp for r in review.content_stamp(spark.createDataFrame([(p, n, bytearray(c)) for p, n, c in files], "p string, path string, content binary"), ["p"]).collect()}
    assert stamps["p"] == stamps["q"] != stamps["r"]


def test_tools_say_what_was_not_read(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    t = Tools(w)
    assert t.string_reference_state("x").first().state == "string_refs_not_exported" and t.pass_status("exec_argv").first().reading == "unknown" and t.launched_by("web").count() == 0
    fill = lambda name, **c: w.replace_runs(name, spark.range(1).select(*(F.lit(c.get(f.name)).cast(f.dataType).alias(f.name) for f in w.read(name).schema)))
    fill("detector_status", run_id="r", binary="web", detector="string_refs", scanned=True)
    assert t.string_reference_state("x").first().state == "no_resolved_dataref" and t.pass_status("string_refs", "r").first().reading == "none" and t.pass_statuses("string_refs").count() == 1
    fill("string_refs", run_id="r", sha256="a", value="x", ref_at=16, truncated=True)
    assert tuple(t.string_reference_state("x").first())[1:] == ("found", 1, True) and t.get_string_reference_anchors("x").first().ref_at == 16 and t.get_string_reference_anchors("xx").count() == 0
    fill("exec_edge", run_id="r", edge_id="1", launcher_binary="init", target_binary="usr/sbin/web")
    assert t.launched_by("/usr/sbin/web").first().launcher_binary == "init" and t.launched_by("web", "r").count() == 1 and t.launched_by("web", "s").count() == 0
    fill("string_edge", run_id="r", edge_id="1", binary="web", key="go", callee="f")
    assert t.get_string_keyed_edges(key="go").count() == 1 and t.get_string_keyed_edges(key="go", callee="g").count() == 0
    assert set(w.delete_run("r")) == {"detector_status", "string_refs", "exec_edge", "string_edge"}


def test_literal_arguments(spark):
    body = 'printf("a(%d,)", f(x, 1)); printf(buf); puts("printf(x)"); c = \'"\'; xprintf(y); printf("a" , "b"); open(p, 0'
    assert bodies.call_arguments(body, "printf") == [['"a(%d,)"', "f(x, 1)"], ["buf"], ['"a"', '"b"']] and bodies.call_arguments(body, "open") == [None] and bodies.call_arguments("f(f(1))", "f") == [["f(1)"], ["1"]]
    rows = [(body, "printf", [0], [True, False, True], False), ('rename("a", b)', "rename", [0, 1], [False], False), ('rename("a", L"b\\"c")', "rename", [0, 1], [True], True), ("x", "open", [0], [], False), (None, "open", [0], None, False), (body, "open", [0], [False], False), ("open()", "open", [0], [False], False), ("x", None, [0], None, False), ("x", "x", None, None, False)]
    df = spark.createDataFrame(rows, "body string, name string, at array<int>, want array<boolean>, exempt boolean").withColumn("got", bodies.literal_calls("body", "name", "at"))
    got = df.withColumn("all", bodies.all_literal(F.col("got"))).collect()
    assert all(r.got == r.want and r["all"] == r.exempt for r in got)
    assert {r.n: r.p for r in spark.createDataFrame([("rename",), ("openat",), ("puts",)], "n string").select("n", bodies.path_positions(F.col("n")).alias("p")).collect()} == {"rename": [0, 1], "openat": [1], "puts": None}


def test_table_accesses_and_listings(spark):
    entries = spark.createDataFrame([("a", "00001000", [("read", "1"), ("odd", "2"), ("store", "3")], 9, True), ("a", "00002000", [("arg", "4")], 1, None), ("a", "00003000", [("arg", "5")], 1, None), ("a", "00001000", None, 1, True)], "sha256 string, f string, rows array<struct<kind:string,obs:string>>, total int, truncated boolean")
    functions = spark.createDataFrame([("a", 0x1000), ("a", 0x2000)], "sha256 string, address long").select("sha256", F.col("address").cast("decimal(20,0)").alias("address"))
    got = sorted((int(r.address), r.seq, r.kind, r.obs) for r in extracts.table_accesses(entries, functions).collect())
    assert got == [(0x1000, 0, "read", "1"), (0x1000, 1, "store", "3"), (0x1000, 2, "truncated", '{"total":9,"kept":3}'), (0x2000, 0, "arg", "4")]
    known = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, ["listing"]), ("a", 4, ["other"]), ("b", 1, None)], "sha256 string, address long, errors array<string>")
    listings = spark.createDataFrame([("a", 1, ["mov"]), ("a", 2, None)], "sha256 string, address long, units array<string>")
    found = extracts.listing_state(known, listings, spark.createDataFrame([("a",)], "sha256 string"))
    assert {(r.sha256, r.address): r.state for r in found.collect()} == {("a", 1): "available", ("a", 2): "empty", ("a", 3): "export_error", ("a", 4): "not_stored", ("b", 1): "not_exported"}
