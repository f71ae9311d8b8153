"""From extractor documents to answers."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import bodies
from lodestone.operators import keyflow, overlay
from lodestone.plans.warehouse import Warehouse
from lodestone.sources import extracts
from lodestone.tools import Refusal, Tools


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("wh")
    (root / "in").mkdir()
    docs = {
        "a": {"sha256": "aaaa11", "functions": [{"name": "main", "address": "0x401000", "size": 90, "is_exported": False, "callees": ["system", "helper"], "pseudocode": "void main(void)\n{\n  system(buf);\n}"}, {"name": "helper", "address": "00401100", "size": 4, "is_exported": True, "callees": [], "pseudocode": ""}], "imports": [{"func_name": "system", "lib_name": "libc.so"}], "exports": [{"func_name": "helper", "address": "00401100"}], "strings": [{"value": "/var/run/x.sock", "address": "00402000"}, {"value": "AES_key", "address": None}], "strings_total": 2, "strings_truncated": False},
        "b": {"sha256": "bbbb22", "functions": [{"name": "main", "address": "00401000", "size": 50, "callees": None, "pseudocode": ""}]},
        "c": {"sha256": "cccc33", "functions": []},
    }
    for k, d in docs.items():
        (root / "in" / f"{k}.json").write_text(json.dumps(d))
    (root / "in" / "bad.json").write_text('{"sha256": "dd')
    w = Warehouse(spark, str(root / "wh"))
    for name, rows in extracts.fact_tables(extracts.read_documents(spark, str(root / "in")), "r1").items():
        w.replace_runs(name, rows)
    binaries = [("r1", "aaaa11", "web", "/bin/web", None), ("r1", "bbbb22", "lib", "/lib/x", None), ("r1", "cccc33", "lib", "/lib/y", None)]
    w.replace_runs("binaries", spark.createDataFrame(binaries, "run_id string, sha256 string, name string, path string, arch string").withColumns({"size": F.lit(1).cast("long"), "last_seen_at": F.lit("2024-01-01").cast("timestamp"), "needed": F.array().cast("array<string>")}))
    found = w.add_patterns(spark.createDataFrame([("env", "cmd", "s1", "f1", "e1", "h1"), ("env", "cmd", "s1", "f1", "e2", "h2"), ("net", "copy", "s2", None, "e3", None)], "source_class string, sink_class string, shape string, fingerprint string, evidence_ref string, body_hash string"))
    w.add_patterns(found)
    w.replace_runs("instance", found.withColumns({"run_id": F.lit("r1"), "sink_anchor": F.lit("s"), "binary_path": F.lit("/bin/web"), "origin": F.lit("custom"), "status": F.lit("unknown")}))
    return w


def test_documents_become_tables_with_a_status(store):
    status = {r.sha256: r.status for r in store.read("extraction").collect()}
    assert status == {"aaaa11": "complete", "bbbb22": "partial", "cccc33": "no_functions", None: "unreadable"} or status["aaaa11"] == "complete" and "unreadable" in status.values()
    assert store.read("functions").count() == 3 and store.read("functions").where("address = 4198400").count() == 2
    assert {r.category for r in store.read("strings").collect()} == {"ipc_sock", "crypto_hint"}
    assert store.read("key_flow").count() == 0


def test_runs_are_replaced_and_deleted_alone(spark, store):
    rows = spark.createDataFrame([("r2", "x", "n", "l")], "run_id string, sha256 string, name string, library string")
    store.replace_runs("imports", rows)
    store.replace_runs("imports", rows)
    assert store.read("imports").where("run_id = 'r2'").count() == 1 and store.read("imports").where("run_id = 'r1'").count() == 1
    assert store.delete_run("r2") == ["imports"] and store.read("imports").count() == 1
    store.mark_run("r1", "in_progress")
    store.mark_run("r1", "complete")
    assert [(r.run_id, r.state) for r in store.runs().collect()] == [("r1", "complete")]
    with pytest.raises(ValueError):
        store.mark_run("r1", "done")


def test_questions(store):
    t = Tools(store)
    assert t.binary("aaaa11") == t.binary("/bin/web") == t.binary("web") == "aaaa11"
    with pytest.raises(Refusal, match="ambiguous"):
        t.binary("lib")
    with pytest.raises(Refusal, match="no binary"):
        t.binary("none")
    assert "system(buf)" in t.get_pseudocode("0x401000", "web").first().text
    with pytest.raises(Refusal):
        t.get_pseudocode("main")
    assert {(r.name, r.resolved) for r in t.get_callees("main", "web").collect()} == {("system", False), ("helper", True)}
    assert [(r.direction, r.function, r.basis) for r in t.get_xrefs("system").collect()] == [("caller", "main", "imported_name")]
    assert {(r.direction, r.function, r.basis) for r in t.get_xrefs("helper").collect()} >= {("caller", "main", "same_binary")}
    assert {r.function for r in t.get_xrefs("main").where("direction = 'callee'").collect()} == {"system", "helper"}
    assert t.get_strings(value="sock").count() == 1 and t.get_functions_referencing_string("system(").count() == 1
    assert {(r.table, r.name) for r in t.get_imports_exports("web").collect()} == {("imports", "system"), ("exports", "helper")}
    top = t.cross_run_patterns().first()
    assert (top.spread, top.breadth, top.instances) == (1, 2, 2)
    assert [r.candidates for r in t.pattern_density().collect()] == [2, 1]


def test_annotations_are_a_log(store):
    t = Tools(store)
    assert {r.state: r.candidates for r in t.coverage().collect()} == {"unseen": 3}
    overlay.annotate(store, [{"anchor_ref": "e1", "verdict": "safe", "rationale": "r", "basis": "unchanged"}, {"anchor_ref": "e3", "verdict": "exploitable", "rationale": "r", "basis": "changed"}])
    with pytest.raises(ValueError, match=r"\[1\]"):
        overlay.annotate(store, [{"anchor_ref": "e2", "verdict": "safe", "rationale": "r"}, {"anchor_ref": "e2", "verdict": "maybe", "rationale": "r"}])
    assert [r.evidence_ref for r in t.list_candidates(wanted={"sink_class": "cmd"}).collect()] == ["e3", "e2", "e1"]
    assert {r.state: r.candidates for r in t.coverage().collect()} == {"unseen": 1, "concluded": 1, "needs_recheck": 1}
    overlay.clear(store, [("candidate", "e3")])
    assert overlay.current(store.read("annotation")).count() == 1 and store.read("annotation").count() == 3


def test_key_flow_and_launches(spark):
    flow = spark.createDataFrame([("r", "wan_ip", "exact", "b", "f", "get"), ("r", "wl%d_key", "template", "b", "g", "get"), ("r", "%s", "template", "b", "h", "get")], "run_id string, key string, key_kind string, binary string, func string, op string")
    keys = spark.createDataFrame([("r", "wan_ip"), ("r", "wl0_key"), ("r", "zz"), ("r", "dflt")], "run_id string, key string")
    fields = spark.createDataFrame([("r", "wan_ip")], "run_id string, field string")
    defaults = spark.createDataFrame([("r", "dflt")], "run_id string, key string")
    assert {r.key: r.settable for r in keyflow.settable(keys, fields, flow, defaults).collect()} == {"wan_ip": "yes", "wl0_key": "uncertain", "zz": "uncertain", "dflt": "likely"}
    partial = defaults.unionByName(spark.createDataFrame([("r", None)], "run_id string, key string"))
    assert {r.settable for r in keyflow.settable(keys.where("key = 'dflt'"), fields, flow, partial).collect()} == {"uncertain"}
    assert {(r.key, r.by) for r in keyflow.key_users(flow, keys).collect()} == {("wan_ip", "exact"), ("wl0_key", "template")}
    launches = spark.createDataFrame([("httpd", "/bin/ls", True), ("httpd", "httpd", True), ("httpd", "x%s", False), ("httpd", "sh", True), ("httpd", "dup", True), ("httpd", "run.sh", True), ("httpd", "nope", True)], "caller string, token string, clean boolean")
    binaries = spark.createDataFrame([("ls", "/bin/ls"), ("dup", "/a/dup"), ("dup", "/b/dup")], "name string, path string")
    links = spark.createDataFrame([("sh", "/bin/busybox")], "name string, target string")
    scripts = spark.createDataFrame([("run.sh", "/etc/run.sh")], "name string, path string")
    got = {r.token: (r.state, r.target) for r in keyflow.launch_edges(launches, binaries, links, scripts).collect()}
    assert got == {"/bin/ls": ("direct", "/bin/ls"), "httpd": ("self", None), "x%s": ("unresolved", None), "sh": ("symlink", "/bin/busybox"), "dup": ("ambiguous_direct", None), "run.sh": ("script", "/etc/run.sh"), "nope": ("unmatched", None)}


def test_bodies(spark):
    assert bodies.text_delta("a\nb = 1;\nc", "a\nb = 2;\nc")["state"] == "substitution"
    assert bodies.text_delta("a\nc", "a\nb\nc")["state"] == "structural" and bodies.text_delta(None, "x") is None
    body = 'char *q = getenv("HOME");\nn = q;\nsprintf(buf, "ls %s", n);\nq = buf;\nk = other;'
    assert bodies.flows_into(body, "buf") == ["buf", "n", "q"] and bodies.flows_into(body, "k") == ["other"]
    assert bodies.arguments('a, f(b, c), "x,y", d[1,2]') == ["a", "f(b, c)", '"x,y"', "d[1,2]"]
    df = spark.createDataFrame([(body, "buf"), (None, "x")], "b string, v string")
    assert [r[0] for r in df.select(bodies.body_sources("b", "v")).collect()] == [["buf", "n", "q"], None]
    assert [r[0].state for r in df.select(bodies.body_delta("b", "b").alias("d")).collect()] == ["identical", None]


def test_logs_registries_settings_units(spark, tmp_path):
    lines = [{"ts": 1.0, "tool": "t", "session": "s", "page_rows": [0, 5, 10], "params": {"unit": "u"}}, {"ts": 2.0, "tool": "t", "session": "s", "page_rows": [5, 10, 10]}, {"ts": 3.0, "tool": "t", "session": "z", "page_rows": [6, 10, 10]}]
    (tmp_path / "log").write_text("\n".join([json.dumps(x) for x in lines] + ["not json", "{broken", "[]"]))
    log = extracts.read_tool_log(spark, str(tmp_path / "log"))
    assert log.count() == 3 and {r.session: r.whole for r in extracts.read_coverage(log, "session").collect()} == {"s": True, "z": False}
    good, bad = extracts.parse_registry(spark.createDataFrame([(1, "# c"), (2, "strcpy\tcopy\t0,1"), (3, "oops"), (4, "f\tcmd\tx")], "line int, value string"))
    assert good.first().positions == [0, 1] and sorted(r.line for r in bad.collect()) == [3, 4]
    assert extracts.settings({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}, environment={"LODESTONE_A__X": "9"}) == {"a": {"x": "9", "y": 3}}
    entries = spark.createDataFrame([(f"e{i:02d}", i == 20, i, "g") for i in range(40)], "entry string, must_read boolean, position int, g string")
    got = overlay.units(entries, ["g"], 3, 4).collect()
    assert sorted(e for u in got for e in u.entries) == [f"e{i:02d}" for i in range(40)] and sum(u.tier == 1 for u in got) == 4 and max(len(u.entries) for u in got) == 16
