"""Edges in layers, links, scripts, provenance, images."""

import struct

from pyspark.sql import functions as F

from lodestone.operators import calls, images, provenance
from lodestone.sources import scripts, symlinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_layers(spark):
    known = spark.createDataFrame([("L", "liba.so.1"), ("M", "libm.so"), ("N", "libm.so")], "binary string, name string")
    imports = spark.createDataFrame([("x", "f", "liba.so.1"), ("x", "gone", "liba.so.1"), ("x", "m", "libm.so"), ("x", "q", None)], "binary string, name string, soname string")
    exports = spark.createDataFrame([("L", "f")], "binary string, name string")
    made, many = calls.import_edges(imports, exports, known)
    assert rows(made) == [("x", "L", "f"), ("x", "L", None)] and rows(many) == [("x", "libm.so", ["M", "N"], 0)]
    needed, _ = calls.needed_edges(spark.createDataFrame([("x", ["liba.so.1"]), ("y", None)], "binary string, needed array<string>"), known)
    both = calls.layered(**{"import": made, "needed": needed})
    assert {(r.layer, r.name, r.confidence) for r in both.collect()} == {("import", "f", 1.0), ("import", None, 1.0), ("needed", None, 0.9)}


def test_wrappers_runners_and_leads(spark):
    functions = spark.createDataFrame([("b", "main", ["run", "run", "x"]), ("b", "run", ["system", "run"]), ("c", "main", ["run"])], "binary string, name string, callees array<string>")
    wrappers = spark.createDataFrame([("b", "run", "system")], "binary string, name string, sink string")
    assert [(r.caller, r.position) for r in calls.wrapper_calls(functions, wrappers).orderBy("position").collect()] == [("main", 0), ("main", 1)]
    made = spark.createDataFrame([("e", "b", "run")], "edge string, callee_binary string, callee_name string")
    assert rows(calls.one_hop(made, functions).select("edge", "lead")) == [("e", "system")]
    called = spark.createDataFrame([("a", "f", "run", "b"), ("b", "main", "run", None), ("c", "main", "run", None)], "binary string, caller string, callee string, callee_binary string")
    assert rows(calls.runner_launches(called, wrappers)) == [("a", "f", "run", "b", True), ("b", "main", "run", "b", False)]


def test_groups_swaps_stubs_facts(spark):
    pairs = spark.createDataFrame([("p1", "f1", ["old"], ["chk"]), ("p2", "f2", ["chk_a"], ["chk"]), ("p3", "f3", None, ["chk"]), ("p4", "chk", [], ["chk"]), ("p5", "f5", [], ["chk", "solo"]), ("p6", "f6", [], None)], "pair string, name_b string, callees_a array<string>, callees_b array<string>")
    partner = spark.createDataFrame([("chk_a", "chk")], "name_a string, name_b string")
    assert rows(calls.callee_groups(pairs, partner)) == [("chk", ["p1", "p5"], ["p3"])]
    swaps = rows(calls.swapped_callees(pairs.where("pair IN ('p1', 'p2')"), partner))
    assert swaps == [("p1", "chk", "b"), ("p1", "old", "a")]
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert rows(calls.stub_ledger(one("s", "t"), one("s", "u"), True, False)) == [("s", "both"), ("t", "undetermined"), ("u", "b_only")]
    old = spark.createDataFrame([("a", "x", "1"), ("a", "y", None), ("a", "z", "3")], "subject string, field string, value string")
    new = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("a", "w", None)], "subject string, field string, value string")
    assert rows(calls.facts_delta(old, new)) == [("a", "w", None, None, "added"), ("a", "y", None, "2", "changed"), ("a", "z", "3", None, "dropped")]
    dims = calls.dimension_universe(spark.createDataFrame([("a",)], "dimension string"), spark.createDataFrame([("a",), ("b",)], "dimension string"))
    assert rows(dims) == [("a", True), ("b", False)]


def test_links(spark):
    paths = spark.createDataFrame([(p,) for p in ("/bin", "/bin/busybox", "/etc", "/lib", "/lib/x")], "path string")
    links = [("/bin/sh", "busybox"), ("/bin/ls", "sh"), ("/etc/n", "/dev/null"), ("/etc/up", "../../x"), ("/etc/gone", "/no/such"), ("/etc/d", "missing"), ("/etc/a", "b"), ("/etc/b", "a"), ("/etc/l", "../lib/./x")]
    got = {r.path: (r.resolved, r.damage) for r in symlinks.classify(spark.createDataFrame(links, "path string, target string"), paths, chain=5).collect()}
    assert got == {"/bin/sh": ("/bin/busybox", None), "/bin/ls": ("/bin/busybox", None), "/etc/n": (None, "placeholder"), "/etc/up": (None, "escapes"), "/etc/gone": (None, "broken_parent"), "/etc/d": (None, "dangling"), "/etc/a": (None, "chain_limit"), "/etc/b": (None, "chain_limit"), "/etc/l": ("/lib/x", None)}


def test_shell(spark):
    cases = {"ls -l": ("ls", False, False), "A=1 B='x y' run": ("run", False, False), "sh -c 'cat /x | wc'": ("cat", True, True), "(cd /; ls)": ("cd", False, False), "/bin/sh -c \"A=1 tool\"": ("tool", False, True), "": ("", False, False), "a || b": ("a", False, False), "echo 'a|b'": ("echo", False, False)}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: tuple(r.s) for r in df.select("c", scripts.shell_command(F.col("c")).alias("s")).collect()} == cases
    body = "#!/bin/sh\n# httpd\nBIN=/usr/sbin/httpd\n$BIN -p 80 &\nif true; then dnsd; fi\nX=$1\n$X\n/opt/dnsd\necho httpd\n"
    got = scripts.launches(spark.createDataFrame([("/etc/rc", body)], "path string, text string"), spark.createDataFrame([("httpd", "/usr/sbin/httpd"), ("dnsd", "/bin/dnsd")], "name string, path string"))
    assert ("/etc/rc", 3, "/usr/sbin/httpd", "variable", "/usr/sbin/httpd") in rows(got) and ("/etc/rc", 4, "dnsd", "literal", "/bin/dnsd") in rows(got) and all(r.line != 7 for r in got.collect())


def test_provenance(spark):
    data = [("buffer", ["controllable", "const"], ["controllable"], None, "controllable"), ("buffer", ["const"], ["const"], None, "const"), ("buffer", ["const"], ["const"], True, "unknown"), ("buffer", ["const", None], ["const"], None, "unknown"), ("buffer", ["free", "constrained"], [], None, "free"), ("buffer", [], [], None, "unknown"), ("const", [], [], None, "const")]
    df = spark.createDataFrame(data, "k string, c array<string>, d array<string>, w boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", provenance.fold_record(F.col("k"), F.col("c"), F.col("d"), F.col("w"))).collect())
    cases = [(["const", "const"], True, "const"), (["const"], False, "unknown"), (["const", "likely"], True, "likely"), ([], True, "unknown"), (["free", "constrained"], True, "free")]
    df = spark.createDataFrame(cases, "r array<string>, a boolean, want string").withColumn("got", provenance.controllability(F.col("r"), F.col("a")))
    assert all(r.got == r.want for r in df.collect())


def test_images(spark):
    data = struct.pack("<8I", 0x1000, 7, 0x1004, 8, 0x1008, 9, 0x100C, 10) + b"\x01"
    blocks = spark.createDataFrame([("b", 0x2000, bytearray(data)), ("b", 0x3001, bytearray(b"abc" + struct.pack("<I", 5)))], "binary string, address long, data binary")
    found = images.words(blocks)
    assert [(r.address, r.value) for r in found.orderBy("address").collect()][:2] == [(0x2000, 0x1000), (0x2004, 7)] and found.where("address = 12292").first().value == 5
    cut = images.records(found.where("address < 12288"), 0x2008, 8)
    assert {(r.record, r.offset): r.value for r in cut.collect()}[(0, 0)] == 0x1004 and cut.count() == 8
    entries = spark.createDataFrame([("b", 0x1000 + 4 * i) for i in range(4)], "binary string, value long")
    assert rows(images.entry_runs(found, entries)) == [("b", 8, 0x2000, 4, 4)]
