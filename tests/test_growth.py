"""Cases of a round's findings: queries on made tables against their SQL, and what their steps hold."""

import duckdb
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import refs
from lodestone.operators import calls, edges, graph
from lodestone.sources import textfiles


def above(df, *what):
    """The operators of a plan from its top down to the first of a kind, that included."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return "\n".join(lines[: next(i for i, x in enumerate(lines) if any(w in x for w in what)) + 1])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same_as_sql(spark, folder, name, **tables):
    """A query's rows on made tables (DuckDB SQL), which must be its SQL's."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert got == sorted(found.fetchall(), key=str)
    return got


def test_days_are_of_the_nearest_second(spark, tmp_path):
    at = ("1969-12-31 23:59:58.2", "2024-01-01 23:59:59.5", "2024-01-03 23:59:59.499999", "2024-01-05 00:00:00", "1970-01-01 23:59:59.7", "1969-12-29 10:00:00")
    events = " UNION ALL ".join(f"SELECT {i % 2}::BIGINT AS user_id, TIMESTAMP '{t}' AS ts" for i, t in enumerate(at))
    assert len(same_as_sql(spark, tmp_path, "gaps_islands", events=events)) == 5


def test_wishes_meet_counts_and_not_hits(spark):
    known = spark.createDataFrame([(i, "liba.so.1") for i in range(5)] + [(7, "libb.so"), (8, "libc.so.2"), (9, "libc.so.2"), (None, "libd.so"), (6, "libd.so.4"), (10, None)], "binary int, name string")
    wanted = spark.createDataFrame([(3, "liba.so.1"), (3, "liba.so.1"), (20, "liba.so.9"), (7, "libb.so"), (20, "libb.so.3"), (9, "libc.so.2"), (20, "libc.so"), (20, "libd.so"), (None, "libb.so"), (20, None)], "binary int, soname string")
    one, many = edges.resolve_names(wanted, known)
    assert sorted(map(tuple, one.collect())) == [(9, "libc.so.2", 8, 0), (20, "libb.so.3", 7, 1)]
    assert sorted(map(tuple, many.collect())) == [(3, "liba.so.1", [0, 1, 2, 4], 0), (20, "liba.so.9", [0, 1, 2, 3, 4], 1), (20, "libc.so", [8, 9], 1)]
    assert "collect_" not in one._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_not_shuffled_once_met(spark):
    many = edges.resolve_names(*(spark.createDataFrame([(i, "liba.so.1")], f"binary int, {c} string") for i, c in ((1, "soname"), (2, "name"))))[1]
    top = above(many, "Join")
    assert "Exchange" not in top and "Aggregate" not in top


def test_made_edges_are_distinct_without_an_aggregate(spark):
    calls = spark.createDataFrame([(1, "f"), (1, "f"), (2, "f"), (None, "f"), (3, None)], "binary int, name string")
    exports = spark.createDataFrame([(2, "f"), (2, "f"), (5, "f"), (None, "f"), (6, None)], "binary int, name string")
    made = edges.call_edges(calls, exports)[0]
    assert sorted(map(tuple, made.collect())) == [(1, 2, "f"), (1, 5, "f"), (2, 5, "f")]
    assert "Aggregate" not in above(made, "Join")


def test_pairs_are_counted_where_they_are_made(spark):
    held = [(b, v) for v, bs in (("/var/run/a", (1, 2, 3)), ("/var/run/b", (3, 1)), ("/var/run/c", range(60)), ("/var/run/d", (4,))) for b in bs]
    df = edges.shared_string_pairs(spark.createDataFrame([*held, (1, "/var/run/a"), (None, "/var/run/b")], "binary int, value string"))
    assert sorted(map(tuple, df.collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    top = above(df, "Generate")
    assert "explode" in top and "Exchange" not in top


def test_only_lines_with_a_rules_word_are_read(spark):
    body = "[A]\nToKen: x\nplain = words\nAPIKEY=1\n  [ b ]  \nbypass secret\nprivate_key k=v\nTLS on off\nsha hash = MD5\n"
    df = textfiles.config_entries(spark.createDataFrame([("a", body), ("b", "x = y\n[c]")], "path string, text string"))
    got = [(r.line, r.section, r.key, r.value, r.rule) for r in df.orderBy("line").collect()]
    assert got == [(1, "A", "ToKen:", "x", "hardcoded_credential"), (3, "A", "APIKEY", "1", "hardcoded_credential"), (7, " b ", "TLS", "on off", "weak_crypto_setting"), (8, " b ", "sha hash", "MD5", "weak_crypto_setting")]
    assert plan(df).count("regexp_extract(") <= 8


def test_claims_are_read_once(spark):
    rows = spark.createDataFrame([("r#b:10@cmd", 32, True), ("r#b:8@cmd", 32, True), ("r#b:10@cmd@0x20", 48, True), ("r#b:20@cmd", 48, True), ("none", 1, True), (None, None, None)], "evidence_ref string, callsite long, out_of_body boolean")
    df = refs.minted(rows)
    assert {r.evidence_ref: r.formal_ref for r in df.collect()} == {"r#b:10@cmd": "r#b:10@cmd", "r#b:8@cmd": "r#b:8@cmd@0x000018", "r#b:10@cmd@0x20": "r#b:10@cmd@0x20", "r#b:20@cmd": "r#b:20@cmd", "none": "none", None: None}
    assert "regexp" not in plan(df)


def test_chains_take_few_rounds(spark, monkeypatch):
    made, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: made.append((name, staged(df, name))) or made[-1][1])
    chain = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(7, 7), (40, 41), (50, 50), (None, 3), (60, None)], "src int, dst int")
    assert {r.node: r.component for r in graph.components(chain).collect()} == {**{i: 0 for i in range(21)}, 40: 40, 41: 40, 50: 50}
    # No table of all edges in both directions is kept, and what is left of them after a round is between its ends.
    assert [df.count() for name, df in made if name == "edges"] == [0]


def test_references_are_cut_at_their_marks(spark):
    texts = [":1f@cmd@-0x10", "r:q:1f@cmd_via_wrapper@0x8\n", "é:1@x#12", ":1@x\n\n", "1@x", ":1@@0x1", ":1@a@0x1#2", ":G@a"]
    df = spark.createDataFrame([(t,) for t in texts], "ref string").select(refs.ref_parts(F.col("ref")).alias("p"), refs.call_address(F.col("ref")).alias("a"))
    assert [(r.p and tuple(r.p), r.a) for r in df.collect()] == [((31, "cmd", -16, None), 15), ((31, "cmd_via_wrapper", 8, None), None), ((1, "x", None, 12), None), *[(None, None)] * 5]
    assert "regexp_extract" not in plan(df)


def test_identities_are_made_distinct_once(spark):
    at = "binary string, address long"
    tokens = spark.createDataFrame([("b", 1, "FUN_0010"), ("b", 1, "FUN_10"), ("b", 1, "FUN_10"), ("b", 2, "FUN_00000000000000000020"), ("b", 3, "FUN_11112222333344445"), ("b", 4, "FUN_30"), ("b", 5, "f"), ("b", 6, "")], at + ", token string")
    functions = spark.createDataFrame([("b", "f", 7), ("b", "f", 7), ("b", "FUN_30", 48), ("b", "FUN_30", 49)], "binary string, name string, address long")
    df = calls.call_identities(tokens, functions, spark.createDataFrame([("b", 16, "puts")], at + ", import string"), spark.createDataFrame([("b", 48), ("b", 48)], at))
    assert sorted((r.address, r.name, r.target and int(r.target), r.kind) for r in df.collect()) == [(1, "puts", 16, "stub_resolved"), (2, "FUN_00000000000000000020", 32, "fun_name_parsed"), (3, "FUN_11112222333344445", None, "name_only"), (4, "FUN_30", 48, "stub_unresolved"), (5, "f", 7, "table_entry")]
    assert "array_distinct" not in plan(df)
