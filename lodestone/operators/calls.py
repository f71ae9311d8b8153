"""Call and dependency edges in layers, wrappers, stubs and groups of callers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import edges

#: How far an edge of each layer is trusted.
CONFIDENCE = {"call": 1.0, "import": 1.0, "needed": 0.9, "string": 0.5}


def import_edges(imports: DataFrame, exports: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of imports (binary, name, soname) to the binary behind their library: to its export of the name, else to the library alone (null name).

    Returns edges (caller, callee, name) and the ledger of libraries with several candidates.
    """
    one, many = edges.resolve_names(imports.select("binary", "soname").where("soname IS NOT NULL").distinct(), known)
    found = imports.join(one, ["binary", "soname"]).join(exports.select(F.col("binary").alias("target"), "name").distinct().withColumn("held", F.lit(True)), ["target", "name"], "left")
    return found.select(F.col("binary").alias("caller"), F.col("target").alias("callee"), F.when(F.col("held"), F.col("name")).alias("name")).distinct(), many


def needed_edges(binaries: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library edges of binaries (binary, needed array), and the ledger of ambiguous ones."""
    one, many = edges.resolve_names(binaries.select("binary", F.explode("needed").alias("soname")).distinct(), known)
    return one.select(F.col("binary").alias("caller"), F.col("target").alias("callee"), F.lit(None).cast("string").alias("name")).distinct(), many


def layered(**layers: DataFrame) -> DataFrame:
    """All layers' edges (caller, callee, name), each with its layer and confidence; repeated edges of a layer once."""
    marked = [df.select("caller", "callee", F.col("name").cast("string").alias("name"), F.lit(layer).alias("layer"), F.lit(CONFIDENCE[layer]).alias("confidence")) for layer, df in layers.items()]
    return reduce(DataFrame.unionByName, marked).distinct()


def wrapper_calls(functions: DataFrame, wrappers: DataFrame) -> DataFrame:
    """A row for each call (binary, caller, position) of a thin wrapper (binary, name, sink) of the same binary; wrappers do not propagate to themselves."""
    called = functions.select("binary", F.col("name").alias("caller"), F.posexplode("callees").alias("position", "callee"))
    return called.join(wrappers.select("binary", F.col("name").alias("callee"), "sink"), ["binary", "callee"]).where("caller <> callee")


def one_hop(made: DataFrame, functions: DataFrame) -> DataFrame:
    """Leads: functions that an edge's callee (callee_binary, callee_name) calls itself."""
    called = functions.select(F.col("binary").alias("callee_binary"), F.col("name").alias("callee_name"), F.explode(F.array_distinct("callees")).alias("lead"))
    return made.join(called, ["callee_binary", "callee_name"]).where("lead <> callee_name")


def runner_launches(calls: DataFrame, runners: DataFrame) -> DataFrame:
    """Launches through a runner: calls (binary, caller, callee, callee_binary null for its own) of functions (binary, name) that run what they are given."""
    home = F.coalesce("callee_binary", "binary")
    return calls.withColumn("home", home).join(runners.select(F.col("binary").alias("home"), F.col("name").alias("callee")), ["home", "callee"]).select("binary", "caller", "callee", "home", (F.col("home") != F.col("binary")).alias("across"))


def stub_ledger(a: DataFrame, b: DataFrame, complete_a: bool, complete_b: bool) -> DataFrame:
    """Import stubs (name) of two sides by name: both, a_only, b_only; undetermined where the other side's list is not complete."""
    both = a.select("name").distinct().withColumn("in_a", F.lit(True)).join(b.select("name").distinct().withColumn("in_b", F.lit(True)), "name", "full")
    return both.select("name", F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a_only" if complete_b else "undetermined").otherwise("b_only" if complete_a else "undetermined").alias("state"))


def callee_groups(pairs: DataFrame, partner: DataFrame) -> DataFrame:
    """Changed pairs that newly call the same function, two at least.

    pairs: (pair, name_b, callees_a, callees_b), null lists unread; partner: (name_a,
    name_b) of paired functions. A pair is a member of X if the b list names X and the
    a list does not name what X is paired with; pairs whose a list is unread are
    members listed apart. A function does not call itself here.
    """
    wanted = pairs.where("callees_b IS NOT NULL").select("pair", "name_b", "callees_a", F.explode(F.array_distinct("callees_b")).alias("x")).where("x <> name_b")
    met = wanted.join(partner.select("name_a", F.col("name_b").alias("x")), "x", "left")
    was = F.array_contains("callees_a", F.coalesce("name_a", "x"))
    new = met.where(F.col("callees_a").isNull() | ~was)
    out = new.groupBy("x").agg(F.array_sort(F.collect_set(F.when(F.col("callees_a").isNotNull(), F.col("pair")))).alias("members"), F.array_sort(F.collect_set(F.when(F.col("callees_a").isNull(), F.col("pair")))).alias("unread"))
    return out.where(F.size("members") + F.size("unread") >= 2)


def swapped_callees(pairs: DataFrame, partner: DataFrame) -> DataFrame:
    """Of each pair (pair, callees_a, callees_b) the callees that only one side has, a's named as in b."""
    a = pairs.select("pair", F.explode("callees_a").alias("name_a")).join(partner, "name_a", "left").select("pair", F.coalesce("name_b", "name_a").alias("callee"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = pairs.select("pair", F.explode("callees_b").alias("callee"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return a.unionByName(b).groupBy("pair", "callee").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("pair", "callee", F.when(F.col("a") == 1, "a").otherwise("b").alias("side"))


def facts_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields (subject, field, value) that two snapshots tell differently."""
    both = old.select("subject", "field", F.col("value").alias("was"), F.lit(True).alias("o")).join(new.select("subject", "field", F.col("value").alias("now"), F.lit(True).alias("n")), ["subject", "field"], "full")
    return both.where(F.col("o").isNull() | F.col("n").isNull() | ~F.col("was").eqNullSafe(F.col("now"))).select("subject", "field", "was", "now", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "dropped").otherwise("changed").alias("kind"))


def dimension_universe(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Every dimension that is declared or was found, and whether it is declared."""
    both = declared.select("dimension", F.lit(True).alias("declared")).unionByName(found.select("dimension", F.lit(False).alias("declared")))
    return both.groupBy("dimension").agg(F.max("declared").alias("declared"))


def call_identities(tokens: DataFrame, functions: DataFrame, stubs: DataFrame, unresolved: DataFrame) -> DataFrame:
    """What each call token (binary, address, token) names, by the first rule that applies: name, target and kind; each identity of an address once.

    functions: (binary, name, address); stubs: (binary, address, import) that a synthetic
    name's address resolves to; unresolved: (binary, address) of stubs that resolve to
    nothing, which come before the function table, as a stub may be in it too.
    stub_resolved, stub_unresolved, table_entry, name_ambiguous (no target),
    fun_name_parsed (the address that the name spells), name_only.
    """
    digits = F.substring("token", 5, 1 << 20)
    spelt = F.when(F.col("token").rlike(r"^FUN_[0-9a-fA-F]+\z") & (F.length(F.ltrim(digits, F.lit("0"))) <= 16), F.conv(digits, 16, 10).cast("decimal(20,0)"))
    # Read once, in an array of one; an identity's tokens and repeated ones are made one by the last step alone.
    asked = tokens.where("token <> ''").select("binary", "address", "token", F.explode(F.array(spelt)).alias("spelt"))
    at = lambda df, *c: df.select("binary", F.col("address").cast("decimal(20,0)").alias("spelt"), *c)
    named = functions.groupBy("binary", F.col("name").alias("token")).agg(F.min("address").alias("entry"), F.max("address").alias("top")).select("binary", "token", F.col("entry").cast("decimal(20,0)").alias("entry"), F.when(F.col("entry") == F.col("top"), 1).when(F.col("entry").isNull(), 0).otherwise(2).alias("n"))
    found = at(stubs, F.col("import"), F.lit(None).cast("boolean").alias("open")).unionByName(at(unresolved, F.lit(None).cast("string").alias("import"), F.lit(True).alias("open"))).groupBy("binary", "spelt").agg(F.min("import").alias("import"), F.max("open").alias("open"))
    met = asked.join(found, ["binary", "spelt"], "left").join(named, ["binary", "token"], "left")
    kind = F.when(F.col("import").isNotNull(), "stub_resolved").when(F.col("open"), "stub_unresolved").when(F.col("n") == 1, "table_entry").when(F.col("n") > 1, "name_ambiguous").when(F.col("spelt").isNotNull(), "fun_name_parsed").otherwise("name_only")
    target = F.when(kind == "table_entry", F.col("entry")).when(kind.isin("stub_resolved", "stub_unresolved", "fun_name_parsed"), F.col("spelt"))
    return met.select("binary", "address", F.coalesce("import", "token").alias("name"), target.alias("target"), kind.alias("kind")).distinct()
