"""Settings keys between front end and back end, and who launches what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text


def settable(keys: DataFrame, fields: DataFrame, flow: DataFrame, defaults: DataFrame) -> DataFrame:
    """Whether a user can set each key of a run: yes, likely or uncertain; there is no no.

    yes: an editable field has the key's name, exactly or with its index normalised,
    and the back end has it as a constant. likely: the defaults list it. Otherwise,
    and where the front end was not collected or the defaults hold a null, uncertain.
    """
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    front = fields.select("run_id", plain(F.col("field")).alias("plain")).distinct().withColumn("front", F.lit(True))
    back = flow.where("key_kind = 'exact'").select("run_id", "key").distinct().withColumn("back", F.lit(True))
    known = defaults.where("key IS NOT NULL").select("run_id", "key").distinct().withColumn("listed", F.lit(True))
    whole = defaults.groupBy("run_id").agg((F.count_if(F.col("key").isNull()) == 0).alias("complete"))
    found = keys.withColumn("plain", plain(F.col("key"))).join(front, ["run_id", "plain"], "left").join(back, ["run_id", "key"], "left").join(known, ["run_id", "key"], "left").join(whole, "run_id", "left")
    state = F.when(F.col("front") & F.col("back"), "yes").when(F.col("listed") & F.col("complete"), "likely").otherwise("uncertain")
    return found.select("run_id", "key", state.alias("settable"))


def key_users(flow: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the key flow that use each wanted key (run_id, key): the same constant, or a template that it fits.

    Templates are distinct first and meet only the keys of their own run, so the
    regular expressions are tried once for each template and key, not for each row.
    """
    exact = flow.where("key_kind = 'exact'").join(wanted, ["run_id", "key"]).select("run_id", "key", "binary", "func", "op", F.lit("exact").alias("by"))
    shapes = flow.where((F.col("key_kind") == "template") & text.template_anchored(F.col("key"))).select("run_id", F.col("key").alias("template")).distinct().withColumn("pattern", text.template_pattern(F.col("template")))
    fits = shapes.join(wanted, "run_id").where(F.expr("key RLIKE pattern"))
    return exact.unionByName(flow.where("key_kind = 'template'").withColumnRenamed("key", "template").join(fits, ["run_id", "template"]).select("run_id", "key", "binary", "func", "op", F.lit("template").alias("by")))


def launch_edges(launches: DataFrame, binaries: DataFrame, links: DataFrame, scripts: DataFrame) -> DataFrame:
    """What each launch (caller, token, clean) starts, by the token's base name: its state and target.

    self (its own name), unresolved (no clean constant), direct, symlink, script or
    unmatched; ambiguous_direct and ambiguous_symlink where a name has several paths.
    binaries, scripts: (name, path); links: (name, target).
    """
    base = F.element_at(F.split("token", "/"), -1)
    asked = launches.withColumn("name", base)
    of = lambda df, c, n: df.groupBy("name").agg(F.countDistinct(c).alias(f"{n}_paths"), F.min(c).alias(n))
    found = asked.join(of(binaries, "path", "binary"), "name", "left").join(of(links, "target", "link"), "name", "left").join(of(scripts, "path", "script"), "name", "left")
    state = F.when(F.col("name") == F.col("caller"), "self").when(~F.coalesce("clean", F.lit(False)), "unresolved").when(F.col("binary_paths") > 1, "ambiguous_direct").when(F.col("binary_paths") == 1, "direct").when(F.col("link_paths") > 1, "ambiguous_symlink").when(F.col("link_paths") == 1, "symlink").when(F.col("script").isNotNull(), "script").otherwise("unmatched")
    target = F.when(state == "direct", F.col("binary")).when(state == "symlink", F.col("link")).when(state == "script", F.col("script"))
    return found.select("caller", "token", state.alias("state"), target.alias("target"))


def wrapper_edges(functions: DataFrame, wrappers: DataFrame, arguments: DataFrame) -> DataFrame:
    """Keys that functions read or write through a thin wrapper of their own binary, one hop away.

    functions: (run_id, function_id, binary, path, name); wrappers: (run_id, function_id, op,
    api); arguments: (run_id, function_id, callee, key, key_kind) of calls with a constant.
    A binary is its path, or its name where it has none. Wrappers of one name that
    disagree resolve to nothing; so does a key that is unresolved, empty, or a template
    without an anchor.
    """
    scope = F.coalesce("path", F.concat(F.lit("name:"), "binary"))
    known = functions.select("run_id", "function_id", "binary", "path", F.col("name").alias("func"), scope.alias("scope"))
    meant = wrappers.where(F.col("op").isin("read", "write")).join(known, ["run_id", "function_id"]).where("func <> ''")
    told = F.struct("op", "api")
    sure = meant.groupBy("run_id", "scope", F.col("func").alias("callee")).agg(F.min(told).alias("w"), F.max(told).alias("x")).where("w <=> x").select("run_id", "scope", "callee", "w.op", "w.api")
    anchored = (F.col("key_kind") == "constant") | ((F.col("key_kind") == "parametric") & text.template_anchored(F.col("key")))
    passed = arguments.where((F.col("key") != "") & anchored).join(known, ["run_id", "function_id"])
    return passed.join(sure, ["run_id", "scope", "callee"]).select("run_id", "key", "key_kind", "binary", "path", "func", "op", "api", F.col("callee").alias("via_wrapper"))


def launched_by(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges (edge_id, target_binary) that launch each target (target), in any spelling that a reader has: as stored, from the root, by its last name.

    Every comparison is an equality: spellings are keys of one join, and a name never
    meets a longer one. An edge whose token resolved to nothing belongs to no target.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    whole = lambda c: F.struct(F.lit("whole").alias("by"), c.alias("spelling"))
    base = lambda c: F.struct(F.lit("last").alias("by"), c.alias("spelling"))
    t, stored = F.col("target"), F.col("target_binary")
    asked = targets.select("target", F.explode(F.array_distinct(F.array(whole(t), whole(F.regexp_replace(t, "^/+", "")), whole(last(t)), base(t)))).alias("s")).select("target", "s.*").distinct()
    held = edges.where("target_binary IS NOT NULL").select("*", F.explode(F.array(whole(stored), base(last(stored)))).alias("s")).select(*edges.columns, "s.*")
    return held.join(asked, ["by", "spelling"]).drop("by", "spelling").dropDuplicates(["target", "edge_id"])


def edges_reaching(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """String-keyed edges (binary, path, callee, ...) whose callee is a wanted function (binary, path, function), and by what they were met.

    path where both have one and it is the same; binary_name for an edge without a path,
    or a wanted function without one, by the binary's name; function_name where the
    wanted function has no binary. None is no proof that nothing reaches it.
    """
    asked = wanted.select(F.col("binary").alias("w_binary"), F.col("path").alias("w_path"), F.col("function").alias("callee")).where("callee <> ''").distinct()
    met = edges.join(asked, "callee")
    by_path = (F.col("w_path") != "") & (F.col("w_binary") != "")
    by = F.when(F.coalesce(by_path, F.lit(False)), F.when(F.col("path") == F.col("w_path"), "path").when(F.col("path").isNull() & (F.col("binary") == F.col("w_binary")), "binary_name")).when(F.coalesce(F.col("w_binary") != "", F.lit(False)), F.when(F.col("binary") == F.col("w_binary"), "binary_name")).otherwise("function_name")
    return met.withColumn("matched_by", by).where("matched_by IS NOT NULL")
