"""Edges between binaries, with ledgers of what is folded or ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.plans.staging import staged

#: Exporters of one name from which it may be folded, and edges above which it is.
FOLD_EXPORTERS = 16
FOLD_EDGES = 25_000


def fold_plan(calls: DataFrame, exports: DataFrame, edges: int = FOLD_EDGES, exporters: int = FOLD_EXPORTERS) -> DataFrame:
    """Per exported name: exporters, callers and whether its edges are folded. calls: (binary, name); exports: (binary, name)."""
    out = exports.groupBy("name").agg(F.count("*").alias("exporters"))
    return out.join(calls.groupBy("name").agg(F.count("*").alias("callers")), "name").withColumn("folded", (F.col("exporters") >= exporters) & (F.col("callers") * F.col("exporters") > edges))


def call_edges(calls: DataFrame, exports: DataFrame, edges: int = FOLD_EDGES, exporters: int = FOLD_EXPORTERS) -> tuple[DataFrame, DataFrame]:
    """Edges (caller, callee, name) to every other binary that exports the name, and the ledger of names that are folded.

    A folded name's ledger row counts the edges it would have: of each caller all
    exporters, less one if the caller's own binary is among them. Names are counted
    before any join, so no name that fans out too far is ever joined.
    """
    plan = fold_plan(calls, exports, edges, exporters)
    kept = plan.where("NOT folded").select("name")
    # Both sides are distinct before they meet, so their edges are, and those, which are many, are not shuffled.
    once = lambda df: df.select("binary", "name").distinct().join(kept, "name", "left_semi")
    made = once(calls).join(once(exports).withColumnRenamed("binary", "callee"), "name").where(F.col("binary") != F.col("callee"))
    folded = plan.where("folded").select("name", "exporters", "callers")
    own = calls.join(folded, "name").join(exports.select("name", "binary").distinct().withColumn("own", F.lit(1)), ["name", "binary"], "left")
    ledger = own.groupBy("name", "exporters", "callers").agg(F.sum(F.col("exporters") - F.coalesce("own", F.lit(0))).alias("edges"))
    return made.select(F.col("binary").alias("caller"), "callee", "name"), ledger


def resolve_names(wanted: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library names to binaries by the first tier with any hit: exact, without a version, without all after ``.so``.

    wanted: (binary, soname); known: (binary, name). Returns the edges of names with
    one hit, and a ledger of those with several, candidates sorted. A binary is no
    hit for its own wish; hits are counted after it is left out. Wishes meet the counts
    of their keys' hits and not the hits, as a key's wishes times its hits are many.
    """
    tiers = lambda c: [c, F.regexp_replace(c, r"(\.so)(\.[0-9]+)+$", "$1"), F.regexp_replace(c, r"\.so.*$", "")]
    held = known.select(F.col("binary").alias("hit"), F.posexplode(F.array(*tiers(F.col("name")))).alias("tier", "key")).where("key IS NOT NULL").distinct()
    keys = held.groupBy("tier", "key").agg(F.count("hit").alias("n"), F.min("hit").alias("least"), F.max("hit").alias("most"))
    asked = wanted.select("binary", "soname").where("binary IS NOT NULL").distinct().select("binary", "soname", F.posexplode(F.array(*tiers(F.col("soname")))).alias("tier", "key"))
    found = F.struct("tier", "key", "n", "least", "most")
    best = asked.join(keys, ["tier", "key"]).groupBy("binary", "soname").agg(F.min_by(found, "tier").alias("f")).select("binary", "soname", "f.*")
    # The least or the most of two hits is the own one if any is; of more, two at least are left.
    own = (F.col("binary") == F.col("least")) | (F.col("binary") == F.col("most"))
    one = best.where((F.col("n") == 1) & ~own | (F.col("n") == 2) & own).select("binary", "soname", F.when(F.col("binary") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("target"), "tier")
    several = best.where((F.col("n") > 2) | (F.col("n") == 2) & ~own).select("binary", "soname", "tier", "key")
    lists = held.where("hit IS NOT NULL").groupBy("tier", "key").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    # A key's list is made once and meets each wish in the last join; nothing is shuffled after it.
    many = several.join(lists, ["tier", "key"]).select("binary", "soname", F.array_remove("hits", F.col("binary")).alias("candidates"), "tier")
    return one, many


#: Holders of one string above which their pairs are not made.
FOLD_HOLDERS = 50
#: Occurrences of pairs that one task counts, about.
TASK_PAIRS = 3_000_000


def shared_string_pairs(strings: DataFrame, most_holders: int = FOLD_HOLDERS) -> DataFrame:
    """Undirected pairs (a < b) of binaries (binary, value) that share a useful string, with how many.

    A value that n binaries hold makes n * (n - 1) / 2 pairs, so one that more than
    ``most_holders`` hold is folded: ``shared_string_groups`` has it with all its holders.
    """
    held = strings.where(text.useful_shared_string(F.col("value")) & text.string_class(F.col("value")).isin(*text.SHARED_CLASSES)).select("binary", "value").distinct()
    few = held.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") <= most_holders).select("value")
    lists = staged(held.join(few, "value", "left_semi").where("binary IS NOT NULL").groupBy("value").agg(F.array_sort(F.collect_list("binary")).alias("h")).select("h").where(F.size("h") > 1), "holders")
    pairs = lists.agg(F.sum(F.size("h").cast("long") * (F.size("h") - 1) / 2)).first()[0] or 0
    # Each holder goes, with all that are above it, to the task of its pairs: those are made and counted there, and not shuffled.
    first = lists.select("h", F.posexplode("h").alias("i", "a")).select("a", F.slice("h", F.col("i") + 2, F.size("h")).alias("bs")).where(F.size("bs") > 0)
    return first.repartition(int(pairs // TASK_PAIRS) + 1, "a").select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def shared_string_groups(strings: DataFrame) -> DataFrame:
    """The binaries that hold each useful string, which is all that its pairs say."""
    return strings.where(text.useful_shared_string(F.col("value")) & text.string_class(F.col("value")).isin(*text.SHARED_CLASSES)).groupBy("value").agg(F.array_sort(F.collect_set("binary")).alias("binaries"))


def callees_resolved(callees: DataFrame, functions: DataFrame) -> DataFrame:
    """Callee rows (binary, name) with whether a function of that name exists in the binary."""
    return callees.join(functions.select("binary", "name").distinct().withColumn("__r", F.lit(True)), ["binary", "name"], "left").withColumn("resolved", F.coalesce("__r", F.lit(False))).drop("__r")


def fold_occurrences(edges: DataFrame, key: list[str]) -> DataFrame:
    """Equal edges once, with how often they occur."""
    return edges.groupBy(*key).agg(F.count("*").alias("occurrences"))
