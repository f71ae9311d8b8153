"""What each pass has read, so that an empty answer can be told from an unread one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ledgers

#: Outcomes of a decompilation that ran and did not finish.
UNFINISHED = ("timeout", "payload_exceeded", "error")


def launch_status(functions: DataFrame, edges: DataFrame, commands: tuple[str, ...]) -> DataFrame:
    """One row for each binary of a run, whether it launches anything or not: run_id, binary, path, scanned, found.

    functions: (run_id, binary, path, callees, has_text, has_provenance); edges: (run_id,
    binary). Not scanned where a function that calls one of ``commands`` has no text or
    no provenance, as its launches are those that nobody could see.
    """
    calls = F.arrays_overlap(F.coalesce("callees", F.array().cast("array<string>")), F.array(*map(F.lit, commands)))
    unread = F.coalesce(calls, F.lit(False)) & ~(F.coalesce("has_text", F.lit(False)) & F.coalesce("has_provenance", F.lit(False)))
    read = functions.select("run_id", "binary", "path", unread.alias("unread"), F.lit(0).alias("n"))
    made = edges.select("run_id", "binary", F.lit(None).cast("string").alias("path"), F.lit(False).alias("unread"), F.lit(1).alias("n"))
    # One union, so that a binary without a name keeps its row too.
    return read.unionByName(made).groupBy("run_id", "binary").agg(F.min("path").alias("path"), (~F.bool_or("unread")).alias("scanned"), F.sum("n").alias("found"))


def scope_status(rows: DataFrame) -> DataFrame:
    """One row on a pass over all its statuses (scanned, cap_hit, found, handler_unverified, pairing_undetermined).

    Counts that a status does not have recorded make their total null, never zero;
    nothing found is a none only where everything was scanned and no cap was hit.
    """
    scanned, capped = F.coalesce("scanned", F.lit(False)), F.coalesce("cap_hit", F.lit(False))
    whole = (F.count("*") > 0) & (F.count_if(~scanned) == 0) & (F.count_if(capped) == 0)
    return rows.agg(
        F.count("*").alias("statuses"),
        F.count_if(scanned).alias("scanned"),
        F.count_if(~scanned).alias("not_scanned"),
        F.count_if(capped).alias("cap_hit"),
        F.coalesce(F.sum("found"), F.lit(0)).alias("found"),
        ledgers.strict_sum(F.col("handler_unverified")).alias("handler_unverified"),
        ledgers.strict_sum(F.col("pairing_undetermined")).alias("pairing_undetermined"),
        F.when(F.coalesce(F.sum("found"), F.lit(0)) > 0, "found").when(whole, "none").otherwise("unknown").alias("reading"),
    )


def without_status(binaries: DataFrame, status: DataFrame) -> DataFrame:
    """Binaries (run_id, name) of each run that have no row of a pass (run_id, binary): run_id and number of names."""
    named = status.select("run_id", F.col("binary").alias("name")).distinct()
    return binaries.select("run_id", "name").distinct().join(named, ["run_id", "name"], "left_anti").groupBy("run_id").agg(F.count("*").alias("binaries"))


def reference_state(references: DataFrame, exports: DataFrame) -> DataFrame:
    """Of each scope asked for, whether a string's references were found, resolved to none, or never looked for.

    references: (scope, truncated) of the string; exports: (scope, exported), one row
    for each scope at least. exported is false or null where nobody looked.
    """
    found = references.groupBy("scope").agg(F.count("*").alias("anchors"), F.bool_or(F.coalesce("truncated", F.lit(False))).alias("export_truncated"))
    looked = exports.groupBy("scope").agg(F.bool_or(F.coalesce("exported", F.lit(False))).alias("exported"))
    state = F.when(F.col("anchors") > 0, "found").when(F.col("exported"), "no_resolved_dataref").otherwise("string_refs_not_exported")
    return looked.join(found, "scope", "left").select("scope", state.alias("state"), F.coalesce("anchors", F.lit(0)).alias("anchors"), F.coalesce("export_truncated", F.lit(False)).alias("export_truncated"))


def promotion_sums(binaries: DataFrame, by: list[str]) -> DataFrame:
    """Promotion records of each run's extracted binaries (created, residual, unowned, recovered, lost_bytes, noreturn_flips, extracted).

    The sums leave out binaries without a record and count those as unrecorded; the
    numbers of binaries with residue are null as long as any is unrecorded.
    """
    recorded = F.col("created").isNotNull() & F.col("residual").isNotNull() & F.col("unowned").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(recorded, F.col(c))), F.lit(0))
    whole = F.count_if(F.col("residual").isNull() | F.col("unowned").isNull()) == 0
    return (
        binaries.where("extracted")
        .groupBy(*by)
        .agg(
            F.count("*").alias("binaries"),
            F.count_if(~recorded).alias("unrecorded"),
            total("created").alias("created"),
            total("residual").alias("residual"),
            total("recovered").alias("recovered"),
            F.count_if((F.col("lost_bytes") > 0) | (F.col("noreturn_flips") > 0)).alias("guard_binaries"),
            F.when(whole, F.count_if(F.col("residual") > 0)).alias("residual_binaries"),
            F.when(whole, F.count_if(F.col("unowned") > 0)).alias("unowned_binaries"),
        )
    )


def build_hash(rows: DataFrame, by: list[str], version: str) -> DataFrame:
    """The one version that each group states, ``mixed:`` and how many where it states several, null where none is known."""
    distinct = rows.select(*by, version).distinct()
    n = F.count(version)
    return distinct.groupBy(*by).agg(F.when(n == 1, F.min(version)).when(n > 1, F.concat(F.lit("mixed:"), n.cast("string"))).alias("build_hash"))


def decompile_cause(status: Column, error: Column) -> Column:
    """A stored outcome in one word; unknown where none is recorded."""
    return F.when(status.isNull() | (status == ""), "unknown").when((status == "error") & error.eqNullSafe(F.lit("payload_exceeded")), "payload_exceeded").otherwise(status)


def unfinished_decompiles(functions: DataFrame, diffs: DataFrame, alignment: DataFrame, candidates: DataFrame) -> DataFrame:
    """Functions whose decompilation did not finish, each with what a difference pairs it with: cause, diff_id, other_address, alignment_state, counterpart, candidates.

    functions: (run_id, sha256, address, status, error); diffs: (diff_id, run_a, sha_a,
    run_b, sha_b, diff_ok); alignment: (diff_id, addr_a, addr_b, alignment_state);
    candidates: (run_id, sha256, address). A function of no difference has one row
    without one. The counterpart's candidates are null where its own decompilation did
    not finish, as nothing was measured there, and where there is no pair.
    """
    known = functions.select("run_id", "sha256", "address", decompile_cause(F.col("status"), F.col("error")).alias("cause"))
    open_ = known.where(F.col("cause").isin(*UNFINISHED))
    side = lambda x, y: F.struct(F.lit(x).alias("side"), F.col(f"run_{x}").alias("run_id"), F.col(f"sha_{x}").alias("sha256"), F.col(f"run_{y}").alias("other_run"), F.col(f"sha_{y}").alias("other_sha"))
    twice = (F.col("run_a") == F.col("run_b")) & (F.col("sha_a") == F.col("sha_b"))
    sides = diffs.where("diff_ok").select("diff_id", F.explode(F.when(twice, F.array(side("a", "b"))).otherwise(F.array(side("a", "b"), side("b", "a")))).alias("s")).select("diff_id", "s.*")
    pair = lambda x, y: F.struct(F.lit(x).alias("side"), F.col(f"addr_{x}").alias("address"), F.col(f"addr_{y}").alias("other_address"))
    pairs = alignment.select("diff_id", "alignment_state", F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("p")).select("diff_id", "alignment_state", "p.*")
    other = known.select(F.col("run_id").alias("other_run"), F.col("sha256").alias("other_sha"), F.col("address").alias("other_address"), F.col("cause").alias("there"))
    held = candidates.groupBy(F.col("run_id").alias("other_run"), F.col("sha256").alias("other_sha"), F.col("address").alias("other_address")).agg(F.count("*").alias("held"))
    at = ["other_run", "other_sha", "other_address"]
    met = open_.join(sides, ["run_id", "sha256"], "left").join(pairs, ["diff_id", "side", "address"], "left").join(other, at, "left").join(held, at, "left")
    paired = F.col("other_address").isNotNull()
    counterpart = F.when(paired, F.coalesce("there", F.lit("unknown")))
    measured = F.when(counterpart.isin("ok", "unknown"), F.coalesce("held", F.lit(0)))
    return met.select("run_id", "sha256", "address", "cause", "diff_id", "other_address", "alignment_state", counterpart.alias("counterpart"), measured.alias("candidates"))
