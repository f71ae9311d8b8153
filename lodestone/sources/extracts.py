"""The extractor's documents, tool logs, registries and settings."""

from __future__ import annotations

import copy
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.plans import schemas

#: A body this small and without text is empty for a reason that its size gives.
TINY = 10


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document (whole-file JSON); unreadable ones keep their text in _corrupt_record."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def fact_tables(documents: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """Functions, imports, exports, strings and each document's extraction status.

    Missing lists make no rows, and the status tells them from empty ones: unreadable,
    no_functions, partial (bodies missing that should be there) or complete.
    """
    base = documents.withColumn("run_id", F.lit(run_id))
    each = lambda c: base.select("run_id", "sha256", F.explode(c).alias("x"))
    functions = each("functions").select("run_id", "sha256", F.col("x.name").alias("name"), text.parse_address(F.col("x.address")).alias("address"), F.col("x.size").alias("size"), F.col("x.is_exported").alias("is_exported"), F.col("x.callees").alias("callees"), F.col("x.pseudocode").alias("body"))
    missing = F.exists("functions", lambda f: (F.coalesce(f["pseudocode"], F.lit("")) == "") & (f["size"] >= TINY))
    status = F.when(F.col("_corrupt_record").isNotNull() | F.col("sha256").isNull(), "unreadable").when(F.col("functions").isNull() | (F.size("functions") == 0), "no_functions").when(missing, "partial").otherwise("complete")
    return {
        "functions": functions,
        "imports": each("imports").select("run_id", "sha256", F.col("x.func_name").alias("name"), F.col("x.lib_name").alias("library")),
        "exports": each("exports").select("run_id", "sha256", F.col("x.func_name").alias("name"), text.parse_address(F.col("x.address")).alias("address")),
        "strings": each("strings").select("run_id", "sha256", F.col("x.value").alias("value"), text.parse_address(F.col("x.address")).alias("address"), text.string_class(F.col("x.value")).alias("category")),
        "extraction": base.select("run_id", "sha256", status.alias("status"), F.when(F.col("functions").isNotNull(), F.size("functions")).alias("functions"), "strings_total", "strings_truncated"),
    }


#: Kinds of table accesses.
TABLE_ACCESS = ("read", "pointer", "arg", "store")


def table_accesses(entries: DataFrame, functions: DataFrame) -> DataFrame:
    """Table accesses of each function in the order exported: sha256, address, seq, kind, obs.

    entries: (sha256, f, rows array of kind and obs, total, truncated). A function that the
    binary does not have (functions: sha256, address) and a kind that is not known make no
    rows; one that the export cut has a last row of kind truncated, so that a prefix is
    not taken for the whole.
    """
    known = entries.where("rows IS NOT NULL").withColumn("address", text.parse_address(F.col("f"))).join(functions.select("sha256", "address").distinct(), ["sha256", "address"], "left_semi")
    kept = F.filter("rows", lambda r: r["kind"].isin(*TABLE_ACCESS))
    cut = F.struct(F.lit("truncated").alias("kind"), F.to_json(F.struct("total", F.size("rows").alias("kept"))).alias("obs"))
    plain = F.transform(kept, lambda r: F.struct(r["kind"].alias("kind"), r["obs"].alias("obs")))
    every = F.when(F.coalesce("truncated", F.lit(False)), F.concat(plain, F.array(cut))).otherwise(plain)
    return known.select("sha256", "address", F.posexplode(every).alias("seq", "r")).select("sha256", "address", "seq", "r.kind", "r.obs")


def listing_state(functions: DataFrame, listings: DataFrame, passes: DataFrame) -> DataFrame:
    """Whether each function's listing can be read, and if not why: sha256, address, state, units.

    functions: (sha256, address, errors array); listings: (sha256, address, units array, null
    where empty); passes: (sha256) of binaries whose export had listings. available;
    empty (a function without instructions); export_error; not_stored; not_exported.
    """
    key = ["sha256", "address"]
    met = functions.join(listings.select(*key, "units", F.lit(True).alias("held")), key, "left").join(passes.select("sha256").distinct().withColumn("ran", F.lit(True)), "sha256", "left")
    failed = F.coalesce(F.array_contains("errors", "listing"), F.lit(False))
    state = F.when(F.col("units").isNotNull(), "available").when(failed, "export_error").when(F.col("ran") & F.col("held"), "empty").when(F.col("ran"), "not_stored").otherwise("not_exported")
    return met.select(*key, state.alias("state"), "units")


LOG = "ts double, session string, pid int, tool string, params map<string,string>, response_bytes long, truncated boolean, error string, reading string, page_rows array<long>"


def read_tool_log(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a JSON-lines log; lines that are no JSON object are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\{"))
    return lines.select(F.from_json("value", LOG).alias("c")).where("c IS NOT NULL AND c.tool IS NOT NULL").select("c.*")


def read_coverage(pages: DataFrame, subject: str) -> DataFrame:
    """Whether the pages read (start, end, total) of each subject cover it from 0 to its total without a gap."""
    span = F.array_sort(F.collect_set(F.struct(F.col("page_rows")[0].alias("lo"), F.col("page_rows")[1].alias("hi"))))
    merged = pages.where(F.size("page_rows") == 3).groupBy(subject).agg(span.alias("spans"), F.max(F.col("page_rows")[2]).alias("total"))
    reach = F.aggregate("spans", F.lit(0).cast("long"), lambda at, s: F.when(s["lo"] <= at, F.greatest(at, s["hi"])).otherwise(at))
    return merged.select(subject, "total", (reach >= F.col("total")).alias("whole"))


def parse_registry(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (name, role, positions) of a tab-separated registry (line, value), and the lines that are malformed."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)")).withColumn("f", F.split("value", "\t"))
    good = (F.size("f") == 3) & F.get("f", F.lit(0)).rlike(r"^[A-Za-z_]\w*$") & F.get("f", F.lit(2)).rlike(r"^\d+(,\d+)*$")
    return rows.where(good).select(F.col("f")[0].alias("name"), F.col("f")[1].alias("role"), F.split(F.col("f")[2], ",").cast("array<int>").alias("positions")), rows.where(~good).select("line", "value")


def settings(defaults: dict, file: dict | None = None, prefix: str = "LODESTONE_", environment: dict | None = None) -> dict:
    """Defaults, under a file's values, under the environment's (``PREFIX_SECTION__KEY``)."""
    out = copy.deepcopy(defaults)

    def merge(into: dict, over: dict) -> None:
        for k, v in over.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                merge(into[k], v)
            else:
                into[k] = v

    merge(out, file or {})
    for k, v in (os.environ if environment is None else environment).items():
        if k.startswith(prefix):
            at, *more = [p.lower() for p in k.removeprefix(prefix).split("__")]
            merge(out, {at: v} if not more else {at: {more[0]: v}})
    return out
