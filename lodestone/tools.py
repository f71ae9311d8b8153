"""The questions that the warehouse answers, paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import diffs, edges, keyflow, ledgers, lens, overlay, rank, scans, select
from lodestone.plans.warehouse import Warehouse
from lodestone.sources import textfiles


class Refusal(ValueError):
    """A question that cannot be answered as asked; candidates, if any, come with it."""


class Tools:
    """Reads over one warehouse. Each returns a DataFrame; none guesses between several subjects."""

    def __init__(self, store: Warehouse):
        self.store = store

    def _page(self, df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
        return rank.page(df, [F.asc_nulls_last(c) for c in order], offset, limit)

    def binary(self, selector: str) -> str:
        """A binary's hash by hash, hash prefix, path or name; the first of these that matches must match one."""
        tiers = [F.col("sha256") == selector, F.col("sha256").startswith(selector) & F.lit(len(selector) >= 6 and all(c in "0123456789abcdef" for c in selector)), F.col("path") == selector, F.col("name") == selector]
        current = select.current_generation(self.store.read("binaries"), "last_seen_at")
        found = select.tiered(current.select("sha256", "path", "name").distinct(), tiers).limit(20).collect()
        if not found:
            raise Refusal(f"no binary matches {selector!r}")
        if len({r.sha256 for r in found}) > 1:
            raise Refusal(f"{selector!r} is ambiguous: " + ", ".join(sorted(f"{r.name} {r.sha256[:12]} {r.path}" for r in found)))
        return found[0].sha256

    def functions(self, function: str, binary: str | None = None) -> DataFrame:
        """Functions of a name or at an address in any spelling."""
        rows = self.store.read("functions")
        rows = rows.where(F.col("sha256") == self.binary(binary)) if binary else rows
        return rows.where((F.col("name") == function) | (F.array_contains(text.address_candidates(F.lit(function)), F.col("address").cast("decimal(20,0)"))))

    def get_pseudocode(self, function: str, binary: str | None = None, page: int = 0, size: int = 12_000) -> DataFrame:
        """A function's text by pages of whole lines."""
        found = self.functions(function, binary).select("sha256", "address", "name").distinct().limit(2).collect()
        if len(found) != 1:
            raise Refusal(f"{function!r} is {'ambiguous' if found else 'not known'}")
        one = self.functions(function, binary).select(F.col("name").alias("path"), F.col("body").alias("text"))
        return textfiles.line_pages(one, size).where(F.col("page") == page)

    def get_callees(self, function: str, binary: str | None = None) -> DataFrame:
        called = self.functions(function, binary).select(F.col("sha256").alias("binary"), F.explode("callees").alias("name"))
        return edges.callees_resolved(called, self.store.read("functions").select(F.col("sha256").alias("binary"), "name"))

    def get_xrefs(self, name: str, binary: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """A function's callers in its own binary, callers in binaries that import it from one that exports it, and its callees: direction, binary, function, address, basis.

        A call of a bare name in a binary that has no such function and imports none is
        no reference to it. A name that no binary defines is what binaries import.
        """
        functions = self.store.read("functions")
        own = functions.where(F.col("name") == name)
        own = own.where(F.col("sha256") == self.binary(binary)) if binary else own
        homes = own.select("sha256").distinct()
        callers = functions.where(F.array_contains("callees", name))
        row = lambda df, direction, function, at, basis: df.select(F.lit(direction).alias("direction"), F.col("sha256").alias("binary"), function.alias("function"), at.alias("address"), F.lit(basis).alias("basis"))
        same = row(callers.join(homes, "sha256", "left_semi"), "caller", F.col("name"), F.col("address"), "same_binary")
        defined = homes.limit(1).count() > 0
        exported = self.store.read("exports").where(F.col("name") == name).join(homes, "sha256", "left_semi").limit(1).count() > 0
        importers = self.store.read("imports").where((F.col("name") == name) & F.lit(exported or not defined)).select("sha256").distinct().join(homes, "sha256", "left_anti")
        cross = row(callers.join(importers, "sha256", "left_semi"), "caller", F.col("name"), F.col("address"), "imports_the_export" if defined else "imported_name")
        called = own.select("sha256", F.explode("callees").alias("callee")).distinct()
        known = functions.select("sha256", F.col("name").alias("callee"), F.col("address").alias("at")).distinct()
        down = row(called.join(known, ["sha256", "callee"], "left"), "callee", F.col("callee"), F.col("at"), "called_by_name")
        return self._page(same.unionByName(cross).unionByName(down).distinct(), ["direction", "binary", "address", "function", "basis"], offset, limit)

    def get_strings(self, binary: str | None = None, value: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        rows = self.store.read("strings")
        rows = rows.where(F.col("sha256") == self.binary(binary)) if binary else rows
        rows = rows.where(F.col("value").contains(value)) if value is not None else rows
        return self._page(rows.select("sha256", "address", "value", "category"), ["sha256", "address", "value"], offset, limit)

    def get_functions_referencing_string(self, value: str, offset: int = 0, limit: int = 50) -> DataFrame:
        rows = self.store.read("functions").where(F.col("body").contains(value)).select("sha256", "name", "address")
        return self._page(rows, ["sha256", "address", "name"], offset, limit)

    def get_imports_exports(self, binary: str, offset: int = 0, limit: int = 50) -> DataFrame:
        sha = self.binary(binary)
        side = lambda t, extra: self.store.read(t).where(F.col("sha256") == sha).select(F.lit(t).alias("table"), "name", extra)
        return self._page(side("imports", F.col("library")).unionByName(side("exports", F.lit(None).cast("string").alias("library"))), ["table", "name", "library"], offset, limit)

    def candidates(self, run_id: str | None = None) -> DataFrame:
        rows = self.store.read("instance")
        rows = rows.where(F.col("run_id") == run_id) if run_id else rows
        noted = overlay.current(self.store.read("annotation")).where("anchor_kind = 'candidate'").select(F.col("anchor_ref").alias("evidence_ref"), "verdict", "basis")
        return rows.join(self.store.read("pattern"), "pattern_id").join(noted, "evidence_ref", "left")

    def list_candidates(self, run_id: str | None = None, wanted: dict[str, str] | None = None, impact: str | None = None, safe: Column | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """Candidates by annotation band, band of the filters, impact and reference; filters move rows up and remove none."""
        safe = F.lit(False) if safe is None else safe
        rows = select.float_bands(self.candidates(run_id), wanted or {}, safe)
        rows = rows.withColumns({"impact": rank.impact(F.col("sink_class"), rank.parse_impact_order(impact) if impact else None), "annotation_band": rank.annotation_band(F.col("verdict"), F.col("basis"))})
        return rank.page(rows, [F.col("annotation_band"), F.col("band"), F.desc("impact"), F.col("evidence_ref")], offset, limit)

    def lens_candidates(self, candidates: DataFrame, view: str | None = None, sort_by: str | None = None, fragments: tuple[str, ...] = (), sink: str | None = None, status: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """A page of graded candidates under a view: filters of sink and status remove, those of dimensions float."""
        why = lens.refusal(status, sort_by, view, fragments)
        if why:
            raise Refusal(why)
        rows, order = lens.viewed(lens.filtered(candidates, sink, status), view, sort_by, fragments)
        return rank.page(rows, order, offset, limit).select(*candidates.columns, "band")

    def explain_candidate(self, evidence_ref: str) -> DataFrame:
        """All that is known of one candidate."""
        found = self.candidates().where(F.col("evidence_ref") == evidence_ref)
        if not found.limit(1).count():
            raise Refusal(f"no candidate {evidence_ref!r}")
        return found

    def list_runs(self) -> DataFrame:
        return self.store.runs()

    def get_nvram_key_flow(self, key: str, run_id: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """Operations on a key, by its own name and by templates that it may be built from."""
        flow = self.store.read("key_flow")
        flow = flow.where(F.col("run_id") == run_id) if run_id else flow
        shape = F.when((F.col("key_kind") == "template") & text.template_anchored(F.col("key")), text.template_pattern(F.col("key")))
        hit = F.when((F.col("key_kind") != "template") & (F.col("key") == key), "exact").when(F.coalesce(F.lit(key).rlike(shape), F.lit(False)), "template")
        return self._page(flow.withColumn("match", hit).where("match IS NOT NULL"), ["run_id", "match", "binary", "func", "op", "api", "key"], offset, limit)

    def _narrowed(self, name: str, **asked: str | None) -> DataFrame:
        """A table's rows that have each value asked for."""
        rows = self.store.read(name)
        for column, value in asked.items():
            rows = rows if value is None else rows.where(F.col(column) == value)
        return rows

    def launched_by(self, target: str, run_id: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """What launches a target, in any spelling of it. None is no proof that nothing does: see ``pass_status``."""
        one = self.store.spark.createDataFrame([(target,)], "target string")
        found = keyflow.launched_by(self._narrowed("exec_edge", run_id=run_id), one).drop("target")
        return self._page(found, ["launcher_binary", "launcher_function", "sink_addr", "run_id", "edge_id"], offset, limit)

    def get_string_keyed_edges(self, run_id: str | None = None, binary: str | None = None, key: str | None = None, callee: str | None = None, from_function: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """Edges from a string key to a callee by any of their anchors."""
        found = self._narrowed("string_edge", run_id=run_id, binary=binary, key=key, callee=callee, from_function=from_function)
        return self._page(found, ["from_function", "key", "callee", "run_id", "edge_id"], offset, limit)

    def pass_status(self, detector: str, run_id: str | None = None, binary: str | None = None) -> DataFrame:
        """One row on what a pass has read in a scope, so that none found can be told from not looked for."""
        return scans.scope_status(self._narrowed("detector_status", detector=detector, run_id=run_id, binary=binary))

    def pass_statuses(self, detector: str, run_id: str | None = None, binary: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """A pass's statuses, binary by binary."""
        return self._page(self._narrowed("detector_status", detector=detector, run_id=run_id, binary=binary), ["run_id", "binary", "path", "sha256"], offset, limit)

    def get_string_reference_anchors(self, value: str, binary: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """Where a string, given exactly, is referenced by references that were resolved to it. For none see ``string_reference_state``."""
        rows = self._narrowed("string_refs", value=value, sha256=self.binary(binary) if binary else None)
        return self._page(rows, ["sha256", "string_addr", "ref_at", "run_id"], offset, limit)

    def string_reference_state(self, value: str, binary: str | None = None) -> DataFrame:
        """Whether a string's references were found, none was resolved, or nobody looked."""
        sha, scope = self.binary(binary) if binary else None, F.lit(binary or "all").alias("scope")
        every = self._narrowed("string_refs", sha256=sha)
        looked = self._narrowed("detector_status", detector="string_refs", sha256=sha).select(scope, F.col("scanned").alias("exported"))
        some = every.limit(1).select(scope, F.lit(True).alias("exported"))
        nobody = self.store.spark.range(1).select(scope, F.lit(False).alias("exported"))
        return scans.reference_state(every.where(F.col("value") == value).select(scope, "truncated"), looked.unionByName(some).unionByName(nobody))

    def list_diffs(self, run_a: str | None = None, run_b: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
        """Stored differences with their counts."""
        rows = self.store.read("diff")
        for column, value in (("run_a", run_a), ("run_b", run_b)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        found = diffs.browse(rows, self.store.read("function_alignment"), self.store.read("function_presence"))
        return self._page(found, ["run_a", "run_b", "binary", "diff_id"], offset, limit)

    def get_diff_meta(self, diff_id: str) -> DataFrame:
        """One difference with its counts; an unknown one is refused, not empty."""
        rows = self.store.read("diff").where(F.col("diff_id") == diff_id)
        if not rows.limit(1).count():
            raise Refusal(f"no difference {diff_id!r}")
        own = lambda name: self.store.read(name).where(F.col("diff_id") == diff_id)
        return diffs.browse(rows, own("function_alignment"), own("function_presence"))

    def get_diff_deltas(self, diff_id: str, binary: str | None = None, dimension: str | None = None, delta_kind: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        """A difference's deltas. None of them is no proof that nothing changed: see ``get_diff_meta``."""
        found = diffs.deltas(self.store.read("dimension_delta"), diff_id, binary, dimension, delta_kind)
        return self._page(found, ["dimension", "subject_kind", "subject_key", "binary", "delta_kind"], offset, limit)

    def get_diff_string_delta(self, diff_id: str, offset: int = 0, limit: int = 100) -> DataFrame:
        """Strings that one side of a difference has alone."""
        rows = self.store.read("string_presence").where(F.col("diff_id") == diff_id).select("side", "value").distinct()
        sides = rows.groupBy("value").agg(F.count("*").alias("n"), F.min("side").alias("side")).where("n = 1").select("side", "value")
        return self._page(sides, ["side", "value"], offset, limit)

    def get_function_alignment(self, diff_id: str, function: str, side: str, offset: int = 0, limit: int = 50) -> DataFrame:
        """The pairs of a function; several functions of one name are all listed."""
        return self._page(diffs.counterparts(self.store.read("function_alignment"), diff_id, function, side), [f"addr_{side}", "addr_a", "addr_b"], offset, limit)

    def get_sink_overlay(self, diff_id: str, reason: str | None = None, side: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        rows = diffs.overlay_rows(self.store.read("sink_overlay").where(F.col("diff_id") == diff_id), reason, side)
        return rank.page(rows, diffs.overlay_order(), offset, limit)

    def coverage(self, run_id: str | None = None) -> DataFrame:
        state = ledgers.coverage_state(F.col("verdict"), F.col("basis"), overlay.VERDICTS)
        return self.candidates(run_id).groupBy(state.alias("state")).agg(F.count("*").alias("candidates"))

    def cross_run_patterns(self, offset: int = 0, limit: int = 50) -> DataFrame:
        own = F.coalesce("origin", F.lit("unknown")).isin("custom", "unknown") & F.col("body_hash").isNotNull()
        found = ledgers.recurrence(self.store.read("pattern"), self.store.read("instance"), "pattern_id", "run_id", "body_hash", own)
        return rank.page(found, [F.desc("breadth"), F.desc("spread"), F.col("pattern_id")], offset, limit)

    def pattern_density(self, offset: int = 0, limit: int = 50) -> DataFrame:
        rows = self.store.read("instance").join(self.store.read("pattern"), "pattern_id")
        return rank.page(ledgers.density(rows, ["run_id", "sink_class", "fingerprint"]), [F.desc("candidates"), F.asc_nulls_first("sink_class"), F.asc_nulls_first("fingerprint"), F.col("run_id")], offset, limit)
