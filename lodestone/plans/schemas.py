"""Tables of the fact warehouse. Nested lists are arrays, never text; null means not recorded."""

FACTS = {
    "binaries": "run_id string, sha256 string, name string, path string, arch string, size long, last_seen_at timestamp, needed array<string>",
    "functions": "run_id string, sha256 string, name string, address decimal(20,0), size int, is_exported boolean, callees array<string>, body string",
    "imports": "run_id string, sha256 string, name string, library string",
    "exports": "run_id string, sha256 string, name string, address decimal(20,0)",
    "strings": "run_id string, sha256 string, value string, address decimal(20,0), category string",
    "string_refs": "run_id string, sha256 string, value string, string_addr decimal(20,0), ref_at decimal(20,0), ref_in_func string, ref_in_func_addr decimal(20,0), segment string, truncated boolean",
    "extraction": "run_id string, sha256 string, status string, functions int, strings_total int, strings_truncated boolean",
}
CROSS = {
    "run": "run_id string, state string, at timestamp, note string",
    "pattern": "pattern_id string, source_class string, sink_class string, shape string, fingerprint string",
    "instance": "run_id string, pattern_id string, evidence_ref string, body_hash string, sink_anchor string, binary_path string, origin string, status string",
    "key_flow": "run_id string, key string, key_kind string, binary string, func string, op string, api string, via_wrapper boolean",
    "form_field": "run_id string, field string, asset string, rule string",
    "key_default": "run_id string, key string, default_value string",
    "exec_edge": "run_id string, edge_id string, launcher_binary string, launcher_function string, sink_addr decimal(20,0), target_token string, target_binary string, target_layer string",
    "string_edge": "run_id string, edge_id string, binary string, path string, from_function string, key string, callee string, callee_addr decimal(20,0), mechanism string, completeness string, pairing string",
    "detector_status": "run_id string, sha256 string, binary string, path string, detector string, scanned boolean, scope string, note string, cap_hit boolean, found int, handler_unverified int, pairing_undetermined int",
    "annotation": "anchor_kind string, anchor_ref string, verdict string, rationale string, basis string, attributed_to string, at timestamp, seq long, cleared boolean",
}
#: Tables of stored differences, by diff_id.
DIFFS = {
    "diff": "diff_id string, run_a string, run_b string, binary string, diff_ok boolean, diff_status string, version_skew boolean",
    "function_alignment": "diff_id string, addr_a decimal(20,0), addr_b decimal(20,0), name_a string, name_b string, confidence double, similarity double, alignment_state string",
    "function_presence": "diff_id string, side string, addr decimal(20,0), name string, presence_state string, decompiled boolean, export_gap string",
    "dimension_delta": "diff_id string, dimension string, subject_kind string, subject_key string, binary string, state_a string, state_b string, delta_kind string, undetermined_scope string, undetermined_reason string, capability_ref string",
    "capability": "diff_id string, dimension string, state_a string, state_b string, delta_supported boolean",
    "string_presence": "diff_id string, side string, value string",
    "sink_overlay": "diff_id string, binary string, presence string, presence_reason string, key_granularity string, sink_class string, a_ref string, b_ref string",
}
#: The extractor's document of one binary.
DOCUMENT = """sha256 string, functions array<struct<name:string,address:string,size:int,is_exported:boolean,callees:array<string>,pseudocode:string>>,
imports array<struct<func_name:string,lib_name:string>>, exports array<struct<func_name:string,address:string>>, strings array<struct<value:string,address:string>>,
strings_total int, strings_truncated boolean, _corrupt_record string"""
