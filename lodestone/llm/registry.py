"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm import ann, exact_topk, mixing, packing, pii, secrets, simhash, tokencount, toxicity, urlfilter

QUERIES = {"op1_pii": pii.op1_pii, "op2_url_filters": urlfilter.op2_url_filters, "op3_toxicity": toxicity.op3_toxicity, "op4_neighbours": ann.op4_neighbours, "op5_mixing": mixing.op5_mixing, "op6_packing": packing.op6_packing, "op7_simhash": simhash.op7_simhash, "op8_exact_topk": exact_topk.op8_exact_topk, "op9_token_counts": tokencount.op9_token_counts, "op10_secrets": secrets.op10_secrets}
ORACLE_SQL: dict[str, str] = {"op1_pii": pii.OP1_SQL, "op2_url_filters": urlfilter.OP2_SQL, "op4_neighbours": ann.OP4_SQL, "op8_exact_topk": exact_topk.OP8_SQL}
