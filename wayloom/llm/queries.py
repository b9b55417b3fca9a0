"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from wayloom.llm import chat_format, exact_dedup, fingerprint, html_extract, language_id, mixing, near_dedup, packing, suffix_dedup, token_count

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_packing": packing.op4_packing,
    "op5_near_duplicates": near_dedup.op5_near_duplicates,
    "op6_html_extraction": html_extract.op6_html_extraction,
    "op7_token_counts": token_count.op7_token_counts,
    "op8_language_id": language_id.op8_language_id,
    "op9_mixing": mixing.op9_mixing,
    "op10_fingerprints": fingerprint.op10_fingerprints,
}
ORACLE_SQL = {"op1_chat_format": chat_format.OP1_SQL, "op2_exact_dedup": exact_dedup.OP2_SQL}
