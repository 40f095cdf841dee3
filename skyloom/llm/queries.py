"""The training-data queries and their DuckDB SQL, which ``__spark_entry__`` adds when this subpackage is there."""

from __future__ import annotations

from . import chroma_prints, conversation_repair, exact_dedup, filter_audit, hash_tree, html_text, jaccard_join, language_id, mixing, packing, secrets, token_counts, warc_revisit

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1,
    "op2_language_id": language_id.op2,
    "op3_warc_revisits": warc_revisit.op3,
    "op4_chroma_prints": chroma_prints.op4,
    "op5_secret_scan": secrets.op5,
    "op6_token_counts": token_counts.op6,
    "op7_retrieval_packing": packing.op7,
    "op8_hash_tree_sharding": hash_tree.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_mixing": mixing.op10,
    "op11_conversation_repair": conversation_repair.op11,
    "op12_html_extraction": html_text.op12,
    "op13_filter_audit": filter_audit.op13,
}

ORACLES = {
    "op1_ngram_jaccard_join": jaccard_join.SQL1,
    "op3_warc_revisits": warc_revisit.SQL3,
    "op5_secret_scan": secrets.SQL5,
    "op9_exact_dedup": exact_dedup.SQL9,
    "op11_conversation_repair": conversation_repair.SQL11,
    "op13_filter_audit": filter_audit.SQL13,
}
