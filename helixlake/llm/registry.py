"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, chunk_dedup, conversation_repair, decontaminate, divergence, jaccard_join, language_id, packing, suffix_dedup, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_suffix_array_dedup": suffix_dedup.op2_suffix_array_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language_id": language_id.op4_language_id,
    "op5_substring_dedup": chunk_dedup.op5_substring_dedup,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_approximate_nearest_neighbours": ann.op7_approximate_nearest_neighbours,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_url_filters": url_filter.op9_url_filters,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_warc": warc.op11_warc,
    "op12_conversation_structure_repair": conversation_repair.op12_conversation_structure_repair,
    "op13_source_divergence_audit": divergence.op13_source_divergence_audit,
}
SQL = {"op2_suffix_array_dedup": suffix_dedup.SQL, "op6_ngram_jaccard_join": jaccard_join.SQL, "op8_decontamination": decontaminate.SQL, "op9_url_filters": url_filter.SQL, "op11_warc": warc.SQL, "op12_conversation_structure_repair": conversation_repair.SQL, "op13_source_divergence_audit": divergence.SQL}
