"""Queries of the text operators: ``opN_<name>``, each over its whole table."""

from __future__ import annotations

from arealis.llm import chat_format, conversation_trie, decontamination, exact_dedup, importance, license_scan, line_dedup, ngram_join, packing, quality, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_quality": quality.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_toxicity": toxicity.op4,
    "op5_suffix_array_dedup": suffix_dedup.op5,
    "op6_license_scan": license_scan.op6,
    "op7_decontamination": decontamination.op7,
    "op8_best_fit_packing": packing.op8,
    "op9_ngram_jaccard": ngram_join.op9,
    "op10_token_files": token_files.op10,
    "op11_conversation_trie": conversation_trie.op11,
    "op12_importance_resampling": importance.op12,
    "op13_chat_format": chat_format.op13,
}

#: Scores, searches with labels of their own, token ids and packings have no SQL twin;
#: their tests compare them with brute force, held-out labels or a round trip.
SQL = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op9_ngram_jaccard": ngram_join.OP9_SQL,
    "op11_conversation_trie": conversation_trie.OP11_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
    "op13_chat_format": chat_format.OP13_SQL,
}
