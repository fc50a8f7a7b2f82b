"""Registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, context_tree, covering, decontaminate, fingerprints, language, pieces, pii, ranked, repeats, site_lines, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_substring_dedup": repeats.op6_substring_dedup,
    "op7_site_line_frequency": site_lines.op7_site_line_frequency,
    "op8_personal_data": pii.op8_personal_data,
    "op9_simhash_covering": covering.op9_simhash_covering,
    "op10_language_mixture": language.op10_language_mixture,
    "op11_context_tree": context_tree.op11_context_tree,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
}

SQL = {
    "op7_site_line_frequency": site_lines.OP7_SQL,
    "op11_context_tree": context_tree.op11_context_tree,
    "op12_ranked_search": ranked.OP12_SQL,
}
