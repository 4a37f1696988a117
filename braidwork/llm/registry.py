"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from braidwork.llm import chat, collocations, ef_trie, fim, langid, minhash, mixing, packing, prefix_bpe, quality_rules, rule_ensemble, simhash, suffix_dedup

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": langid.op2_language_id,
    "op3_quality_classifier": rule_ensemble.op3_quality_classifier,
    "op4_document_fingerprints": minhash.op4_document_fingerprints,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_lm_scoring": ef_trie.op6_lm_scoring,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_prefix_bpe": prefix_bpe.op11_prefix_bpe,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLES = {
    "op8_chat_formatting": chat.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op12_phrase_collocations": collocations.OP12_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
