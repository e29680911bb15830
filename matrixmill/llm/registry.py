"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, language_id, nbest, ngram_join, ngram_trie, packing, quality_model, quality_rules, revisits, spelling, toxicity, vector_graph, wordpiece


def queries() -> dict:
    return {
        "op1_wordpiece_counts": wordpiece.op1_wordpiece_counts,
        "op2_compression_bands": quality_rules.op2_compression_bands,
        "op3_robust_pruned_graph": vector_graph.op3_robust_pruned_graph,
        "op4_factorisation_machine": quality_model.op4_factorisation_machine,
        "op5_bidirectional_gru": language_id.op5_bidirectional_gru,
        "op6_noisy_or_sentences": toxicity.op6_noisy_or_sentences,
        "op7_best_two_fit": packing.op7_best_two_fit,
        "op8_token_combination_join": ngram_join.op8_token_combination_join,
        "op9_revisit_resolution": revisits.op9_revisit_resolution,
        "op10_nbest_segmentation": nbest.op10_nbest_segmentation,
        "op11_anagram_hashing": spelling.op11_anagram_hashing,
        "op12_annulus_search": centroids.op12_annulus_search,
        "op13_elias_fano_trie": ngram_trie.op13_elias_fano_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_revisit_resolution": revisits.ORACLE, "op11_anagram_hashing": spelling.ORACLE, "op12_annulus_search": centroids.oracle()}
