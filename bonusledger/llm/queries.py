"""Registered queries of this subpackage and their SQL."""

from . import (
    conversations,
    decontaminate,
    embed_tiles,
    hash_tree,
    minmax,
    personal,
    pieces,
    quality,
    suffix_dedup,
    token_counts,
    url_filter,
    vector_codes,
    wrappers,
)

QUERIES = {
    "op1_wrappers": wrappers.op1_wrappers,
    "op2_pca_tiles": embed_tiles.op2_pca_tiles,
    "op3_segmented_bayes": url_filter.op3_segmented_bayes,
    "op4_hash_tree": hash_tree.op4_hash_tree,
    "op5_suffix_automaton": decontaminate.op5_suffix_automaton,
    "op6_weak_supervision": personal.op6_weak_supervision,
    "op7_transducer": pieces.op7_transducer,
    "op8_weak_labels": quality.op8_weak_labels,
    "op9_two_stage": suffix_dedup.op9_two_stage,
    "op10_min_max": minmax.op10_min_max,
    "op11_whole_tokens": token_counts.op11_whole_tokens,
    "op12_run_length": conversations.op12_run_length,
    "op13_gnat": vector_codes.op13_gnat,
}

SQL = {
    "op5_suffix_automaton": decontaminate.OP5_SQL,
    "op12_run_length": conversations.OP12_SQL,
    "op13_gnat": vector_codes.OP13_SQL,
}
