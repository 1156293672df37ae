"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from folioscope.llm import (
    classifier, decontamination, lines, minhash, negatives, packing, quality, reputation, sharding, substrings, suffixes, token_counts, whitening)

QUERIES = {
    "op1_token_rollup": token_counts.op1_token_rollup,
    "op2_virtual_slots": sharding.op2_virtual_slots,
    "op3_sum_of_squares_packing": packing.op3_sum_of_squares_packing,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_prefix_doubling": suffixes.op5_prefix_doubling,
    "op6_coordinate_join": minhash.op6_coordinate_join,
    "op7_host_reputation": reputation.op7_host_reputation,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_suffix_automaton": decontamination.op10_suffix_automaton,
    "op11_cover_tree_negatives": negatives.op11_cover_tree_negatives,
    "op12_byte_convolution": classifier.op12_byte_convolution,
    "op13_polarised_whitening": whitening.op13_polarised_whitening,
}
ORACLE = {"op4_line_dedup": lines.SQL, "op7_host_reputation": reputation.SQL, "op8_quality_rules": quality.SQL,
          "op11_cover_tree_negatives": negatives.SQL}
