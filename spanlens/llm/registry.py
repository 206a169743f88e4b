"""The ten operators as registered queries, with SQL where it can express them."""

from __future__ import annotations

from spanlens.llm import covertree, language, license, mixing, oracles, packing, quality, simhash, substring, suffixtree, toxicity

QUERIES = {
    "op1_toxicity_mil": toxicity.op1_toxicity_mil,
    "op2_cover_tree": covertree.op2_cover_tree,
    "op3_mixing_flow": mixing.op3_mixing_flow,
    "op4_packing_nnls": packing.op4_packing_nnls,
    "op5_substring_lsm": substring.op5_substring_lsm,
    "op6_language_hierarchy": language.op6_language_hierarchy,
    "op7_license_minhash": license.op7_license_minhash,
    "op8_suffix_tree": suffixtree.op8_suffix_tree,
    "op9_simhash_bktree": simhash.op9_simhash_bktree,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLES: dict[str, str] = oracles.ORACLES
