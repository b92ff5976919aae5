"""Queries of this package: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from . import chat, decontaminate, hardneg, langid, linededup, lmscore, minhash, mixing, paritysketch, quality, secretscan, sharding, vectorcodes

QUERIES = {
    "op9_tool_links": chat.op9_tool_links,
    "op3_line_windows": linededup.op3_line_windows,
    "op1_soft_mixing": mixing.op1_soft_mixing,
    "op5_ppm": lmscore.op5_ppm,
    "op2_ngram_bayes": langid.op2_ngram_bayes,
    "op4_linked_credentials": secretscan.op4_linked_credentials,
    "op6_prefix_windows": decontaminate.op6_prefix_windows,
    "op8_parity_sketch": paritysketch.op8_parity_sketch,
    "op7_isolation_rules": quality.op7_isolation_rules,
    "op10_virtual_slots": sharding.op10_virtual_slots,
    "op11_hard_negatives": hardneg.op11_hard_negatives,
    "op12_cover_tree_codes": vectorcodes.op12_cover_tree_codes,
    "op13_bayes_minhash": minhash.op13_bayes_minhash,
}
ORACLE: dict[str, str] = {
    "op8_parity_sketch": paritysketch.OP8_SQL,
    "op9_tool_links": chat.OP9_SQL,
    "op3_line_windows": linededup.OP3_SQL,
    "op6_prefix_windows": decontaminate.OP6_SQL,
    "op11_hard_negatives": hardneg.OP11_SQL,
    "op12_cover_tree_codes": vectorcodes.OP12_SQL,
    "op13_bayes_minhash": minhash.OP13_SQL,
}
