"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, divergence, infill, language_id, licenses, minhash, mixing, neighbours, quality, sentencepiece_codec, simhash, suffix_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_nearest_neighbours": neighbours.op9_nearest_neighbours,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_minhash_near_dedup": minhash.op11_minhash_near_dedup,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}
ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.OP2_SQL,
    "op4_source_mixing": mixing.OP4_SQL,
    "op11_minhash_near_dedup": minhash.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
