"""The queries of the numbered operators, and their SQL where SQL can express them."""

from formlens.llm import byte_bpe, chat, classifier, media, mixing, near_dedup, neighbours, quality, resampling, sharding, span_dedup, token_counts, variants

QUERIES = {
    "op1_mixing_sources_to_target_weights": mixing.op1_mixing_sources_to_target_weights,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_byte_level_bpe": byte_bpe.op3_byte_level_bpe,
    "op4_media_columns": media.op4_media_columns,
    "op5_quality_classifier": classifier.op5_quality_classifier,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_suffix_array_dedup": span_dedup.op8_suffix_array_dedup,
    "op9_sharding": sharding.op9_sharding,
    "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
    "op11_target_resampling": resampling.op11_target_resampling,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_nearest_neighbours": neighbours.op13_nearest_neighbours,
}
ORACLES = {
    "op1_mixing_sources_to_target_weights": mixing.OP1_SQL,
    "op2_quality_rules": quality.OP2_SQL,
    "op7_chat_formatting": chat.OP7_SQL,
    "op11_target_resampling": resampling.OP11_SQL,
    "op12_spelling_variants": variants.OP12_SQL,
}
