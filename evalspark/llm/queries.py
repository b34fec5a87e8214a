"""Registered queries of the operators, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from evalspark.llm import anchors, bit_whitening, block_ranking, chat, columns, jaccard, line_crf, packing, perplexity, product, secrets, subword, tree_bpe

QUERIES = {
    "op1_product_quantisation": product.op1_product_quantisation,
    "op2_chat_format": chat.op2_chat_format,
    "op3_curve_packing": packing.op3_curve_packing,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_perplexity_rules": perplexity.op5_perplexity_rules,
    "op6_merge_dropout": subword.op6_merge_dropout,
    "op7_column_dedup": columns.op7_column_dedup,
    "op8_line_quality": line_crf.op8_line_quality,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_fixed_anchors": anchors.op10_fixed_anchors,
    "op11_block_ranking": block_ranking.op11_block_ranking,
    "op12_bit_whitening": bit_whitening.op12_bit_whitening,
    "op13_tree_bpe": tree_bpe.op13_tree_bpe,
}
SQL = {"op2_chat_format": chat.SQL, "op4_secret_scan": secrets.SQL, "op11_block_ranking": block_ranking.SQL}
