"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from wardline.llm import (chats, html_text, jaccard, katz, mixing, neighbours, prefix_trie,
                          quality, repeats, sentencepiece, token_counts, toxicity, turn_repair)

QUERIES = {
    "op1_source_mix": mixing.query,
    "op2_ngram_jaccard": jaccard.query,
    "op3_sentencepiece": sentencepiece.query,
    "op4_toxicity": toxicity.query,
    "op5_token_counts": token_counts.query,
    "op6_katz_scores": katz.query,
    "op7_neighbours": neighbours.query,
    "op8_quality_rules": quality.query,
    "op9_chat_format": chats.query,
    "op10_html_text": html_text.query,
    "op11_turn_repair": turn_repair.query,
    "op12_repeated_bytes": repeats.query,
    "op13_prefix_trie": prefix_trie.query,
}
ORACLES = {
    "op1_source_mix": mixing.ORACLE,
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op9_chat_format": chats.ORACLE,
    "op11_turn_repair": turn_repair.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
