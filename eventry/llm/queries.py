"""Registered corpus queries, gathered from the operator modules."""

from eventry.llm import chat_format, decontaminate, exact_dedup, language_id, license_scan, line_dedup, merkle, mixing, pii, prefix_trie, quality, simhash, token_count

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (pii, quality, license_scan, exact_dedup, token_count, chat_format, decontaminate, simhash, mixing, language_id, prefix_trie, merkle, line_dedup):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
