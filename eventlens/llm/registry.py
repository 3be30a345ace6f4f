"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm import (
    bpe,
    chat,
    fingerprints,
    jaccard,
    language,
    lexical,
    mixing,
    packing,
    prefix_trie,
    quality,
    secrets,
    sharding,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_secret_scans": secrets.op2_secret_scans,
    "op3_mixing": mixing.op3_mixing,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_warc": warc.op5_warc,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_language_id": language.op8_language_id,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_sharding": sharding.op10_sharding,
    "op11_packing": packing.op11_packing,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_lexical_search": lexical.op13_lexical_search,
}
ORACLE: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op5_warc": warc.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
