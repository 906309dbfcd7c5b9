"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, credentials, decontam, fim, licenses, mixing, packing, prefix_trie, quality_crf, rules, simhash, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality_crf.op1_quality,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_chat": chat.op7_chat,
    "op8_mixing": mixing.op8_mixing,
    "op9_licenses": licenses.op9_licenses,
    "op10_secrets": credentials.op10_secrets,
    "op11_urls": urls.op11_urls,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_fim": fim.op13_fim,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontam.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op6_quality_rules": rules.OP6_SQL,
    "op7_chat": chat.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op9_licenses": licenses.OP9_SQL,
    "op11_urls": urls.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
    "op13_fim": fim.OP13_SQL,
}
