"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagweave.llm import chat, decontaminate, divergence, langid, lm, ngram_join, pii, quality, search, sentencepiece_scan, toxicity, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_pii": pii.op2_pii,
    "op3_sentencepiece": sentencepiece_scan.op3_sentencepiece,
    "op4_url_filters": urlfilter.op4_url_filters,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_language_id": langid.op8_language_id,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_lexical_search": search.op11_lexical_search,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_warc": warc.op13_warc,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op10_quality_rules": quality.SQL,
    "op11_lexical_search": search.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_warc": warc.SQL,
}
