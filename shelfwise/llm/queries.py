"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelfwise.llm import decontam, divergence, html, jaccard, lines, lm, mixing, pii, quality, repair, suffix, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_lm_scoring": lm.op3_lm_scoring,
    "op4_suffix_dedup": suffix.op4_suffix_dedup,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_pii_surrogates": pii.op8_pii_surrogates,
    "op9_warc": warc.op9_warc,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_exact_top_k": topk.op13_exact_top_k,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op7_source_mixing": mixing.OP7_SQL,
    "op9_warc": warc.OP9_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_exact_top_k": topk.OP13_SQL,
}
