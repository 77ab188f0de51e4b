"""The subpackage's queries and oracle SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline

from . import decontamination, html, mixing, near_dup, passages, quality, sharding, substring_dedup, tokens, warc

QUERIES: dict[str, Callable] = {
    "op1_spaced_seeds": decontamination.op1_spaced_seeds,
    "op2_quality_votes": quality.op2_quality_votes,
    "op3_viterbi_counts": tokens.op3_viterbi_counts,
    "op4_lpt_shards": sharding.op4_lpt_shards,
    "op5_pfp_substrings": substring_dedup.op5_pfp_substrings,
    "op6_paragraph_minhash": passages.op6_paragraph_minhash,
    "op7_merkle_audit": warc.op7_merkle_audit,
    "op8_fair_mix": mixing.op8_fair_mix,
    "op9_html_blocks": html.op9_html_blocks,
    "op10_dart_minhash": near_dup.op10_dart_minhash,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op7_merkle_audit": warc.OP7_SQL,
}
