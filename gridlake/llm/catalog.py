"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from gridlake.llm import (bpe, decontaminate, hash_ring, language, merkle, near_dup, periodic_runs, quality_rules,
                          sentence_pieces, suffix_dedup, toxicity, url_filter, warc)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_language": language.op2_language,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_hash_ring": hash_ring.op6_hash_ring,
    "op7_bpe": bpe.op7_bpe,
    "op8_warc": warc.op8_warc,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_sentencepiece": sentence_pieces.op11_sentencepiece,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
