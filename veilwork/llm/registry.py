"""Queries of the training-data operators and the SQL that checks them, by name."""

from __future__ import annotations

from . import (
    embedding_dedup,
    exact_dedup,
    html_text,
    jaccard_join,
    license_scan,
    mixing,
    periodic_runs,
    phrase_fingerprint,
    quality,
    sentencepiece_dropout,
    spelling_variants,
    token_counts,
    toxicity,
)

QUERIES = {
    "op6_quality": quality.op6_quality,
    "op10_html_text": html_text.op10_html_text,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_toxicity": toxicity.op9_toxicity,
    "op1_sentencepiece": sentencepiece_dropout.op1_sentencepiece,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op4_license_scan": license_scan.op4_license_scan,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_phrase_fingerprint": phrase_fingerprint.op13_phrase_fingerprint,
}

SQL = {
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_embedding_dedup": embedding_dedup.SQL,
    "op4_license_scan": license_scan.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op11_spelling_variants": spelling_variants.SQL,
}
