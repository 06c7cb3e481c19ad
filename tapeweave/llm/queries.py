"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from tapeweave.llm import (
    decontam,
    exact_dedup,
    htmltext,
    jaccard,
    language,
    licenses,
    packing,
    quality,
    secrets,
    sharding,
    spelling,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_cutting_stock_packing": packing.op1_cutting_stock_packing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_benchmark_decontamination": decontam.op3_benchmark_decontamination,
    "op4_html_extraction": htmltext.op4_html_extraction,
    "op5_language_id": language.op5_language_id,
    "op6_weak_label_quality": quality.op6_weak_label_quality,
    "op7_feistel_sharding": sharding.op7_feistel_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_secret_scan": secrets.op13_secret_scan,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op10_license_scan": licenses.oracle_sql(),
    "op11_spelling_variants": spelling.OP11_SQL,
    "op13_secret_scan": secrets.oracle_sql(),
}
