"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, licenses, packing, quality, secrets, sharding, tiff, token_counts, toxicity

QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_tiff_media": tiff.op4_tiff_media,
    "tiff_pages": tiff.tiff_pages,
    "op5_packing": packing.op5_packing,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_sharding": sharding.op7_sharding,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

ORACLE_SQL = {
    "op1_license_scans": licenses.OP1_SQL,
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op9_ngram_jaccard_join": jaccard.OP9_SQL,
}
