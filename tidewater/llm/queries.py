"""The operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .common import small_batches
from . import (centroids, collocations, decontaminate, fingerprint, licenses, line_dedup, lm, mixing, near_dedup, quality, secrets,
               sharding, substring_dedup)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_sharding": sharding.op4_sharding,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality": quality.op7_quality,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_secret_scan": secrets.op12_secret_scan,
    "op13_collocations": collocations.op13_collocations,
}
QUERIES = {name: small_batches(query) for name, query in QUERIES.items()}

SQL = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op5_license_scan": licenses.OP5_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_centroid_clustering": centroids.OP11_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
