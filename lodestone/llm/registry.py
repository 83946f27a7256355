"""Queries of the corpus operators and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import bpe, centroids, importance, knn, licenses, media, packing, pii, repair, simhash, substring, toxicity, url_filter

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_bpe": bpe.query,
    "op3_simhash": simhash.query,
    "op4_knn": knn.query,
    "op5_substring": substring.query,
    "op6_media": media.query,
    "op7_url_filter": url_filter.query,
    "op8_packing": packing.query,
    "op9_licenses": licenses.query,
    "op10_repair": repair.query,
    "op11_pii": pii.query,
    "op12_centroids": centroids.query,
    "op13_importance": importance.query,
}

ORACLES = {
    "op4_knn": knn.SQL,
    "op5_substring": substring.SQL,
    "op7_url_filter": url_filter.SQL,
    "op12_centroids": centroids.SQL,
    "op13_importance": importance.SQL,
}
