"""The queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellarmark.llm import best_fit, chat, decontamination, fingerprints, license_scan, merkle, minmax, packing, quality, sharding, token_files, url_reputation, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minmax_near_dedup": minmax.op1_minmax_near_dedup,
    "op2_kneser_ney_quality": quality.op2_kneser_ney_quality,
    "op3_event_sourced_chat": chat.op3_event_sourced_chat,
    "op4_license_digests": license_scan.op4_license_digests,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_containment_search": decontamination.op6_containment_search,
    "op7_url_reputation": url_reputation.op7_url_reputation,
    "op8_label_propagation": sharding.op8_label_propagation,
    "op9_harmonic_packing": packing.op9_harmonic_packing,
    "op10_token_files": token_files.op10_token_files,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_best_fit_packing": best_fit.op13_best_fit_packing,
}

ORACLE: dict[str, str] = {
    "op4_license_digests": license_scan.OP4_SQL,
    "op7_url_reputation": url_reputation.OP7_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
}
