"""Queries of the corpus operators, with the SQL they are checked against where SQL can express it."""

from __future__ import annotations

from . import centroids, exact_dedup, fixity, html_wrapper, language_id, manifest, media, mixing, near_dedup, piece_codec, preference, pseudonyms, simhash


def queries():
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_merkle_fixity": fixity.query,
        "op3_preference_format": preference.query,
        "op4_html_wrapper": html_wrapper.query,
        "op5_flac_media": media.query,
        "op6_splitting_tree_mix": mixing.query,
        "op7_feistel_pseudonyms": pseudonyms.query,
        "op8_bigru_language_id": language_id.query,
        "op9_sentencepiece": piece_codec.query,
        "op10_circulant_minhash": near_dedup.query,
        "op11_heap_kmeans": centroids.query,
        "op12_slot_pivot_manifest": manifest.query,
        "op13_pigeonhole_simhash": simhash.query,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_merkle_fixity": fixity.ORACLE,
        "op3_preference_format": preference.ORACLE,
        "op6_splitting_tree_mix": mixing.ORACLE,
        "op11_heap_kmeans": centroids.ORACLE,
        "op12_slot_pivot_manifest": manifest.ORACLE,
    }
