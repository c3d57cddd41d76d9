"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from . import bpe, edits, langid, lattice, licences, minhash, mixing, negatives, phrases, quality, substrings, topk, urls

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_bpe_round_trip": bpe.query,
    "op3_substring_dedup": substrings.query,
    "op4_soft_mixing": mixing.query,
    "op5_edit_counts": edits.query,
    "op6_minhash_near_dedup": minhash.query,
    "op7_embedding_near_dedup": lattice.query,
    "op8_exact_top_k": topk.query,
    "op9_license_scan": licences.query,
    "op10_language_id": langid.query,
    "op11_hard_negatives": negatives.query,
    "op12_url_filters": urls.query,
    "op13_phrase_collocations": phrases.query,
}

SQL = {
    "op3_substring_dedup": substrings.SQL,
    "op6_minhash_near_dedup": minhash.SQL,
    "op7_embedding_near_dedup": lattice.SQL,
    "op8_exact_top_k": topk.SQL,
    "op9_license_scan": licences.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_url_filters": urls.SQL,
    "op13_phrase_collocations": phrases.SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
