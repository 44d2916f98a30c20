"""Queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, licences, merkle, quality, quotes, repeats, secrets, simhash, spelling, toxicity, url_rules, vectors

QUERIES = {
    "op1_near_vectors": vectors.op1_near_vectors,
    "op2_quality": quality.op2_quality,
    "op3_url_rules": url_rules.op3_url_rules,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_quote_links": quotes.op5_quote_links,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_licences": licences.op8_licences,
    "op9_simhash": simhash.op9_simhash,
    "op10_repeated_bytes": repeats.op10_repeated_bytes,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {"op1_near_vectors": vectors.ORACLE}
