"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tracelake.llm import decontaminate, exact_dedup, html_text, hyperminhash, jaccard_join, language, license_scan, merkle, packing, quality, spelling, suffix_dedup, url_rules
from tracelake.llm.near_sql import components_sql


def queries():
    return {
        "op1_html_text": html_text.query,
        "op2_license_scan": license_scan.query,
        "op3_quality": quality.query,
        "op4_url_rules": url_rules.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_language": language.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_packing": packing.query,
        "op9_jaccard_join": jaccard_join.query,
        "op10_decontamination": decontaminate.query,
        "op11_hyperminhash_dedup": hyperminhash.query,
        "op12_spelling_variants": spelling.query,
        "op13_merkle_manifest": merkle.query,
    }


def oracle_sql():
    return {
        "op4_url_rules": url_rules.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op9_jaccard_join": components_sql(jaccard_join.WORDS, kept=False),
        "op11_hyperminhash_dedup": components_sql(hyperminhash.WORDS, kept=True),
        "op12_spelling_variants": spelling.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
