"""The queries of this subpackage, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillspan.llm import iblt, language_id, mixing, packing, pii, quality_classifier, quality_rules, runs, sharding, simhash, spelling, token_counts, url_filters

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_language_id": language_id.op4_language_id,
    "op5_iblt": iblt.op5_iblt,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_sharding": sharding.op10_sharding,
    "op11_quality_classifier": quality_classifier.op11_quality_classifier,
    "op12_spelling": spelling.op12_spelling,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op9_url_filters": url_filters.ORACLE_SQL,
}
