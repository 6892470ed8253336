"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from winnow.llm import centroids, decontamination, jaccard_join, licenses, mixing, quality, quality_rules, sharding, simhash, spelling, token_counts, toxicity, url_filter

QUERIES = {
    "op1_feistel_shards": sharding.op1_feistel_shards,
    "op2_contaminated": decontamination.op2_contaminated,
    "op3_simhash_groups": simhash.op3_simhash_groups,
    "op4_cotraining": quality.op4_cotraining,
    "op5_url_words": url_filter.op5_url_words,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_fair_mix": mixing.op7_fair_mix,
    "op8_token_rollup": token_counts.op8_token_rollup,
    "op9_license_spans": licenses.op9_license_spans,
    "op10_perplexity": quality_rules.op10_perplexity,
    "op11_spelling": spelling.op11_spelling,
    "op12_jaccard": jaccard_join.op12_jaccard,
    "op13_hamerly": centroids.op13_hamerly,
    # what SQL can express of operators with a learned part
    "url_rules": url_filter.url_rules,
    "license_bases": licenses.license_bases,
    "quality_bases": quality_rules.quality_bases,
}

SQL = {
    "op1_feistel_shards": sharding.OP1_SQL,
    "op7_fair_mix": mixing.OP7_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_jaccard": jaccard_join.OP12_SQL,
    "op13_hamerly": centroids.OP13_SQL,
    "url_rules": url_filter.URL_SQL,
    "license_bases": licenses.LICENSE_SQL,
    "quality_bases": quality_rules.QUALITY_SQL,
}
