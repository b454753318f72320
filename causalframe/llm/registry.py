"""The queries of the text operators and their SQL."""

from causalframe.llm import decontaminate, exact_dedup, ngram_join, packing, pii, quality, secrets, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op2_near": decontaminate.op2_near,
    "op3_pack": packing.op3_pack,
    "op4_secrets": secrets.op4_secrets,
    "op5_url_filter": url_filter.op5_url_filter,
    "op5_listed": url_filter.op5_listed,
    "op6_pii": pii.op6_pii,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op5_listed": url_filter.LISTED_ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
}
