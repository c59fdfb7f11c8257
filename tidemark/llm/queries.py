"""The registered queries of the corpus operators and the SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import decontam, html_extract, lexical, license_scan, line_dedup, packing, periodic, pii, quality, sharding, simhash, substring_dedup, suffix_dedup
from tidemark.llm.common import table


def queries():
    return {
        "op1_site_spread": lambda s, d: line_dedup.op1_site_spread(table(s, d, "documents")),
        "op2_stratified_interleaving": lambda s, d: sharding.op2_stratified_interleaving(table(s, d, "documents")),
        "op3_fuzzy_notices": lambda s, d: license_scan.op3_fuzzy_notices(table(s, d, "documents")),
        "op4_covering": lambda s, d: simhash.op4_covering(table(s, d, "documents")),
        "op5_induced_suffixes": lambda s, d: suffix_dedup.op5_induced_suffixes(table(s, d, "documents")),
        "op6_covariance_outliers": lambda s, d: quality.op6_covariance_outliers(table(s, d, "documents")),
        "op7_anchor_expansion": lambda s, d: pii.op7_anchor_expansion(table(s, d, "documents")),
        "op8_differencing": lambda s, d: packing.op8_differencing(table(s, d, "documents")),
        "op9_text_to_tag": lambda s, d: html_extract.op9_text_to_tag(table(s, d, "pages")),
        "op10_wu_manber": lambda s, d: decontam.op10_wu_manber(table(s, d, "documents"), table(s, d, "benchmark")),
        "op11_sharded_postings": lambda s, d: lexical.op11_sharded_postings(table(s, d, "documents"), table(s, d, "benchmark")),
        "op12_prefix_subtrees": lambda s, d: substring_dedup.op12_prefix_subtrees(table(s, d, "documents")),
        "op13_harmonic_grid": lambda s, d: periodic.op13_harmonic_grid(table(s, d, "documents")),
    }


def oracle_sql():
    return {"op1_site_spread": line_dedup.ORACLE_SQL, "op10_wu_manber": decontam.ORACLE_SQL, "op11_sharded_postings": lexical.ORACLE_SQL, "op12_prefix_subtrees": substring_dedup.ORACLE_SQL}
