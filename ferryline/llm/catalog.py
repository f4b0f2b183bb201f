"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, fill_middle, line_dedup, packing, quality, secret_scan, simhash, source_audit, substring_dedup, suffix_dedup, url_filter, vector_search, warc

QUERIES = {
    "op1_simhash": simhash.op1_query,
    "op2_substring_dedup": substring_dedup.op2_query,
    "op3_packing": packing.op3_query,
    "op4_secret_scan": secret_scan.op4_query,
    "op5_line_dedup": line_dedup.op5_query,
    "op6_vector_search": vector_search.op6_query,
    "op7_warc": warc.op7_query,
    "op8_quality": quality.op8_query,
    "op9_suffix_dedup": suffix_dedup.op9_query,
    "op10_decontamination": decontamination.op10_query,
    "op11_source_audit": source_audit.op11_query,
    "op12_url_filter": url_filter.op12_query,
    "op13_fill_middle": fill_middle.op13_query,
}

SQL = {
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_suffix_dedup": suffix_dedup.OP9_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op11_source_audit": source_audit.OP11_SQL,
    "op12_url_filter": url_filter.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
