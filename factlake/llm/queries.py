"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from factlake.llm import ann_search, collocations, embedding_dups, language_id, license_scan, line_templates, packing, quality, secret_scan, simhash, source_audit, source_mix, warc

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_simhash_dups": simhash.query,
    "op3_embedding_dups": embedding_dups.query,
    "op5_language_id": language_id.query,
    "op8_secret_scan": secret_scan.query,
    "op9_source_mix": source_mix.query,
    "op4_packing": packing.query,
    "op6_line_templates": line_templates.query,
    "op7_warc_index": warc.query,
    "op10_ann_search": ann_search.query,
    "op11_quality": quality.query,
    "op12_collocations": collocations.query,
    "op13_source_audit": source_audit.query,
}
ORACLES: dict[str, str] = {
    "op6_line_templates": line_templates.ORACLE,
    "op8_secret_scan": secret_scan.ORACLE,
    "op9_source_mix": source_mix.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_source_audit": source_audit.ORACLE,
}
