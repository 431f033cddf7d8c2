"""Queries and SQL of this folder's operators."""

from crossweave.llm import alignment, compaction, decontamination, exact_dedup, html_text, license_scan, packing, sharding, simhash, suffix_dedup, token_counts, token_ids, toxicity

MODULES = (decontamination, packing, license_scan, html_text, toxicity, simhash, exact_dedup, token_counts, token_ids, sharding, alignment, suffix_dedup, compaction)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
