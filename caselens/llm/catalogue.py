"""Queries and SQL of all corpus operators."""

from __future__ import annotations

from . import decontaminate, jaccard_join, license_scan, piece_codec, quality_qda, quality_rules, secret_scan, suffix_dedup, token_binary, toxicity

MODULES = (quality_rules, piece_codec, secret_scan, decontaminate, quality_qda, toxicity, license_scan, jaccard_join, suffix_dedup, token_binary)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
