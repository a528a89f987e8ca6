"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import license_scan, line_dedup, near_dedup, packing, piece_sampling, quality, simhash, token_count, token_file, topk

MODULES = (token_count, quality, license_scan, topk, line_dedup, near_dedup, packing, token_file, piece_sampling, simhash)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
