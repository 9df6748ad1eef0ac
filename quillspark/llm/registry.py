"""All queries of this subpackage by key, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillspark.llm import answer_defects, leakage, near_duplicates, page_spam, scan_repair, sentences, source_mixing, splitting

MODULES = (scan_repair, near_duplicates, splitting, sentences, answer_defects, leakage, source_mixing, page_spam)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in getattr(module, "SQL", {}).items()}
