"""All queries of the core library by key."""

from __future__ import annotations

from quillspark.plans import asking, composed, content, corpus, evaluating, ranking, retrieval, structure

MODULES = (retrieval, composed, ranking, evaluating, corpus, asking, content, structure)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
