"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from gleaner.plans import code_queries, graph_queries, index_queries, misc_queries, quality_queries, source_queries, text_queries

QUERIES = {**index_queries.QUERIES, **graph_queries.QUERIES, **code_queries.QUERIES, **quality_queries.QUERIES, **source_queries.QUERIES, **text_queries.QUERIES, **misc_queries.QUERIES}
SQL = {**index_queries.SQL, **graph_queries.SQL, **code_queries.SQL, **quality_queries.SQL, **source_queries.SQL, **text_queries.SQL, **misc_queries.SQL}
