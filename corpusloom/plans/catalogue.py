"""All queries of the library with their SQL."""

from __future__ import annotations

from . import chain_queries, corpus_queries, escape_queries, model_queries, sequence_queries

QUERIES = sequence_queries.QUERIES | model_queries.QUERIES | corpus_queries.QUERIES | chain_queries.QUERIES | escape_queries.QUERIES
SQL = sequence_queries.SQL | model_queries.SQL | corpus_queries.SQL | chain_queries.SQL | escape_queries.SQL
FLAGSHIP = "ranked_guides"
