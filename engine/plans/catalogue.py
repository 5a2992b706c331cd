"""Queries of the core and the SQL they are held against."""

from engine.operators.incremental import P2_SQL, p2_found
from engine.plans import corpus, documents, search, streams

QUERIES = {"p2_found": p2_found, **corpus.QUERIES, **search.QUERIES, **documents.QUERIES, **streams.QUERIES}
SQL = {"p2_found": P2_SQL, **corpus.SQL, **search.SQL, **documents.SQL, **streams.SQL}
