"""Registered queries, grouped by what they read, and the SQL each is checked against."""

from corpusmith.plans import answers, changes, chunks, graph, integrity, pages, search, streams, texts

_GROUPS = [search, texts, answers, chunks, graph, integrity, pages, changes, streams]

QUERIES = {k: v for g in _GROUPS for k, v in g.QUERIES.items()}
ORACLE = {k: v for g in _GROUPS for k, v in g.ORACLE.items()}
