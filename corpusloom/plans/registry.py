"""All registered queries and their SQL."""

from corpusloom.plans import (cache_queries, catalog_queries, corpus_queries,
                              evaluation_queries, retrieval_queries)

_MODULES = (catalog_queries, retrieval_queries, cache_queries, evaluation_queries, corpus_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: text for m in _MODULES for name, text in m.ORACLE.items()}
