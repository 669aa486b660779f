"""The queries of the library, and their SQL where SQL can express them."""

from formlens.plans import curation, evaluation, layouts, making, vectors

_GROUPS = (layouts, evaluation, curation, vectors, making)
QUERIES = {name: query for group in _GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
