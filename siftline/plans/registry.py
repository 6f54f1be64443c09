"""All queries of the library outside the training-data subpackage, with their SQL oracles."""

from __future__ import annotations

from siftline.plans import corpus, delivery, mail

_MODULES = [delivery, corpus, mail]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
