"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import core, evaluation, features, impact, learning, more, resources, sequence, signatures, state, streams, versions

MODULES = [core, sequence, state, streams, more, evaluation, resources, signatures, versions, learning, features, impact]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
