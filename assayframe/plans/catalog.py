"""All registered queries and their SQL."""

from __future__ import annotations

from assayframe.plans import growing, logrules, lookup, measure, quality, runs

_SHELVES = (measure.SHELF, lookup.SHELF, runs.SHELF, logrules.SHELF, quality.SHELF, growing.SHELF)


def all_queries():
    return {name: fn for shelf in _SHELVES for name, fn in shelf.queries.items()}


def all_oracles():
    return {name: sql for shelf in _SHELVES for name, sql in shelf.oracles.items()}
