"""Confidence of a plan, in fixed steps."""

from __future__ import annotations

from ..plans.catalog import Catalog
from ..plans.ir import Query

#: The base, the weights of the signals, the penalty for a note, the bounds.
BASE, SCHEMA, EXACT, ALIAS, KNOWN, GUESS = 0.30, 0.10, 0.20, 0.16, 0.05, 0.12
COVERAGE, NO_FIELDS, NO_SCHEMA_FIELDS = 0.15, 0.01, 0.08
FILTER, MORE_FILTERS, MOST_MORE = 0.10, 0.03, 3
SIGNAL, ORDER, NOTE, MOST_NOTES, LOW, HIGH = 0.03, 0.02, 0.05, 0.20, 0.15, 0.97


def confidence(q: Query, catalog: Catalog, notes: list[str]) -> float:
    """Between LOW and HIGH: what was recognised, less what had to be dropped."""
    score = BASE + (SCHEMA if catalog.entities else 0)
    if q.entity in catalog.entities:
        score += EXACT
    elif q.entity in catalog.entity_aliases.values():
        score += ALIAS
    else:
        score += KNOWN if catalog.entities else GUESS
    known = set(catalog.columns(q.entity))
    if not q.fields:
        score += NO_FIELDS
    elif not known:
        score += NO_SCHEMA_FIELDS
    else:
        score += COVERAGE * sum(f in known for f in q.fields) / len(q.fields)
    n = len(q.filters) + len(q.groups)
    if n:
        score += FILTER + MORE_FILTERS * min(n - 1, MOST_MORE)
    score += SIGNAL * (bool(q.aggregates) + bool(q.nested) + bool(q.joins)) + ORDER * bool(q.order_by)
    return round(min(HIGH, max(LOW, score - min(MOST_NOTES, NOTE * len(notes)))), 4)
