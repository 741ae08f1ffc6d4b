"""All registered queries of the ranking library, with the SQL that checks them."""

from __future__ import annotations

from .plans import boundaries, evaluation, lookups, ranking, records, sequences, texts

PLANS = (ranking, sequences, evaluation, lookups, texts, records, boundaries)
QUERIES = {name: q for plan in PLANS for name, q in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
