"""Registered queries of the event-valuation library, each with its SQL where SQL can express it."""

from eventry.plans import q_basic, q_joins, q_learn, q_windows

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (q_basic, q_joins, q_windows, q_learn):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
