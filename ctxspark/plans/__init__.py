"""The registered queries, each with its oracle SQL where SQL can say it."""

from ctxspark.plans import aggregates, graphs, scalars, searches, stores

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (scalars, aggregates, graphs, searches, stores):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
