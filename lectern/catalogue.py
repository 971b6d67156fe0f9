"""Every query of the engine by name, with its SQL where there is one."""

from __future__ import annotations

from lectern.operators import assessment, candidates, corpus, evidence, grading, intervals, languages, learning, metrics, placement, planner, quizdocs, records, retrieval, scheduling, seeds, splitting, structure, support, topics, upkeep, visuals
from lectern.streaming import activity

QUERIES = {}
ORACLES = {}
for module in (learning, intervals, metrics, retrieval, corpus, assessment, planner, scheduling, placement, records, grading, quizdocs, candidates, languages, evidence, support, visuals, structure, splitting, seeds, topics, upkeep, activity):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
