"""Every registered query and its SQL oracle, collected from the plan modules."""

from __future__ import annotations

from weftline.plans import assignment, evidence, identities, people, rosters, storage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (people, evidence, assignment, rosters, identities, storage):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
