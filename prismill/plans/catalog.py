"""Every query of this folder and its SQL, by name."""

from __future__ import annotations

from prismill.plans import analytics, nearest, python, relational, scale, streams

QUERIES, ORACLES = relational.QUERIES, relational.ORACLES
MODULES = (relational, analytics, python, streams, nearest, scale)
