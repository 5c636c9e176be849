"""All reference queries: QUERIES (Spark) and ORACLES (SQL for the same tables)."""

from __future__ import annotations

from terrane.plans import allocation, analysis, audits, calibration, files, flows, geometry, identity, names, optimum, polygons, roads, sources, spatial, toponymy, workplace

QUERIES: dict = {}
ORACLES: dict = {}
for module in (flows, analysis, calibration, identity, spatial, names, sources, workplace, allocation, toponymy, audits, geometry, polygons, files, optimum, roads):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
