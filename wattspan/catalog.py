"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from wattspan.queries import ORACLE_SQL, QUERIES, aggregates, assets, dashboards, dynamics, physics, planning, runs, spatial, structure, temporal

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "assets", "dashboards", "dynamics", "physics", "planning", "runs", "spatial", "structure", "temporal"]
