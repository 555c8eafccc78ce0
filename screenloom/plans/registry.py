"""All queries of the engine by name."""

from __future__ import annotations

from screenloom.plans import boundary_plans, flow_plans, profile_plans, role_plans, scoring_plans, stream_plans, text_plans

PLANS = (scoring_plans, profile_plans, text_plans, stream_plans, boundary_plans, role_plans, flow_plans)
QUERIES: dict = {k: v for p in PLANS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in PLANS for k, v in p.ORACLE_SQL.items()}
