"""Screening analytics on Spark: functions, operators, sources, streams and registered queries."""

from screenloom.functions import dates, display, markup, profile, text
from screenloom.operators import evidence, experience, ingest, lifecycle, ranking, roles, rules, scoring, validation
from screenloom.sources import files, replies, tables
from screenloom.streaming import events

__all__ = ["dates", "display", "events", "evidence", "experience", "files", "ingest", "lifecycle", "markup", "profile", "ranking", "replies", "roles", "rules", "scoring", "tables", "text", "validation"]
