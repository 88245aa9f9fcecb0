"""The registered queries over the tables of a folder, by operator."""

from __future__ import annotations

from aeonframe.plans import analysis, atlas, expansion, fields, reports
from aeonframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis", "atlas", "expansion", "fields", "reports"]
