"""All registered queries over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

from veridict.plans import ORACLES, QUERIES, accuracy, judging, labels, models, orders, parity, planning, reliability, scopes, statistics, subsets, trees

__all__ = ["ORACLES", "QUERIES", "accuracy", "judging", "labels", "models", "orders", "parity", "planning", "reliability", "scopes", "statistics", "subsets", "trees"]
