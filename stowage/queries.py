"""Registered queries of the inventory operators, with their SQL."""

from __future__ import annotations

from .operators import aggregations, dag, intake, joins, lifecycle, merkle, packing, rows, windows  # noqa: F401
from .plans import jobs, migration, reports, rounds  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
from .streaming import jobs as streaming_jobs  # noqa: F401
