"""Registered queries: each maps the driver's tables to one operator of the inventory.

Oracle SQL is DuckDB SQL over the same parquet tables (pre-registered as views); it is
written as an independent formulation (e.g. a recursive CTE for greedy packing) and
aliases every column to the Spark names. Queries without SQL are checked rows-only.
"""

from __future__ import annotations

from . import q_chunking, q_generate, q_instruct, q_io, q_scores, q_synth, q_tokens  # noqa: F401
from .registry import QUERIES, Builder, register, table  # noqa: F401
