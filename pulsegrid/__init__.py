"""Pulsegrid: time-series telemetry analytics on PySpark DataFrames."""

from pulsegrid.plans.query import aggregated_query, query_series, raw_query
from pulsegrid.plans.rebuild import rebuild_rollups, validate_rollups
from pulsegrid.schema import normalize
from pulsegrid.session import build_session
from pulsegrid.sources.rollups import RollupStore

__all__ = [
    "RollupStore",
    "aggregated_query",
    "build_session",
    "normalize",
    "query_series",
    "raw_query",
    "rebuild_rollups",
    "validate_rollups",
]
