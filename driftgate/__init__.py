"""Drift-gated continuous aggregates over distributed sub-streams, on Spark DataFrames."""

from driftgate.functions.keys import SketchShape, hashed_key, pair_key, site_of
from driftgate.plans.gate import GateConfig, MonitorResult, monitor
from driftgate.plans.spec import ExactF2, MonitorSpec, SketchF2, SketchJoin
from driftgate.session import WorkArea, build_session
from driftgate.streaming.monitor import StreamMonitor, monitor_stream

__all__ = [
    "ExactF2",
    "GateConfig",
    "MonitorResult",
    "MonitorSpec",
    "SketchF2",
    "SketchJoin",
    "SketchShape",
    "StreamMonitor",
    "WorkArea",
    "build_session",
    "hashed_key",
    "monitor",
    "monitor_stream",
    "pair_key",
    "site_of",
]
