"""Structured Streaming forms of the monitor and of delayed labels."""

from .labels import match_outcomes
from .monitor import late_rows, monitor_windows, run_monitor

__all__ = ["late_rows", "match_outcomes", "monitor_windows", "run_monitor"]
