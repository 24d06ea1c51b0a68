"""Readers and sinks."""

from .publication import publish, published, read_published
from .sinks import append_report, read_report
from .snapshots import SnapshotSource, align, read_snapshots

__all__ = ["SnapshotSource", "align", "append_report", "publish", "published", "read_published", "read_report", "read_snapshots"]
