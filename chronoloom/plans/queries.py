"""All queries of the library itself, and SQL for those that SQL can express."""

from __future__ import annotations

from . import buffers, layout, services, streams, timing  # noqa: F401 (buffers and services add to timing)

QUERIES = timing.Q | layout.Q | streams.Q
ORACLE_SQL = timing.SQL | layout.SQL | streams.SQL
FLAGSHIP = "frame_sampler"
