"""Streaming forms run over the tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import live

Q: dict = {}
SQL: dict[str, str] = {}

_EV = "ev AS (SELECT event_type AS input_id, event_id AS frame_id, user_id, value AS payload, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, (SELECT max(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) FROM events) AS top FROM events)"
_DAY = 86_400_000_000


def stream_tumbling(s, d):
    """Windows that the watermark has passed at the end; the last one stays open."""
    return live.drain(live.tumbling(live.frames(s, d), "1 day", "1 hour"))


def stream_sliding(s, d):
    return live.drain(live.sliding(live.frames(s, d), "12 hours", "6 hours", "1 hour"))


def stream_sessions(s, d):
    return live.drain(live.sessions(live.frames(s, d), "user_id", "6 hours", "1 hour"))


def stream_newest(s, d):
    return live.drain(live.newest_at_slots(live.frames(s, d), 3_600_000_000, "1 hour"))


def stream_reorder(s, d):
    packets = live.frames(s, d).where("frame_id % 97 <> 0").select(F.lit("track").alias("track"), F.col("frame_id").alias("number"), "at")
    return live.drain(live.in_order(packets, hold=50))


def stream_required(s, d):
    """Slots that two required inputs have passed; the others give what they have."""
    return live.drain(live.newest_when_ready(live.frames(s, d), ["click", "view"], 3_600_000_000, "1 hour"))


Q |= {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_newest, stream_reorder, stream_required)}
SQL["stream_tumbling"] = f"WITH {_EV} SELECT input_id, us // {_DAY} * {_DAY} AS start_us, count(*) AS n, round(sum(payload), 4) AS total FROM ev GROUP BY input_id, us // {_DAY}, top HAVING (us // {_DAY} + 1) * {_DAY} <= top // 1000 * 1000 - 3600000000"
SQL["stream_sliding"] = f"WITH {_EV}, w AS (SELECT *, (us // 21600000000 - k) * 21600000000 AS start_us FROM ev, (VALUES (0), (1)) v(k)) SELECT input_id, start_us, count(*) AS n, max(payload) AS high FROM w GROUP BY input_id, start_us, top HAVING start_us + 43200000000 <= top // 1000 * 1000 - 3600000000"
SQL["stream_sessions"] = (
    f"WITH {_EV}, l AS (SELECT *, CASE WHEN us - lag(us) OVER w >= 21600000000 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, frame_id)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, frame_id ROWS UNBOUNDED PRECEDING) AS run FROM l) "
    "SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS n FROM g GROUP BY user_id, run, top HAVING max(us) + 21600000000 <= top // 1000 * 1000 - 3600000000"
)
SQL["stream_newest"] = f"WITH {_EV} SELECT input_id, (us // 3600000000 + 1) * 3600000000 AS slot_us, arg_max(frame_id, us) AS frame_id FROM ev GROUP BY input_id, us // 3600000000, top HAVING (us // 3600000000 + 1) * 3600000000 <= top // 1000 * 1000 - 3600000000"
SQL["stream_reorder"] = "SELECT 'track' AS track, event_id AS number, false AS late FROM events WHERE event_id % 97 <> 0"
SQL["stream_required"] = (
    f"WITH {_EV}, m AS (SELECT min(t) // 1000 * 1000 - 3600000000 AS mark FROM (SELECT max(us) AS t FROM ev WHERE input_id IN ('click', 'view') GROUP BY input_id)) "
    "SELECT input_id, (us // 3600000000 + 1) * 3600000000 AS slot_us, arg_max(frame_id, us) AS frame_id FROM ev, m GROUP BY input_id, us // 3600000000, mark HAVING (us // 3600000000 + 1) * 3600000000 <= mark"
)
