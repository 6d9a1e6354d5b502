"""Queries over aligned, chunked and numbered streams, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from ..operators import align, lifecycle, ordered, sequence, sessions, stats
from ..sources import tables

H, D = clock.HOUR, clock.DAY
EV = "ev AS (SELECT event_id AS frame_id, event_type AS input_id, user_id, value AS payload, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS pts FROM events)"
SLOTS = f"slots AS (SELECT range AS slot_ix, range * {H} AS slot_pts FROM range((SELECT max(pts) // {H} + 1 FROM ev)))"
GRID = f"WITH {EV}, {SLOTS}, inputs AS (SELECT DISTINCT input_id FROM ev), grid AS (SELECT slot_pts, input_id FROM slots, inputs), shown AS (SELECT g.slot_pts, g.input_id, e.frame_id, e.pts FROM grid g ASOF LEFT JOIN ev e ON g.input_id = e.input_id AND g.slot_pts >= e.pts)"

#: Parts in groups of twenty-five, as parents and numbered children.
GROUPS = "(SELECT p_partkey // 25 AS n_regionkey, p_partkey % 25 AS n_nationkey FROM part)"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{GROUPS}", GROUPS)
        return f

    return add


def _groups(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return tables.table(s, d, "part").select(F.floor(k / 25).cast("long").alias("n_regionkey"), (k % 25).alias("n_nationkey"))


def _slots(s: SparkSession, d: str, period: int = H, more: int = 0) -> DataFrame:
    """A slot each period up to the last frame, and ``more`` beyond it."""
    last = _frames(s, d).agg(F.max("pts")).first()[0] or 0
    return clock.period_grid(s, 0, (last // period + 1 + more) * period, period)


def _frames(s: SparkSession, d: str) -> DataFrame:
    return tables.frames(s, d)


def _daily(df: DataFrame, column: str = "pts") -> DataFrame:
    return df.withColumn("day", F.floor(F.col(column) / D).cast("long"))


@query(f"{GRID} SELECT * FROM shown")
def frame_sampler(s, d):
    return align.sample_frames(_frames(s, d), _slots(s, d))


@query(f"{GRID} SELECT slot_pts, input_id, CASE WHEN slot_pts - {H // 2} <= pts THEN frame_id END AS frame_id, CASE WHEN slot_pts - {H // 2} <= pts THEN pts END AS pts FROM shown")
def frame_sampler_stale(s, d):
    return align.sample_frames(_frames(s, d), _slots(s, d), stale_after=H // 2)


@query(
    f"{GRID}, ends AS (SELECT input_id, max(pts) AS last_pts FROM ev GROUP BY 1), stop AS (SELECT e.input_id, min(slot_pts) AS last_slot FROM ends e JOIN slots ON slot_pts >= last_pts GROUP BY 1) "
    "SELECT slot_pts, input_id, CASE WHEN last_slot IS NULL OR slot_pts <= last_slot THEN frame_id END AS frame_id, CASE WHEN last_slot IS NULL OR slot_pts <= last_slot THEN pts END AS pts FROM shown LEFT JOIN stop USING (input_id)"
    .replace("+ 1 FROM ev", "+ 41 FROM ev")
)
def frame_sampler_last_once(s, d):
    return align.sample_frames(_frames(s, d), _slots(s, d, more=40), last_once=True)


@query(f"{GRID} SELECT slot_pts, count(frame_id) AS n, coalesce(string_agg(input_id || '=' || frame_id, ',' ORDER BY input_id), '') AS frames FROM shown GROUP BY 1")
def frame_sets(s, d):
    sets = align.frame_sets(align.sample_frames(_frames(s, d), _slots(s, d)))
    entries = F.array_sort(F.map_entries("frames"))
    return sets.select("slot_pts", F.size(entries).cast("long").alias("n"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("frames"))


@query("SELECT range AS slot_ix, CAST(floor(range * CAST(1001 AS DOUBLE) / 30000 * 1000000000) AS BIGINT) AS slot_pts FROM range(300)")
def slot_grid(s, d):
    return clock.slot_grid(s, 0, 10_010_000_000, 30_000, 1001)


@query(f"WITH {EV} SELECT frame_id, greatest(0, CAST(floor((pts // 1000 - 80000000) / 20000000.0) AS BIGINT)) AS chunk_ix FROM ev")
def chunk_assign(s, d):
    return align.assign_chunks(_frames(s, d).select("frame_id", F.floor(F.col("pts") / 1000).cast("long").alias("start_pts"))).select("frame_id", "chunk_ix")


@query(f"WITH {EV} SELECT frame_id, greatest(0, CAST(floor((pts // 1000 + 100000000 - 80000000) / 20000000.0) AS BIGINT), 4) AS chunk_ix FROM ev")
def chunk_assign_from_start(s, d):
    batches = _frames(s, d).select("frame_id", F.floor(F.col("pts") / 1000).cast("long").alias("start_pts"))
    return align.assign_chunks(batches, from_start=100 * clock.MS).select("frame_id", "chunk_ix")


@query(f"WITH {EV} SELECT input_id, pts // {H} AS chunk, count(*) AS n, round(sum(payload), 4) AS total FROM ev GROUP BY 1, 2")
def tumbling_counts(s, d):
    f = _frames(s, d)
    return f.groupBy("input_id", clock.chunk_of(F.col("pts"), size=H).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("payload"), 4).alias("total"))


@query(
    f"WITH {EV} SELECT frame_id, input_id, count(*) OVER w AS n, round(sum(payload) OVER w, 4) AS total, round(avg(payload) OVER w, 9) AS mean, min(payload) OVER w AS low, max(payload) OVER w AS high FROM ev "
    f"WINDOW w AS (PARTITION BY input_id ORDER BY pts RANGE BETWEEN {6 * H} PRECEDING AND CURRENT ROW)"
)
def sliding_stats(s, d):
    p = F.col("payload")
    out = stats.sliding(_frames(s, d), ["input_id"], "pts", 6 * H, {"n": ("count", F.lit(1)), "total": ("sum", p), "mean": ("avg", p), "low": ("min", p), "high": ("max", p)})
    return out.select("frame_id", "input_id", "n", F.round("total", 4).alias("total"), F.round("mean", 9).alias("mean"), "low", "high")


@query(
    f"WITH {EV}, b AS (SELECT *, CAST(floor(payload) AS BIGINT) AS size FROM ev) SELECT frame_id, CAST(sum(size) OVER (PARTITION BY input_id ORDER BY pts RANGE BETWEEN {60 * clock.NS} PRECEDING AND CURRENT ROW) * 8 // 60 AS BIGINT) AS rate_minute, "
    f"CAST(sum(size) OVER (PARTITION BY input_id ORDER BY pts RANGE BETWEEN {H} PRECEDING AND CURRENT ROW) * 8 // 3600 AS BIGINT) AS rate_hour FROM b"
)
def bit_rate(s, d):
    f = _frames(s, d).withColumn("size", F.floor("payload").cast("long"))
    return stats.bit_rate(f, ["input_id"], "pts", "size", {"rate_minute": 60, "rate_hour": 3600}).select("frame_id", "rate_minute", "rate_hour")


@query(f"WITH {EV} SELECT user_id, max(pts) AS last_update FROM ev WHERE pts <= {29 * D} GROUP BY 1 HAVING {29 * D} - max(pts) <= {6 * H}")
def idle_eviction(s, d):
    return stats.active(_frames(s, d), ["user_id"], "pts", 29 * D, idle=6 * H)


@query(f"WITH {EV} SELECT input_id, count(*) AS n, count(*) FILTER (payload > 250) AS large, count(*) FILTER (frame_id % 97 = 0) AS lost FROM ev GROUP BY 1")
def lifetime_counters(s, d):
    return stats.counters(_frames(s, d), ["input_id"], {"large": F.col("payload") > 250, "lost": F.col("frame_id") % 97 == 0})


@query(f"WITH {EV}, p AS (SELECT input_id, pts + {H // 6} AS gap_start, lead(pts) OVER (PARTITION BY input_id ORDER BY pts) AS gap_end FROM ev) SELECT * FROM p WHERE gap_end - gap_start >= 50000")
def gaps(s, d):
    f = _daily(_frames(s, d)).withColumn("start_pts", F.col("pts")).withColumn("end_pts", F.col("pts") + H // 6)
    return sessions.gaps(f, ["input_id"], "day")


@query(
    f"WITH {EV}, j AS (SELECT *, CASE WHEN abs(pts - lag(pts) OVER w) > {12 * H} THEN 1 ELSE 0 END AS jump FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pts, frame_id)), "
    "e AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY pts, frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM j) "
    "SELECT frame_id, user_id, epoch, pts - min(pts) OVER (PARTITION BY user_id, epoch) AS epoch_pts FROM e"
)
def discontinuity_sessions(s, d):
    return align.epochs(_daily(_frames(s, d)), ["user_id"], "day", 12 * H, order=["pts", "frame_id"]).select("frame_id", "user_id", "epoch", "epoch_pts")


NUMBERED = f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY pts, frame_id) - 1 AS ix, CASE WHEN frame_id % 97 = 0 THEN payload * 50 ELSE payload END AS v FROM ev)"
STEPS = NUMBERED + ", f AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY input_id ORDER BY ix)), 0) AS diff, max(abs(v)) OVER (PARTITION BY input_id) AS peak FROM r), m AS (SELECT *, avg(diff) OVER (PARTITION BY input_id ORDER BY ix ROWS BETWEEN 64 PRECEDING AND 64 FOLLOWING) AS local_mean FROM f)"


def _numbered(s, d) -> DataFrame:
    f = _daily(_frames(s, d))
    f = ordered.with_running_sum(f, ["input_id"], "day", ["pts", "frame_id"], {"n": F.lit(1)})
    v = F.when(F.col("frame_id") % 97 == 0, F.col("payload") * 50).otherwise(F.col("payload"))
    return f.withColumn("ix", F.col("n") - 1).withColumn("v", v).withColumn("block", F.floor(F.col("ix") / 512).cast("long"))


@query(STEPS + " SELECT frame_id, ix, round(diff, 6) AS diff, round(local_mean, 9) AS local_mean, diff > 0.05 * peak AND diff > 7 * greatest(local_mean, 1.0) AS flag FROM m")
def first_difference_flags(s, d):
    out = sessions.step_flags(_numbered(s, d), ["input_id"], "block", "ix", "v", bucket_rows=512)
    return out.select("frame_id", "ix", F.round("diff", 6).alias("diff"), F.round("local_mean", 9).alias("local_mean"), "flag")


@query(
    NUMBERED + ", h AS (SELECT *, CASE WHEN ix - lag(ix) OVER w - 1 >= 8 THEN 1 ELSE 0 END AS new FROM r WHERE v > 400 WINDOW w AS (PARTITION BY input_id ORDER BY ix)), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY input_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS run FROM h) SELECT input_id, min(ix) AS start_ix, max(ix) + 1 AS end_ix, count(*) AS n FROM g GROUP BY input_id, run"
)
def flag_intervals(s, d):
    return sessions.flag_intervals(_numbered(s, d), ["input_id"], "block", "ix", F.col("v") > 400, merge=8)


SPANS = f"WITH {EV}, sp AS (SELECT input_id, pts AS s, pts + (frame_id % 7) * {H // 4} AS e, frame_id FROM ev)"
MERGED = SPANS + (
    ", t AS (SELECT *, max(e) OVER (PARTITION BY input_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM sp), "
    "u AS (SELECT *, sum(CASE WHEN s > top THEN 1 ELSE 0 END) OVER (PARTITION BY input_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM t), "
    "g AS (SELECT input_id, min(s) AS s, max(e) AS e FROM u GROUP BY input_id, run)"
)


def _spans(s, d) -> DataFrame:
    return _daily(_frames(s, d)).select("input_id", "frame_id", "day", F.col("pts").alias("start"), (F.col("pts") + (F.col("frame_id") % 7) * (H // 4)).alias("end"))


@query(MERGED + ' SELECT input_id, s AS "start", e AS "end" FROM g')
def merged_intervals(s, d):
    return sessions.merged_intervals(_spans(s, d), ["input_id"], "day")


@query(MERGED + f" SELECT sp.input_id, sp.frame_id FROM sp WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.input_id = sp.input_id AND g.e - g.s > {2 * H} AND g.s - {H // 60} <= sp.s AND g.e + {H // 60} >= sp.e)")
def uncovered_intervals(s, d):
    spans = _spans(s, d)
    cover = sessions.merged_intervals(spans, ["input_id"], "day").where(F.col("end") - F.col("start") > 2 * H)
    return sessions.uncovered(spans.drop("day"), cover, ["input_id"], H // 60, 6 * H).select("input_id", "frame_id")


PACKETS = f"WITH {EV}, p AS (SELECT frame_id, frame_id + CASE WHEN frame_id % 50 = 0 THEN 3 ELSE 0 END AS arrival, (frame_id + 60000) % 65536 AS seq, (pts // 1000) % 4294967296 AS rtp_ts, pts, payload FROM ev WHERE frame_id % 97 <> 0)"
UNWRAPPED = PACKETS + (
    ", a AS (SELECT *, lag(seq) OVER w AS ps, lag(rtp_ts) OVER w AS pt FROM p WINDOW w AS (ORDER BY arrival, frame_id)), "
    "b AS (SELECT *, CASE WHEN abs(ps - seq) >= 32767 THEN CASE WHEN ps > seq THEN 1 ELSE -1 END ELSE 0 END AS ds, CASE WHEN abs(pt - rtp_ts) >= 2147483647 THEN CASE WHEN pt > rtp_ts THEN 1 ELSE -1 END ELSE 0 END AS dt FROM a), "
    "c AS (SELECT *, sum(ds) OVER w AS ss, 1 + sum(dt) OVER w AS st FROM b WINDOW w AS (ORDER BY arrival, frame_id ROWS UNBOUNDED PRECEDING)), "
    "n AS (SELECT *, CAST(ss - least(0, min(ss) OVER w) AS BIGINT) * 65536 + seq AS number, CAST(st - least(0, min(st) OVER w) AS BIGINT) * 4294967296 + rtp_ts AS full_ts FROM c WINDOW w AS (ORDER BY arrival, frame_id ROWS UNBOUNDED PRECEDING))"
)


def _packets(s, d) -> DataFrame:
    p = tables.packets(s, d).withColumn("block", F.floor(F.col("arrival") / 2000).cast("long"))
    return sequence.unwrap(p, ["track"], "block", ["arrival", "frame_id"], {"number": ("seq", 16, 0), "full_ts": ("rtp_ts", 32, 1)})


@query(UNWRAPPED + " SELECT frame_id, number, full_ts FROM n")
def seq_unwrap(s, d):
    return _packets(s, d).select("frame_id", "number", "full_ts")


@query(f"WITH {EV}, g AS (SELECT *, CAST(sum(CASE WHEN frame_id % 30 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY frame_id) AS BIGINT) AS grp FROM ev) SELECT frame_id, grp AS \"group\", row_number() OVER (PARTITION BY grp ORDER BY (frame_id * 7) % 30, frame_id) AS display_ix FROM g")
def picture_order(s, d):
    f = _frames(s, d).withColumn("track", F.lit("t")).withColumn("is_idr", F.col("frame_id") % 30 == 0).withColumn("poc", (F.col("frame_id") * 7) % 30)
    f = f.withColumn("block", F.floor(F.col("frame_id") / 3000).cast("long"))
    return sequence.picture_order(f, ["track"], "block", ["frame_id"]).select("frame_id", "group", "display_ix")


@query(f"WITH {EV}, g AS (SELECT *, CAST(coalesce(sum(CASE WHEN frame_id % 11 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS unit FROM ev) SELECT unit, count(*) AS n, string_agg(left(input_id, 2), '' ORDER BY frame_id) AS payload FROM g GROUP BY 1")
def payload_units(s, d):
    f = _frames(s, d).select(F.lit("t").alias("track"), "frame_id", F.substring("input_id", 1, 2).alias("payload"), (F.col("frame_id") % 11 == 0).alias("marker"), F.floor(F.col("frame_id") / 3000).cast("long").alias("block"))
    return sequence.payload_groups(f, ["track"], "block", ["frame_id"]).select("unit", "n", "payload")


@query(f"WITH {EV} SELECT pts, CAST(dense_rank() OVER (ORDER BY input_id) - 1 AS INTEGER) AS stream, frame_id FROM ev")
def k_way_merge(s, d):
    return align.merge_inputs(_frames(s, d)).select("pts", "stream", "frame_id")


@query(
    f"WITH {EV}, p AS (SELECT input_id, pts AS a, pts + {H} AS b FROM ev WHERE frame_id % 400 = 0), q AS (SELECT input_id, a, least(b, coalesce(lead(a) OVER (PARTITION BY input_id ORDER BY a), b)) AS b FROM p), {SLOTS}, inputs AS (SELECT DISTINCT input_id FROM ev) "
    "SELECT i.input_id, s.slot_pts, coalesce(bool_or(q.a <= s.slot_pts AND s.slot_pts < q.b), false) AS paused, s.slot_pts - CAST(coalesce(sum(greatest(0, least(s.slot_pts, q.b) - q.a)), 0) AS BIGINT) AS played FROM slots s CROSS JOIN inputs i LEFT JOIN q ON q.input_id = i.input_id AND q.a <= s.slot_pts GROUP BY 1, 2"
)
def pause_clock(s, d):
    from pyspark.sql import Window

    f = _frames(s, d)
    p = f.where("frame_id % 400 = 0").select("input_id", F.col("pts").alias("start_pts"), (F.col("pts") + H).alias("end_pts"))
    nxt = F.lead("start_pts").over(Window.partitionBy("input_id").orderBy("start_pts"))
    p = p.withColumn("end_pts", F.least("end_pts", F.coalesce(nxt, "end_pts")))
    return align.with_pauses(_slots(s, d).select("slot_pts").crossJoin(f.select("input_id").distinct()), p)


@query(f"WITH {EV} SELECT frame_id, t AS track_id, pts + t * {30 * D} AS pts FROM ev, (VALUES (0), (1), (2)) v(t)")
def looped(s, d):
    return align.looped(_frames(s, d), 3, 30 * D).select("frame_id", "track_id", "pts")


@query(
    f"WITH {EV}, t AS (SELECT input_id, min(frame_id) AS target FROM ev WHERE pts >= {10 * D} GROUP BY 1), k AS (SELECT e.input_id, target, max(frame_id) AS start FROM ev e JOIN t USING (input_id) WHERE frame_id % 12 = 0 AND frame_id <= target GROUP BY 1, 2) "
    "SELECT e.input_id AS track, frame_id AS ix, frame_id >= target AS present FROM ev e JOIN k USING (input_id) WHERE frame_id >= start"
)
def seek_decode(s, d):
    f = _frames(s, d).select(F.col("input_id").alias("track"), F.col("frame_id").alias("ix"), "pts", (F.col("frame_id") % 12 == 0).alias("is_key"))
    return align.seek(f, 10 * D).select("track", "ix", "present")


@query("""WITH e AS (SELECT n_regionkey AS track, n_nationkey AS ix, n_nationkey * 100 AS duration, CASE WHEN n_nationkey % 3 = 2 THEN n_nationkey ELSE -1 END AS media_time FROM {GROUPS}),
    m AS (SELECT track, min(ix) AS first, arg_min(media_time, ix) AS trim FROM e WHERE media_time >= 0 GROUP BY 1)
    SELECT CAST(t.track AS BIGINT) AS track, CAST(coalesce(sum(e.duration) FILTER (e.media_time < 0 AND (m.first IS NULL OR e.ix < m.first)), 0) AS BIGINT) AS delay, CAST(coalesce(max(m.trim), 0) AS BIGINT) AS trim
    FROM (SELECT DISTINCT track FROM e) t JOIN e ON e.track = t.track LEFT JOIN m ON m.track = t.track GROUP BY 1""")
def edit_list(s, d):
    n = _groups(s, d)
    e = n.select(F.col("n_regionkey").cast("long").alias("track"), F.col("n_nationkey").cast("long").alias("ix"), (F.col("n_nationkey") * 100).cast("long").alias("duration"), F.when(F.col("n_nationkey") % 3 == 2, F.col("n_nationkey")).otherwise(-1).cast("long").alias("media_time"))
    return align.edit_list(e)


@query(f"WITH {EV}, o AS (SELECT input_id, max(pts) AS pts FROM ev WHERE pts < {15 * D} GROUP BY 1) SELECT frame_id, input_id FROM ev WHERE pts >= {15 * D} UNION ALL SELECT frame_id, input_id FROM ev JOIN o USING (input_id, pts)")
def start_trim(s, d):
    return align.trimmed(_frames(s, d), 15 * D).select("frame_id", "input_id")


TRACK_LENGTHS = f"WITH {EV}, l AS (SELECT user_id AS input_id, input_id AS track_id, max(pts) - min(pts) AS length FROM ev GROUP BY 1, 2), "
STARTS = "SELECT input_id, track_id, CAST(coalesce(sum(length) OVER (PARTITION BY input_id ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pts, length FROM "


def _track_lengths(s, d) -> DataFrame:
    return _frames(s, d).groupBy(F.col("user_id").alias("input_id"), F.col("input_id").alias("track_id")).agg((F.max("pts") - F.min("pts")).alias("length"))


@query(f"{TRACK_LENGTHS} s AS ({STARTS} l) SELECT input_id, track_id, start_pts, coalesce(lag(start_pts, 2) OVER (PARTITION BY input_id ORDER BY track_id), 0) AS queued_at FROM s")
def track_switching(s, d):
    return align.track_starts(_track_lengths(s, d), pending=2).select("input_id", "track_id", "start_pts", "queued_at")


@query(
    f"{TRACK_LENGTHS} s AS ({STARTS} l), a AS (SELECT DISTINCT user_id AS input_id, {20 * D} + user_id * {H} AS abort_pts FROM ev WHERE user_id % 3 = 0), "
    "c AS (SELECT input_id, track_id, min(abort_pts - start_pts) AS played FROM s JOIN a USING (input_id) WHERE abort_pts >= start_pts AND abort_pts < start_pts + length GROUP BY 1, 2), "
    f"n AS (SELECT l.input_id, l.track_id, least(length, coalesce(played, length)) AS length FROM l LEFT JOIN c USING (input_id, track_id)) {STARTS} n"
)
def track_aborts(s, d):
    aborts = _frames(s, d).select(F.col("user_id").alias("input_id")).distinct().where("input_id % 3 = 0").withColumn("abort_pts", F.lit(20 * D) + F.col("input_id") * H)
    return align.aborted(align.track_starts(_track_lengths(s, d)), aborts).select("input_id", "track_id", "start_pts", "length")


@query(
    f"WITH {EV}, k AS (SELECT *, pts + (user_id % 5) * {clock.NS} AS arrival, frame_id % 4 = 0 AS is_key FROM ev), l AS (SELECT *, lag(pts) OVER w AS pp, lag(pts - arrival) OVER w AS po FROM k WINDOW w AS (PARTITION BY input_id ORDER BY arrival, frame_id)) "
    f"SELECT frame_id, CAST(sum(CASE WHEN is_key AND (pts < pp OR (pts - pp >= {100 * clock.MS} AND abs(pts - arrival - po) > {2 * clock.NS})) THEN 1 ELSE 0 END) OVER (PARTITION BY input_id ORDER BY arrival, frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM l"
)
def key_frame_epochs(s, d):
    f = _frames(s, d).withColumn("arrival_pts", F.col("pts") + (F.col("user_id") % 5) * clock.NS).withColumn("is_key", F.col("frame_id") % 4 == 0)
    return align.key_epochs(_daily(f, "arrival_pts"), ["input_id"], "day", ["arrival_pts", "frame_id"]).select("frame_id", "epoch")


@query(
    f"WITH {EV}, f AS (SELECT user_id AS source, input_id AS track, min_by(pts, pts + (user_id % 3) * {clock.NS}) AS pts, min(pts + (user_id % 3) * {clock.NS}) AS arrival FROM ev GROUP BY 1, 2), w AS (SELECT *, max(pts - arrival) OVER (PARTITION BY source) - min(pts - arrival) OVER (PARTITION BY source) <= {2 * clock.NS} AS near FROM f) "
    "SELECT source, track, CASE WHEN near THEN first_value(pts) OVER (PARTITION BY source ORDER BY arrival, pts) ELSE pts END AS anchor FROM w"
)
def shared_anchor(s, d):
    f = _frames(s, d).select(F.col("user_id").alias("source"), F.col("input_id").alias("track"), "pts", (F.col("pts") + (F.col("user_id") % 3) * clock.NS).alias("arrival_pts"))
    return align.shared_anchor(f)


@query(
    f"WITH {EV}, o AS (SELECT input_id AS output_id, min(pts) AS first FROM ev GROUP BY 1) SELECT frame_id, pts - first AS out_pts FROM ev JOIN o ON o.output_id = ev.input_id"
)
def output_anchor(s, d):
    return lifecycle.anchored(_frames(s, d), ["input_id"]).select("frame_id", "out_pts")


@query(
    f"WITH {EV}, l AS (SELECT *, CASE WHEN pts - lag(pts) OVER w >= {2 * H} THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pts, frame_id)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY pts, frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM l) "
    'SELECT user_id, burst, min(pts) AS "start", max(pts) AS "end", count(*) AS n, arg_max(input_id, pts) AS input_id FROM b GROUP BY 1, 2'
)
def debounce(s, d):
    return sessions.debounced(_daily(_frames(s, d)), ["user_id"], "day", "pts", 2 * H, ["input_id"], "frame_id")


@query(
    f"WITH {EV}, l AS (SELECT user_id % 10 AS grp, user_id, arg_max(CASE frame_id % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'connected' ELSE 'waiting' END, pts) AS st FROM ev GROUP BY 1, 2) SELECT grp AS room, count(*) AS sessions, count(*) FILTER (st = 'connected') AS connected FROM l WHERE st <> 'closed' GROUP BY 1"
)
def connected_peers(s, d):
    st = F.when(F.col("frame_id") % 3 == 0, "closed").when(F.col("frame_id") % 3 == 1, "connected").otherwise("waiting")
    return stats.connected(_frames(s, d).withColumn("room", F.col("user_id") % 10).withColumn("state", st), "room", "user_id", "pts", "state")


@query(f"WITH {EV}, u AS (SELECT DISTINCT input_id, pts FROM ev) SELECT input_id, round(CASE WHEN count(*) > 1 THEN (count(*) - 1) / ((max(pts) - min(pts)) / 1e9) ELSE 0 END, 9) AS frame_rate FROM u GROUP BY 1")
def average_frame_rate(s, d):
    return stats.frame_rate(_frames(s, d), ["input_id"], "pts").withColumn("frame_rate", F.round("frame_rate", 9))


ARRIVED = (
    f"WITH {EV}, a AS (SELECT frame_id, input_id, pts, pts + (frame_id * 7919 % 41) * {H} AS arrival FROM ev), c AS (SELECT input_id, max(arrival) + {H} AS closed_at FROM a GROUP BY 1 HAVING min(frame_id) % 2 = 1), "
    f"r AS (SELECT slot_pts, i.input_id, least(min(arrival), any_value(closed_at)) AS ready FROM (SELECT range * {D} AS slot_pts FROM range((SELECT max(pts) // {D} + 4 FROM ev))) s CROSS JOIN (SELECT DISTINCT input_id FROM ev) i "
    "LEFT JOIN a ON a.input_id = i.input_id AND a.pts > slot_pts LEFT JOIN c ON c.input_id = i.input_id GROUP BY 1, 2)"
)


def _arrivals(s, d) -> DataFrame:
    return _frames(s, d).withColumn("arrival_pts", F.col("pts") + (F.col("frame_id") * 7919 % 41) * H)


def _ready(s, d) -> DataFrame:
    rows = _arrivals(s, d)
    closed = rows.groupBy("input_id").agg((F.max("arrival_pts") + H).alias("closed_at"), F.min("frame_id").alias("first")).where("first % 2 = 1").drop("first")
    return align.ready_at(_slots(s, d, D, 3), rows, closed)


@query(f"{ARRIVED} SELECT * FROM r")
def slot_readiness(s, d):
    return _ready(s, d)


@query(
    f"WITH {EV}, b AS (SELECT input_id, pts // 1000000 + {15 * clock.MS} AS end_pts, pts // 1000000 + (frame_id * 7919 % 41) * {clock.MS} AS arrival FROM ev), c AS (SELECT input_id, max(arrival) + {100 * clock.MS} AS closed_at FROM b GROUP BY 1 HAVING length(input_id) % 2 = 0) "
    f"SELECT slot_pts, i.input_id, least(min(arrival), any_value(closed_at)) AS ready FROM (SELECT range * {clock.CHUNK} AS slot_pts FROM range((SELECT max(end_pts) // {clock.CHUNK} + 3 FROM b))) s CROSS JOIN (SELECT DISTINCT input_id FROM ev) i "
    f"LEFT JOIN b ON b.input_id = i.input_id AND b.end_pts >= slot_pts + {clock.CHUNK + clock.STRETCH} LEFT JOIN c ON c.input_id = i.input_id GROUP BY 1, 2"
)
def chunk_readiness(s, d):
    f = _frames(s, d).withColumn("start", F.floor(F.col("pts") / 1_000_000).cast("long"))
    b = f.select("input_id", (F.col("start") + 15 * clock.MS).alias("end_pts"), (F.col("start") + (F.col("frame_id") * 7919 % 41) * clock.MS).alias("arrival_pts"))
    closed = b.groupBy("input_id").agg((F.max("arrival_pts") + 100 * clock.MS).alias("closed_at")).where("length(input_id) % 2 = 0")
    last = b.agg(F.max("end_pts")).first()[0] or 0
    return align.chunk_ready_at(clock.period_grid(s, 0, (last // clock.CHUNK + 3) * clock.CHUNK, clock.CHUNK), b, closed, bucket_ns=clock.NS)


SENT = (
    f"{ARRIVED}, b AS (SELECT slot_pts, max(ready) AS last, coalesce(max(ready) FILTER (input_id IN ('click', 'view')), 0) AS must, count(*) FILTER (ready IS NULL) AS open, count(*) FILTER (ready IS NULL AND input_id IN ('click', 'view')) AS must_open FROM r GROUP BY 1), "
    "o AS (SELECT *, CASE WHEN must_open = 0 THEN greatest(slot_pts, must, CASE WHEN open = 0 THEN least(last, greatest(slot_pts, must)) ELSE slot_pts END) END AS own FROM b), "
    "t AS (SELECT *, CASE WHEN count(*) FILTER (own IS NULL) OVER w = 0 THEN max(own) OVER w END AS sent_at FROM o WINDOW w AS (ORDER BY slot_pts ROWS UNBOUNDED PRECEDING)) "
)


@query(f"{SENT} SELECT slot_pts, sent_at, coalesce(open = 0 AND last <= sent_at, false) AS complete FROM t")
def slot_emission(s, d):
    return align.emitted(_slots(s, d, D, 3), _ready(s, d), ["click", "view"])


@query(f"{SENT}, d AS (SELECT slot_pts, sent_at, slot_pts + (slot_pts // {D} * 7 % 5) * {12 * H} AS accept_at, slot_pts // {D} % 3 = 0 AS required FROM t WHERE sent_at IS NOT NULL) SELECT slot_pts, CASE WHEN required OR accept_at <= greatest(slot_pts, sent_at) THEN greatest(sent_at, accept_at) END AS delivered_at FROM d")
def output_drop(s, d):
    day = F.floor(F.col("slot_pts") / D).cast("long")
    sent = align.emitted(_slots(s, d, D, 3), _ready(s, d), ["click", "view"]).where("sent_at is not null")
    return align.delivered(sent.withColumn("accept_at", F.col("slot_pts") + (day * 7 % 5) * (12 * H)).withColumn("required", day % 3 == 0)).select("slot_pts", "delivered_at")


@query(f"SELECT range AS id, range * 33333333 AS pts, 'video' AS kind, 0 AS rank FROM range(600) UNION ALL SELECT range, range * 20000000, 'audio', 1 FROM range(1000) UNION ALL SELECT event_id, event_id % 500 * 40000000, 'event', 2 FROM events")
def interleave(s, d):
    slots = s.range(600).select("id", (F.col("id") * 33_333_333).alias("pts"))
    chunks = s.range(1000).select("id", (F.col("id") * clock.CHUNK).alias("pts"))
    events = tables.table(s, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 500 * 40_000_000).alias("pts"))
    return align.interleaved(slots, chunks, events)
