"""Queries over what buffers do with packets and frames, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import clock
from ..operators import align, folds, jitter, ordered, sequence
from .timing import EV, SLOTS, D, H, _daily, _frames, _slots, query

MS, S = clock.MS, clock.NS

#: Sixteen tracks of numbered packets: some lost, some late, some much too late.
TRACKS = (
    f"{EV}, ix AS (SELECT *, user_id % 16 AS track, row_number() OVER (PARTITION BY user_id % 16 ORDER BY pts, frame_id) - 1 AS ix FROM ev), "
    "p AS (SELECT track, frame_id, pts, ix, (ix + 65000) % 65536 AS seq, 10 * ix + CASE WHEN frame_id % 50 = 0 THEN 35 ELSE 0 END + CASE WHEN frame_id % 83 = 0 THEN 405 ELSE 0 END AS arrival FROM ix WHERE frame_id % 97 <> 0), "
    "pa AS (SELECT *, lag(seq) OVER w AS ps FROM p WINDOW w AS (PARTITION BY track ORDER BY arrival, frame_id)), "
    "pb AS (SELECT *, sum(CASE WHEN abs(ps - seq) >= 32767 THEN CASE WHEN ps > seq THEN 1 ELSE -1 END ELSE 0 END) OVER (PARTITION BY track ORDER BY arrival, frame_id ROWS UNBOUNDED PRECEDING) AS t FROM pa), "
    "q AS (SELECT *, CAST(t - least(0, min(t) OVER (PARTITION BY track ORDER BY arrival, frame_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) * 65536 + seq AS number, row_number() OVER (PARTITION BY track ORDER BY arrival, frame_id) AS i FROM pb)"
)
#: One step writes a packet, or sends one out, or reports one loss.
BUFFER = f"""WITH RECURSIVE {TRACKS},
r(track, i, expected, buf, nth, event, number, frame_id, seen_at) AS (
    SELECT DISTINCT track, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS STRUCT(number BIGINT, pts BIGINT, id BIGINT)[]), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM q
    UNION ALL
    SELECT track, CASE WHEN reads THEN i ELSE i + 1 END, CASE WHEN lost THEN expected + 1 WHEN reads THEN head.number + 1 ELSE expected END,
        CASE WHEN lost OR late THEN buf WHEN reads THEN buf[2:] ELSE list_sort(list_append(buf, struct_pack(number := qn, pts := qp, id := qid))) END,
        nth + CASE WHEN reads OR late THEN 1 ELSE 0 END, CASE WHEN lost THEN 'lost' WHEN reads THEN 'packet' WHEN late THEN 'late' END,
        CASE WHEN lost THEN expected WHEN reads THEN head.number WHEN late THEN qn END, CASE WHEN lost THEN NULL WHEN reads THEN head.id WHEN late THEN qid END, CASE WHEN reads THEN seen_at ELSE qa END
    FROM (SELECT *, reads AND coalesce(head.number <> expected, false) AS lost, NOT reads AND coalesce(qn < expected, false) AS late FROM (
        SELECT r.track, r.i, expected, buf, nth, seen_at, buf[1] AS head, q.number AS qn, q.pts AS qp, q.frame_id AS qid, q.arrival AS qa,
            len(buf) > 0 AND (coalesce(buf[1].number = expected, false) OR q.i IS NULL OR list_max(list_transform(buf, lambda x: x.pts)) - list_min(list_transform(buf, lambda x: x.pts)) >= {6 * H}) AS reads
        FROM r LEFT JOIN q ON q.track = r.track AND q.i = r.i + 1 WHERE q.i IS NOT NULL OR len(buf) > 0))
), e AS (SELECT track, nth - 1 AS nth, event, number, frame_id, seen_at FROM r WHERE event IS NOT NULL)"""


def _tracks(s, d) -> DataFrame:
    f = _daily(_frames(s, d)).withColumn("track", F.col("user_id") % 16)
    f = ordered.with_running_sum(f, ["track"], "day", ["pts", "frame_id"], {"n": F.lit(1)}).withColumn("ix", F.col("n") - 1).where("frame_id % 97 <> 0")
    late = F.when(F.col("frame_id") % 50 == 0, 35).otherwise(0) + F.when(F.col("frame_id") % 83 == 0, 405).otherwise(0)
    return f.select("track", "frame_id", "pts", "ix", ((F.col("ix") + 65_000) % 65_536).alias("seq"), (F.col("ix") * 10 + late).alias("arrival"))


def _events(s, d) -> DataFrame:
    p = _tracks(s, d).withColumn("block", F.floor(F.col("arrival") / 20_000).cast("long"))
    return jitter.jitter(sequence.unwrap(p, ["track"], "block", ["arrival", "frame_id"], {"number": ("seq", 16, 0)}), ["track"], 6 * H)


@query(f"{BUFFER} SELECT track, nth, number, frame_id, event = 'late' AS late FROM e WHERE event <> 'lost'")
def reorder(s, d):
    return _events(s, d).where("event <> 'lost'").select("track", "nth", "number", "frame_id", (F.col("event") == "late").alias("late"))


@query(f"{BUFFER} SELECT track, number, seen_at FROM e WHERE event = 'lost'")
def loss_expand(s, d):
    return _events(s, d).where("event = 'lost'").select("track", "number", "seen_at")


@query(f"{BUFFER} SELECT frame_id, seen_at AS released_at FROM e WHERE event = 'packet'")
def window_release(s, d):
    return _events(s, d).where("event = 'packet'").select("frame_id", F.col("seen_at").alias("released_at"))


@query(
    f"WITH {EV}, a AS (SELECT frame_id, input_id, pts, pts + (frame_id * 31 % 7) * {H} AS arrival FROM ev), f AS (SELECT input_id, first(pts ORDER BY arrival, pts) AS first, max(arrival) AS last FROM a GROUP BY 1), "
    f"g AS (SELECT input_id, min(arrival) AS ready FROM a JOIN f USING (input_id) WHERE abs(pts + {H} - first) > {2 * D} GROUP BY 1) SELECT frame_id, greatest(arrival, coalesce(ready, last)) AS released_at FROM a JOIN f USING (input_id) LEFT JOIN g USING (input_id)"
)
def initial_delay(s, d):
    f = _frames(s, d).select("frame_id", "input_id", F.col("pts").alias("start_pts"), (F.col("pts") + H).alias("end_pts"), (F.col("pts") + (F.col("frame_id") * 31 % 7) * H).alias("arrival"))
    return jitter.delayed(f, ["input_id"], 2 * D).select("frame_id", "released_at")


PAUSES = f"WITH {EV}, u AS (SELECT input_id, pts AS a, pts + {5 * H} AS b FROM ev WHERE frame_id % 400 = 0), z AS (SELECT input_id, a, least(b, coalesce(lead(a) OVER (PARTITION BY input_id ORDER BY a), b)) AS b FROM u)"


def _pauses(s, d) -> DataFrame:
    from pyspark.sql import Window

    p = _frames(s, d).where("frame_id % 400 = 0").select("input_id", F.col("pts").alias("start_pts"), (F.col("pts") + 5 * H).alias("end_pts"))
    return p.withColumn("end_pts", F.least("end_pts", F.coalesce(F.lead("start_pts").over(Window.partitionBy("input_id").orderBy("start_pts")), "end_pts")))


@query(
    f"{PAUSES}, {SLOTS}, i AS (SELECT DISTINCT input_id FROM ev), l AS (SELECT i.input_id, slot_pts, coalesce(slot_pts < z.b, false) AS paused, CASE WHEN slot_pts < z.b THEN z.a ELSE slot_pts END AS look FROM slots CROSS JOIN i ASOF LEFT JOIN z ON z.input_id = i.input_id AND slot_pts >= z.a) "
    "SELECT l.input_id, slot_pts, paused, ev.frame_id, ev.pts + slot_pts - look AS pts FROM l ASOF LEFT JOIN ev ON ev.input_id = l.input_id AND look >= ev.pts"
)
def pause_freeze(s, d):
    f = _frames(s, d)
    return align.frozen(_slots(s, d).select("slot_pts").crossJoin(f.select("input_id").distinct()), f, _pauses(s, d))


@query(f"{PAUSES} SELECT frame_id, ev.input_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.input_id = ev.input_id AND z.a <= pts // {H} * {H} AND pts // {H} * {H} < z.b)")
def pause_silence(s, d):
    batches = _frames(s, d).withColumn("chunk_pts", F.floor(F.col("pts") / H).cast("long") * H)
    return align.silenced(batches, _pauses(s, d)).select("frame_id", "input_id")


@query(
    f"WITH {EV}, p AS (SELECT frame_id, user_id, pts, frame_id % 4 = 0 AS is_key FROM ev WHERE frame_id % 89 <> 0), j AS (SELECT *, CASE WHEN abs(pts - lag(pts) OVER (PARTITION BY user_id ORDER BY frame_id)) > {12 * H} THEN 1 ELSE 0 END AS jump FROM p), "
    "e AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM j), k AS (SELECT user_id, epoch, min(frame_id) AS first, arg_min(pts, frame_id) AS zero FROM e WHERE is_key GROUP BY 1, 2) "
    "SELECT e.frame_id, e.user_id, e.epoch, greatest(0, e.pts - zero) AS epoch_pts FROM e JOIN k USING (user_id, epoch) WHERE e.frame_id >= first"
)
def key_restart(s, d):
    f = _daily(_frames(s, d)).withColumn("is_key", F.col("frame_id") % 4 == 0).withColumn("is_corrupt", F.col("frame_id") % 89 == 0)
    return align.restarted(f, ["user_id"], "day", 12 * H, ["frame_id"]).select("frame_id", "user_id", "epoch", "epoch_pts")


@query(
    f"WITH {EV}, a AS (SELECT input_id, frame_id, pts, pts + ((frame_id * 37) % 11) * {MS} AS arrival FROM ev), o AS (SELECT *, pts - arrival AS off, max(pts - arrival) OVER (PARTITION BY input_id ORDER BY arrival, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY input_id ORDER BY arrival, frame_id) AS n FROM a), "
    f"u AS (SELECT *, sum(CASE WHEN top IS NULL OR off > top + {5 * MS} THEN 1 ELSE 0 END) OVER (PARTITION BY input_id ORDER BY n) AS run FROM o), f AS (SELECT input_id, run, min(n) AS first FROM u GROUP BY 1, 2), "
    f"l AS (SELECT input_id, min(arrival) AS settled FROM u JOIN f USING (input_id, run) WHERE n - first >= 3 GROUP BY 1), b AS (SELECT input_id, min(arrival) + {2 * D} AS most FROM a GROUP BY 1) SELECT input_id, least(coalesce(settled, most), most) AS lock_arrival FROM b LEFT JOIN l USING (input_id)"
)
def offset_lock(s, d):
    f = _frames(s, d).withColumn("arrival_pts", F.col("pts") + (F.col("frame_id") * 37 % 11) * MS)
    return align.offset_lock(_daily(f, "arrival_pts"), ["input_id"], "day", ["arrival_pts", "frame_id"], limit=2 * D)


#: Half a second of media between packets; bursts come late, early, or with a spike.
PACED = f"{EV}, ix AS (SELECT *, user_id % 16 AS track, row_number() OVER (PARTITION BY user_id % 16 ORDER BY pts, frame_id) AS i FROM ev), k AS (SELECT track, i, frame_id, i * {S // 2} AS pts, {10 * S} + i * {S // 2} + (frame_id % 5) * {50 * MS} + CASE (i // 60) % 3 WHEN 1 THEN {700 * MS} WHEN 2 THEN -{3 * S} ELSE 0 END + CASE WHEN frame_id % 37 = 0 THEN {1500 * MS} ELSE 0 END - {10 * S} AS arrival FROM ix)"


def _paced(s, d) -> DataFrame:
    f = _daily(_frames(s, d)).withColumn("track", F.col("user_id") % 16)
    f = ordered.with_running_sum(f, ["track"], "day", ["pts", "frame_id"], {"i": F.lit(1)}).withColumn("pts", F.col("i") * (S // 2))
    phase = F.floor(F.col("i") / 60) % 3
    off = (F.col("frame_id") % 5) * (50 * MS) + F.when(phase == 1, 700 * MS).when(phase == 2, -3 * S).otherwise(0) + F.when(F.col("frame_id") % 37 == 0, 1500 * MS).otherwise(0)
    return f.select("track", F.col("i").cast("long").alias("i"), "frame_id", F.col("pts").cast("long").alias("pts"), (F.col("pts") + off).cast("long").alias("arrival"))


@query(
    f"""WITH RECURSIVE {PACED}, c AS (SELECT *, ((i // 40) % 7) * {60 * MS} AS goal FROM k),
r(track, i, frame_id, size, top, out_pts) AS (SELECT track, i, frame_id, goal, pts, pts + goal FROM c WHERE i = 1
    UNION ALL SELECT track, i, frame_id, CASE WHEN abs(goal - size) > {200 * MS} THEN goal ELSE greatest(size - most, least(size + most, goal)) END, greatest(top, pts), pts + CASE WHEN abs(goal - size) > {200 * MS} THEN goal ELSE greatest(size - most, least(size + most, goal)) END
    FROM (SELECT c.*, r.size, r.top, CAST(floor(greatest(0, c.pts - r.top) * 0.04::DOUBLE * least(1.0, abs(goal - size) / {50 * MS}.0)) AS BIGINT) AS most FROM r JOIN c ON c.track = r.track AND c.i = r.i + 1))
SELECT frame_id, size, out_pts FROM r"""
)
def delay_convergence(s, d):
    p = _paced(s, d).withColumn("target", (F.floor(F.col("i") / 40) % 7).cast("long") * (60 * MS))
    return folds.converged(p, ["track"], ["i"]).select("frame_id", "size", "out_pts")


@query(
    f"""WITH RECURSIVE {PACED},
r(track, i, frame_id, target, top, jumped, z0, z1, z2, z3, s4, s5, jumps, bumps) AS (
    SELECT DISTINCT track, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST({500 * MS} AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM k
    UNION ALL
    SELECT track, i, frame_id, CASE WHEN jump THEN target + {S} WHEN step > 0 AND act <> 3 THEN CAST(floor(target * greatest(0.0::DOUBLE, 1 + [0.03, 0.03, 0.01, 0.0, -0.003, -0.01][act + 1]::DOUBLE * (step / {S}.0)) + 0.5) AS BIGINT) ELSE target END,
        greatest(coalesce(top, pts), pts), CASE WHEN jump THEN pts ELSE jumped END,
        CASE WHEN act = 0 OR step > 0 AND act <> 3 THEN NULL ELSE z0 END, CASE WHEN act = 0 OR step > 0 AND act <> 3 THEN NULL ELSE z1 END, CASE WHEN act = 0 OR step > 0 AND act <> 3 THEN NULL ELSE z2 END, z3, s4, s5,
        CASE WHEN len(kept) > 5 THEN [] ELSE kept END, bumps + CASE WHEN len(kept) > 5 AND bumps < 20 THEN 1 ELSE 0 END
    FROM (SELECT *, CASE WHEN jump THEN list_filter(list_append(jumps, pts), lambda x: x >= greatest(0, pts - {240 * S})) ELSE jumps END AS kept FROM (
        SELECT *, act = 0 AND greatest(0, pts - jumped) >= {4 * S} AS jump FROM (
        SELECT *, CASE WHEN pts - z0 < {5 * S} THEN 0 WHEN pts - z1 < {5 * S} THEN 1 WHEN pts - z2 < {5 * S} THEN 2 WHEN pts - z3 < {5 * S} THEN 3 WHEN pts - s5 >= {20 * S} THEN 5 WHEN pts - s4 >= {20 * S} THEN 4 ELSE 3 END AS act FROM (
        SELECT track, i, frame_id, pts, target, top, bumps, jumps, CASE WHEN top IS NULL THEN 0 ELSE greatest(0, pts - top) END AS step, coalesce(jumped, pts) AS jumped,
            CASE WHEN zone = 0 THEN greatest(pts, coalesce(z0, pts)) ELSE z0 END AS z0, CASE WHEN zone = 1 THEN greatest(pts, coalesce(z1, pts)) ELSE z1 END AS z1, CASE WHEN zone = 2 THEN greatest(pts, coalesce(z2, pts)) ELSE z2 END AS z2, CASE WHEN zone = 3 THEN greatest(pts, coalesce(z3, pts)) ELSE z3 END AS z3,
            CASE WHEN zone >= 4 THEN coalesce(s4, pts) END AS s4, CASE WHEN zone = 5 THEN coalesce(s5, pts) END AS s5 FROM (
        SELECT k.track, k.i, k.frame_id, k.pts, r.* EXCLUDE (track, i, frame_id), CASE WHEN m < {80 * MS} THEN 0 WHEN m < {120 * MS} + b THEN 1 WHEN m < {200 * MS} + b THEN 2 WHEN m < {500 * MS} + b THEN 3 WHEN m < {2500 * MS} + b THEN 4 ELSE 5 END AS zone
        FROM r JOIN k ON k.track = r.track AND k.i = r.i + 1, LATERAL (SELECT greatest(0, k.pts + r.target - k.arrival) AS m, r.bumps * {100 * MS} AS b)))))))
SELECT frame_id, target FROM r WHERE i > 0"""
)
def adaptive_latency(s, d):
    return jitter.adaptive(_paced(s, d), ["track"], ["i"], low=200 * MS, high=500 * MS).select("frame_id", "target")


@query(
    f"""WITH RECURSIVE {PACED}, f AS (SELECT track % 8 AS source, track // 8 AS track, frame_id, i * 45000 AS stamp, arrival / {S}.0::DOUBLE AS arrival, i FROM k), z AS (SELECT source, track, first(stamp ORDER BY arrival, stamp) AS stamp0, min(arrival) AS arrival0 FROM f GROUP BY 1, 2),
 rp AS (SELECT source, track, arrival, 1e6 + i * 0.5::DOUBLE * (1 + track * 0.001::DOUBLE) + (stamp0 - stamp) / 90000.0::DOUBLE AS sent, arrival0 FROM f JOIN z USING (source, track) WHERE i % 40 = 0 AND arrival > arrival0),
 an AS (SELECT source, first(sent - arrival0 ORDER BY arrival, track) AS anchor FROM rp GROUP BY 1), tg AS (SELECT source, track, arrival AS said, sent - anchor AS target FROM rp JOIN an USING (source)),
 p AS (SELECT f.source, f.track, f.frame_id, f.stamp, f.arrival, tg.said, tg.target, row_number() OVER (PARTITION BY f.source, f.track ORDER BY f.arrival, f.frame_id) AS n FROM f ASOF LEFT JOIN tg ON tg.source = f.source AND tg.track = f.track AND f.arrival > tg.said),
 r(source, track, n, frame_id, "first", top, arrival, offs, goal, seen, pts) AS (SELECT source, track, n, frame_id, stamp, stamp, arrival, arrival, CAST(NULL AS DOUBLE), said, greatest(0, arrival) FROM p WHERE n = 1
  UNION ALL SELECT source, track, n, frame_id, "first", greatest(top, stamp), arrival, off3, goal2, coalesce(said, seen), greatest(0, (stamp - "first") / 90000.0::DOUBLE + off3) FROM (
   SELECT *, CASE WHEN goal2 IS NULL THEN off2 ELSE greatest(off2 - ahead * 0.01::DOUBLE, least(off2 + ahead * 0.01::DOUBLE, goal2)) END AS off3 FROM (
   SELECT *, CASE WHEN skew > 10 THEN off1 + skew ELSE off1 END AS off2, CASE WHEN skew > 10 THEN off1 + skew ELSE goal1 END AS goal2 FROM (
   SELECT p.source, p.track, p.n, p.frame_id, r."first", r.top, p.stamp, p.arrival, p.said, r.seen, greatest(0, p.stamp - r.top) / 90000.0::DOUBLE AS ahead, CASE WHEN p.stamp > r.top THEN p.arrival - r.arrival - greatest(0, p.stamp - r.top) / 90000.0::DOUBLE ELSE 0 END AS skew,
    CASE WHEN p.said IS DISTINCT FROM r.seen AND p.said IS NOT NULL AND abs(p.target - r.offs) > 0.3 THEN p.target ELSE r.offs END AS off1, CASE WHEN p.said IS DISTINCT FROM r.seen AND p.said IS NOT NULL THEN p.target ELSE r.goal END AS goal1
   FROM r JOIN p ON p.source = r.source AND p.track = r.track AND p.n = r.n + 1))))
 SELECT source, track, frame_id, round(pts, 6) AS pts_secs FROM r"""
)
def clock_sync(s, d):
    """Times of packets by their sender's clock: two tracks a source, a report every fortieth packet, clocks that drift."""
    f = _paced(s, d).select((F.col("track") % 8).alias("source"), F.floor(F.col("track") / 8).cast("long").alias("track"), "frame_id", (F.col("i") * 45_000).alias("stamp"), (F.col("arrival") / F.lit(float(S))).alias("arrival"), "i")
    reports = f.where("i % 40 = 0").select("source", "track", "stamp", F.col("arrival"), (F.lit(1e6) + F.col("i") * 0.5 * (1 + F.col("track") * 0.001)).alias("ntp"))
    return jitter.synchronised(f.drop("i"), reports, resume=10.0).select("source", "track", "frame_id", F.round("pts_secs", 6).alias("pts_secs"))
