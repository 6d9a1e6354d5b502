"""Queries over sources, sinks, reports and small functions, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import clock
from ..functions import colors, media, text
from ..operators import lifecycle, mix, scene, sequence, stats
from ..sources import sinks, tables
from .timing import EV, D, H, _daily, _frames, _slots, query

S = clock.NS


@query(f"WITH {EV} SELECT frame_id, CAST((pts::HUGEINT * 180000 + {S}) // {2 * S} AS BIGINT) AS file_pts FROM ev")
def timebase(s, d):
    return _frames(s, d).select("frame_id", sinks.rescaled(F.col("pts"), 1, 90_000).alias("file_pts"))


@query(
    f"WITH {EV}, m AS (SELECT *, sum(1000 + frame_id % 7 * 100) OVER (PARTITION BY user_id ORDER BY frame_id) - (1000 + frame_id % 7 * 100) AS a FROM ev) "
    f"SELECT frame_id, CAST(round(a * 1e9 / 90000) AS BIGINT) AS dts, greatest(0, CAST(round((a + frame_id % 3 * 500) * 1e9 / 90000) AS BIGINT) + {50 * clock.MS} - {200 * clock.MS}) AS pts FROM m"
)
def media_times(s, d):
    e = F.col("frame_id")
    f = _daily(_frames(s, d)).select(F.col("user_id").alias("track"), e.alias("ix"), "day", (1000 + e % 7 * 100).alias("duration"), (e % 3 * 500).alias("rendering_offset"))
    return tables.media_samples(f, "day", 90_000, 50 * clock.MS, 200 * clock.MS).select(F.col("ix").alias("frame_id"), "dts", "pts")


@query(
    f"WITH RECURSIVE {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pts, frame_id) AS i, first(pts) OVER (PARTITION BY user_id ORDER BY pts, frame_id) % 300000 AS zero, (frame_id * 7919 % 31) * {S} AS buffered FROM ev), "
    f"r(user_id, i, frame_id, pts, anchor) AS (SELECT user_id, i, frame_id, pts % 300000 + i * {S}, greatest(0, (pts % 300000 + {S}) + CASE WHEN buffered > {24 * S} THEN 400000000 WHEN buffered < {6 * S} THEN -400000000 ELSE 0 END) FROM n WHERE i = 1 "
    f"UNION ALL SELECT n.user_id, n.i, n.frame_id, n.pts % 300000 + n.i * {S}, greatest(0, anchor + CASE WHEN buffered > {24 * S} THEN 400000000 WHEN buffered < {6 * S} THEN -400000000 ELSE 0 END) FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1) SELECT frame_id, greatest(0, pts - anchor) AS out_pts FROM r"
)
def live_nudge(s, d):
    from ..operators.ordered import with_running_sum

    f = with_running_sum(_daily(_frames(s, d)), ["user_id"], "day", ["pts", "frame_id"], {"i": F.lit(1)})
    f = f.select("user_id", "frame_id", "i", (F.col("pts") % 300_000 + F.col("i") * S).alias("pts"), ((F.col("frame_id") * 7919 % 31) * S).alias("buffered"), F.floor(F.col("i") / 50).cast("long").alias("block"))
    return tables.nudged(f, ["user_id"], "block", ["i"], step=400_000_000).select("frame_id", "out_pts")


@query(
    f"WITH {EV}, p AS (SELECT frame_id, user_id % 20 AS output_id, CASE WHEN user_id // 20 % 2 = 0 AND frame_id % 3 > 0 THEN 'audio' ELSE 'video' END AS track, pts + (frame_id * 31 % 5) * {H} AS pts FROM ev), t AS (SELECT DISTINCT output_id, unnest(CASE WHEN output_id % 4 = 0 THEN ['video'] ELSE ['video', 'audio'] END) AS track FROM p), "
    "f AS (SELECT output_id, track, min(frame_id) AS first FROM p GROUP BY 1, 2), m AS (SELECT output_id, max(first) AS met, count(*) FILTER (first IS NULL) AS open FROM t LEFT JOIN f USING (output_id, track) GROUP BY 1), "
    "l AS (SELECT *, min(pts) OVER (PARTITION BY output_id ORDER BY frame_id) AS low FROM p), w AS (SELECT output_id, min(frame_id) AS late FROM l WHERE pts - low > "
    f"{6 * H} GROUP BY 1), r AS (SELECT e.output_id, least(CASE WHEN open = 0 THEN met END, late, last) AS resolved_at FROM (SELECT output_id, max(frame_id) AS last FROM p GROUP BY 1) e LEFT JOIN m USING (output_id) LEFT JOIN w USING (output_id)), "
    "o AS (SELECT output_id, min(pts) AS zero FROM p JOIN r USING (output_id) WHERE frame_id <= resolved_at GROUP BY 1) SELECT frame_id, resolved_at, pts - zero AS out_pts FROM p JOIN r USING (output_id) JOIN o USING (output_id)"
)
def output_anchor_tracks(s, d):
    e, u = F.col("frame_id"), F.col("user_id")
    f = _daily(_frames(s, d)).select("day", "frame_id", (u % 20).alias("output_id"), F.when((F.floor(u / 20) % 2 == 0) & (e % 3 > 0), "audio").otherwise("video").alias("track"), (F.col("pts") + (e * 31 % 5) * H).alias("pts"), e.alias("arrival"))
    names = F.when(F.col("output_id") % 4 == 0, F.array(F.lit("video"))).otherwise(F.array(F.lit("video"), F.lit("audio")))
    tracks = f.select("output_id").distinct().select("output_id", F.explode(names).alias("track"), F.lit(None).cast("long").alias("ended_at"))
    return lifecycle.anchor_tracks(f, tracks, ["output_id"], "day", 6 * H).select("frame_id", "resolved_at", "out_pts")


@query(
    f"WITH RECURSIVE {EV}, z AS (SELECT input_id, min(pts) AS zero FROM ev GROUP BY 1), k AS (SELECT input_id, frame_id, pts, (pts - zero) // {2 * D} AS f, row_number() OVER (PARTITION BY input_id ORDER BY pts, frame_id) AS j FROM ev JOIN z USING (input_id) WHERE frame_id % 5 = 0), "
    "c(input_id, j, pts, frame_id, cuts) AS (SELECT input_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM z UNION ALL SELECT k.input_id, k.j, k.pts, k.frame_id, cuts + CASE WHEN k.f >= cuts + 1 THEN 1 ELSE 0 END FROM c JOIN k ON k.input_id = c.input_id AND k.j = c.j + 1), "
    "s AS (SELECT e.input_id, c.cuts AS segment, e.pts FROM ev e ASOF JOIN c ON c.input_id = e.input_id AND e.pts >= c.pts), g AS (SELECT input_id, segment, min(pts) AS start_pts, count(*) AS n FROM s GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY segment DESC) <= 6"
)
def playlist_segments(s, d):
    f = _daily(_frames(s, d)).withColumn("is_key", F.col("frame_id") % 5 == 0)
    return lifecycle.segments(f, ["input_id"], "day", ["pts", "frame_id"], 2 * D, keep=6)


@query(f"WITH {EV}, o AS (SELECT DISTINCT user_id AS output_id, CASE WHEN user_id % 3 > 0 THEN user_id * {2 * H} END AS start_at FROM ev) SELECT output_id, count(*) AS n, min(slot_pts) AS first FROM o, (SELECT range * {H} AS slot_pts FROM range((SELECT max(pts) // {H} + 1 FROM ev))) s WHERE start_at IS NULL OR slot_pts > start_at GROUP BY 1")
def start_at(s, d):
    outputs = _frames(s, d).select(F.col("user_id").alias("output_id")).distinct().withColumn("start_at", F.when(F.col("output_id") % 3 > 0, F.col("output_id") * (2 * H)))
    return lifecycle.started(_slots(s, d), outputs).groupBy("output_id").agg(F.count(F.lit(1)).alias("n"), F.min("slot_pts").alias("first"))


@query(
    "WITH o AS (SELECT c_custkey AS output_id, c_custkey % 3 > 0 AS v, c_custkey % 2 = 0 OR c_custkey % 3 = 0 AS a FROM customer WHERE c_custkey % 7 > 0), u AS (SELECT o_orderkey AS update_id, o_custkey AS output_id, o_orderkey % 4 > 0 AS video, o_orderkey % 3 > 0 AS audio FROM orders) "
    "SELECT update_id, u.output_id, CASE WHEN v IS NULL THEN 'not registered' WHEN video <> v OR audio <> a THEN 'audio or video doesn''t match' ELSE 'no audio and no video' END AS reason FROM u LEFT JOIN o USING (output_id) WHERE v IS NULL OR video <> v OR audio <> a OR NOT video AND NOT audio"
)
def updates_refused(s, d):
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    outputs = tables.table(s, d, "customer").where("c_custkey % 7 > 0").select(c.alias("output_id"), (c % 3 > 0).alias("has_video"), ((c % 2 == 0) | (c % 3 == 0)).alias("has_audio"))
    updates = tables.table(s, d, "orders").select(o.alias("update_id"), F.col("o_custkey").alias("output_id"), (o % 4 > 0).alias("video"), (o % 3 > 0).alias("audio"))
    return lifecycle.refused(updates, outputs)


@query(
    f"WITH {EV}, w AS (SELECT *, pts <= {20 * D} AND pts > {20 * D - 12 * H} AS inside FROM ev) SELECT user_id, coalesce(min(payload) FILTER (inside), 0)::DOUBLE AS value_min, round(coalesce(avg(payload) FILTER (inside), 0), 9)::DOUBLE AS value_avg, coalesce(max(payload) FILTER (inside), 0)::DOUBLE AS value_max, "
    "count(*) FILTER (inside AND frame_id % 5 = 0) AS lost FROM w GROUP BY 1"
)
def last_window(s, d):
    out = stats.last_window(_frames(s, d), ["user_id"], "pts", 20 * D, {"value": "payload"}, 12 * H, {"lost": F.col("frame_id") % 5 == 0})
    return out.withColumn("value_avg", F.round("value_avg", 9))


PROTOCOLS = ("rtp", "hls_input", "whip_input", "rtmp", "mp4", "whip_output", "moq")


@query(
    f"WITH {EV}, p AS (SELECT 'r' || user_id % 20 AS ref, {list(PROTOCOLS)}[user_id % 20 % 7 + 1] AS protocol, CASE WHEN frame_id % 2 = 0 THEN 'video' ELSE 'audio' END AS track, floor(payload)::BIGINT AS size, payload * 1e6 AS buffer, frame_id % 3 > 0 AS connected, pts // 10000 AS t FROM ev), "
    f"g AS (SELECT ref, protocol, track, count(*) FILTER (t <= {200 * S}) AS received, CAST(coalesce(sum(size) FILTER (t <= {200 * S} AND t > {199 * S}), 0) * 8 AS BIGINT) AS bitrate_1_second, CAST(floor(coalesce(sum(size) FILTER (t <= {200 * S} AND t > {140 * S}), 0) * 8 / 60) AS BIGINT) AS bitrate_1_minute, "
    f"arg_max(connected, t) FILTER (t <= {200 * S}) AS c, count(*) FILTER (t <= {200 * S} AND t > {190 * S}) AS packets, coalesce(max(buffer) FILTER (t <= {200 * S} AND t > {190 * S}), 0) AS top FROM p GROUP BY 1, 2, 3 HAVING count(*) FILTER (t <= {200 * S}) > 0) "
    "SELECT ref, protocol, track, received, bitrate_1_second, bitrate_1_minute, CASE WHEN protocol IN ('rtp', 'whip_input', 'whep_input', 'hls_input') THEN packets END AS packets, CASE WHEN protocol IN ('rtp', 'whip_input', 'whep_input', 'hls_input') THEN round(top, 3) END::DOUBLE AS top, CASE WHEN protocol = 'whip_output' THEN c END AS is_connected FROM g"
)
def protocol_rates(s, d):
    u, e = F.col("user_id"), F.col("frame_id")
    rows = _frames(s, d).select(
        F.concat(F.lit("r"), (u % 20).cast("string")).alias("ref"), F.element_at(F.array(*map(F.lit, PROTOCOLS)), (u % 20 % 7 + 1).cast("int")).alias("protocol"), F.when(e % 2 == 0, "video").otherwise("audio").alias("track"),
        F.floor("payload").cast("long").alias("size"), (F.col("payload") * 1e6).alias("buffer"), (e % 3 > 0).alias("connected"), F.floor(F.col("pts") / 10_000).cast("long").alias("t"),
    )
    out = stats.protocol_report(rows, "t", 200 * S)
    return out.select("ref", "protocol", "track", "received", "bitrate_1_second", "bitrate_1_minute", F.col("last_10_seconds.packets_received").alias("packets"), F.round("last_10_seconds.effective_buffer_max", 3).alias("top"), "is_connected")


SPECTRUM = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i, len(embedding) AS n FROM embeddings), w AS (SELECT vec_id, i, n, x * (0.5 - 0.5 * cos(2 * pi() * i / n)) AS x FROM e),
 b AS (SELECT vec_id, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) AS m, any_value(n) AS n FROM w, LATERAL (SELECT unnest(range(n // 2 + 1)) AS k) GROUP BY 1, 2)"""


@query(
    f"""{SPECTRUM}
 SELECT vec_id, round(avg(m), 6) AS average, round(median(m), 6) AS median, round(max(m), 6) AS level, round(arg_max(k, m) * 48000.0 / any_value(n), 6)::DOUBLE AS frequency FROM b GROUP BY 1"""
)
def spectrum_levels(s, d):
    e = tables.table(s, d, "embeddings").select("vec_id", media.spectrum_levels(F.col("embedding").cast("array<double>"), F.lit(48_000)).alias("x"))
    return e.select("vec_id", *[F.round(f"x.{c}", 6).alias(c) for c in ("average", "median", "level", "frequency")])


@query(f"{SPECTRUM}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, k) AS place FROM b) SELECT vec_id, place, round(k * 48000.0 / n, 6)::DOUBLE AS frequency, round(m / n, 6) AS level FROM r WHERE place <= 3 AND m / n > 0.01")
def strongest_bins(s, d):
    e = tables.table(s, d, "embeddings").select("vec_id", F.posexplode(media.strongest_bins(F.col("embedding").cast("array<double>"), F.lit(48_000), 3, 0.01)).alias("place", "b"))
    return e.select("vec_id", (F.col("place") + 1).cast("long").alias("place"), F.round("b.frequency", 6).alias("frequency"), F.round("b.level", 6).alias("level"))


@query(f"WITH {EV} SELECT frame_id, CAST(greatest(0, (frame_id % 1000) * 1234567 - 300000000)::HUGEINT * 44100 // {S} AS BIGINT) AS n FROM ev")
def sample_counts(s, d):
    end = (F.col("frame_id") % 1000) * 1_234_567
    return _frames(s, d).select("frame_id", clock.sample_count(F.lit(300_000_000), end, 44_100).alias("n"))


@query("SELECT p_partkey AS id, round((p_partkey % 256) * (p_partkey * 7 % 256) / 255.0, 6)::DOUBLE AS red, CASE WHEN p_partkey * 7 % 256 > 0 THEN p_partkey % 256 ELSE 0 END::DOUBLE AS back FROM part")
def color_premultiply(s, d):
    k = F.col("p_partkey")
    c = F.struct((k % 256).alias("r"), (k * 3 % 256).alias("g"), (k * 5 % 256).alias("b"), (k * 7 % 256).alias("a"))
    p = tables.table(s, d, "part").select(k.alias("id"), colors.premultiplied(c).alias("p")).withColumn("u", colors.unpremultiplied(F.col("p")))
    return p.select("id", F.round("p.r", 6).alias("red"), F.round("u.r", 6).alias("back"))


@query("SELECT p_partkey AS id, greatest(0, least(p_size, greatest(0, least(p_partkey % 60 - 5, p_retailprice) / 2)))::DOUBLE AS radius FROM part")
def border_radius(s, d):
    return tables.table(s, d, "part").select(F.col("p_partkey").alias("id"), scene.clipped_radius(F.col("p_size").cast("double"), (F.col("p_partkey") % 60 - 5).cast("double"), F.col("p_retailprice")).alias("radius"))


@query("SELECT p_partkey AS id, CAST(CAST(p_partkey * 4294967296::HUGEINT // 8 AS BIGINT) AS VARCHAR) AS fixed, (p_partkey / 8)::DOUBLE AS secs FROM part")
def ntp_fixed_point(s, d):
    p = tables.table(s, d, "part").select(F.col("p_partkey").alias("id"), sequence.to_fixed_point(F.col("p_partkey") / 8).alias("x"))
    return p.select("id", F.col("x").cast("string").alias("fixed"), sequence.from_fixed_point(F.col("x")).cast("double").alias("secs"))


@query(f"WITH {EV}, b AS (SELECT user_id, frame_id, pts, 480 + frame_id % 7 AS n FROM ev) SELECT frame_id, first(pts) OVER w + CAST(floor(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1000000000 / 48000) AS BIGINT) AS pts FROM b WINDOW w AS (PARTITION BY user_id ORDER BY frame_id)")
def batch_times(s, d):
    b = _frames(s, d).select(F.col("user_id").alias("output_id"), F.col("frame_id").alias("batch_ix"), F.col("pts").alias("first_pts"), (480 + F.col("frame_id") % 7).alias("n"))
    return mix.output_times(b, 48_000).select(F.col("batch_ix").alias("frame_id"), "pts")


@query("SELECT p_partkey AS id, CAST(CASE p_partkey % 3 WHEN 0 THEN 300 WHEN 1 THEN ceil(length(p_name) * 0.6 * (p_size + 8) - 1e-6) ELSE 5000 END AS BIGINT) AS width, CAST(CASE WHEN p_partkey % 3 = 0 THEN 80 ELSE trunc(ceil((p_size + 8) * 1.2) + (p_size + 8) / 5.0) END AS BIGINT) AS height FROM part")
def text_sizes(s, d):
    k, size = F.col("p_partkey"), F.col("p_size") + 8
    mode = F.when(k % 3 == 0, "fixed").when(k % 3 == 1, "fitted").otherwise("fitted_column")
    out = text.text_size(F.col("p_name"), size, size * 1.2, mode, F.when(k % 3 == 0, 300).otherwise(5000), F.when(k % 3 == 0, 80))
    return tables.table(s, d, "part").select(k.alias("id"), out.alias("t")).select("id", "t.width", "t.height")
