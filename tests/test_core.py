"""Goldens and brute force for what SQL oracles don't reach."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom import clock
from chronoloom.functions import colors, media
from chronoloom.operators import align, folds, jitter, lifecycle, mix, ordered, scene, sequence, sessions, stats
from chronoloom.plans.components import SCHEMA as COMPONENTS
from chronoloom.plans.components import component, rows
from chronoloom.plans.engine import Engine, RequestError, view
from chronoloom.sources import sinks, tables
from chronoloom.streaming import live

MS = clock.MS


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_final_frame_shows_once(spark):
    frames = spark.createDataFrame([("a", 0, 60 * MS), ("a", 1, 75 * MS)], "input_id string, frame_id long, pts long")
    slots = clock.period_grid(spark, 60 * MS, 140 * MS, 20 * MS)
    out = align.sample_frames(frames, slots, last_once=True)
    assert values(out, "slot_pts", "frame_id") == [(100 * MS, None), (120 * MS, None), (60 * MS, 0), (80 * MS, 1)]


def test_later_of_equal_times_wins_and_buckets_carry(spark):
    frames = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("a", 3, 95)], "input_id string, frame_id long, pts long")
    slots = spark.createDataFrame([(i, i) for i in (5, 10, 50, 95, 500)], "slot_ix long, slot_pts long")
    for bucket in (1, 7, 1000):
        out = align.sample_frames(frames, slots, bucket_ns=bucket)
        assert values(out, "slot_pts", "frame_id") == sorted([(5, None), (10, 2), (50, 2), (95, 3), (500, 3)], key=repr)


def test_scheduled_updates_see_only_what_is_strictly_before(spark):
    versions = spark.createDataFrame([("o", 0, 1, "x"), ("o", 10, 2, "y")], "output_id string, effective_pts long, version long, scene string")
    slots = spark.createDataFrame([("o", t) for t in (0, 5, 10, 11)], "output_id string, slot_pts long")
    assert values(lifecycle.version_at(slots, versions, ["output_id"], ["scene"], bucket_ns=4), "slot_pts", "scene") == sorted([(0, None), (5, "x"), (10, "x"), (11, "y")], key=repr)


def test_chunks_of_batches(spark):
    batches = spark.createDataFrame([(i, i * 15 * MS) for i in range(8)], "batch long, start_pts long")
    out = dict(values(align.assign_chunks(batches, from_start=100 * MS), "batch", "chunk_ix"))
    assert out == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 4, 6: 5, 7: 6}


def test_ordered_helpers_against_a_plain_loop(spark):
    rng = random.Random(1)
    rows = sorted({(rng.choice("ab"), rng.randrange(1000), rng.randrange(-5, 6)) for _ in range(300)})
    seen, unique = set(), []
    for k, t, v in rows:
        if (k, t) not in seen:
            seen.add((k, t))
            unique.append((k, t, v))
    df = spark.createDataFrame(unique, "k string, t long, v long").withColumn("b", F.floor(F.col("t") / 37).cast("long"))
    out = ordered.with_lag(df, ["k"], "b", ["t"], {"prev": "v"})
    out = ordered.with_running_sum(out, ["k"], "b", ["t"], {"total": F.col("v")})
    out = ordered.with_running_max(out, ["k"], "b", ["t"], {"top": F.col("v")})
    want, state = [], {}
    for k, t, v in unique:
        prev, total, top = state.get(k, (None, 0, None))
        want.append((k, t, prev, total + v, top))
        state[k] = (v, total + v, v if top is None else max(top, v))
    assert values(out, "k", "t", "prev", "total", "top") == sorted(want, key=repr)


def test_unwrap_holds_at_zero(spark):
    rng = random.Random(2)
    numbers, at = [], 5
    for _ in range(200):
        at += rng.choice([1, 2, -3, 40_000, -30_000])
        numbers.append(at % 65_536)
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate(numbers)], "track string, i long, seq long").withColumn("b", F.floor(F.col("i") / 9).cast("long"))
    want, turns, last = [], 0, numbers[0]
    for i, n in enumerate(numbers):
        if abs(last - n) >= 32_767:
            turns = turns + 1 if last > n else max(0, turns - 1)
        want.append((i, turns * 65_536 + n))
        last = n
    out = sequence.unwrap(df, ["track"], "b", ["i"], {"full": ("seq", 16, 0)})
    assert values(out, "i", "full") == sorted(want, key=repr)


def test_gain_follows_peaks(spark):
    peaks = spark.createDataFrame([("o", 0, 0.9), ("o", 1, 0.7), ("o", 2, 0.1)], "output_id string, chunk_ix long, peak double")
    out = mix.gains(peaks, mix.Gain(0.8, 0.5, 0.01, 0.005)).orderBy("chunk_ix").collect()
    assert [round(r.new_gain, 6) for r in out] == [0.99, 0.99, 0.995]


def test_scaled_mix_against_a_loop(spark):
    rng = random.Random(3)
    rows = [("o", c, i, rng.uniform(-2, 2), rng.uniform(-2, 2)) for c in range(6) for i in range(5)]
    df = spark.createDataFrame(rows, "output_id string, chunk_ix long, ix long, l double, r double")
    got, factor = {(r.chunk_ix, r.ix): (r.l, r.r) for r in mix.scaled(df).collect()}, 1.0
    for c in range(6):
        own = [r for r in rows if r[1] == c]
        peak, old = max(max(abs(r[3]), abs(r[4])) for r in own), factor
        factor = max(factor - 0.02, 0) if peak * factor > 1 else min(factor + 0.01, 1) if peak * factor < 0.7 else factor
        for r in own:
            f = old + (factor - old) * r[2] / 5
            assert got[c, r[2]] == pytest.approx(tuple(max(-1, min(1, x * f)) for x in r[3:]))


def test_overlapping_batches_are_dropped(spark):
    rows = [("a", 0, 100 * MS), ("a", 10 * MS, 50 * MS), ("a", 30 * MS, 200 * MS), ("a", 100 * MS, 300 * MS)]
    df = spark.createDataFrame(rows, "input_id string, start_pts long, end_pts long")
    assert [r[0] for r in values(mix.accepted(df, ["input_id"]), "start_pts")] == [0, 30 * MS]


def test_greedy_pairs(spark):
    assert folds.paired([1, 6, 11], [2, 7, 12]) == [(1, 2), (6, 7), (11, 12)]
    assert folds.paired([1, 2, 3], [3]) == [(1, 3), (2, 3), (3, 3)]
    left, right = (spark.createDataFrame([("k", x) for x in v], "k string, pts long") for v in ([1, 6, 11], [2, 7, 12]))
    assert values(folds.pair_streams(left, right, "k", "pts"), "left_pts", "right_pts") == [(1, 2), (11, 12), (6, 7)]


def test_delays_converge_and_snap(spark):
    rows = [("t", i, i * 100 * MS, 0 if i < 2 else (100 * MS if i < 5 else 900 * MS)) for i in range(7)]
    out = folds.converged(spark.createDataFrame(rows, "track string, i long, pts long, target long"), ["track"], ["i"]).orderBy("i").collect()
    assert [r["size"] // MS for r in out] == [0, 0, 4, 8, 12, 900, 900]
    sync = jitter.ClockSync(clock=1000.0)
    assert sync(0, 5.0, None) == (5.0,) and sync(1000, 6.0, 5.2)[0] == pytest.approx(6.01) and sync(2000, 7.0, 9.0)[0] == pytest.approx(11.0)
    # a sender that resumes without a gap in its stamps, and a report that is only seen once
    sync = jitter.ClockSync(clock=1000.0, resume=10.0)
    assert [round(sync(*x)[0], 6) for x in ((0, 5.0, None), (1000, 6.0, 5.1), (2000, 40.0, None), (3000, 41.0, None))] == [5.0, 6.01, 40.01, 41.01]
    # late by more than the delay: grows, and jumps once the first seconds are over
    delay = jitter.AdaptiveDelay(low=80 * MS, high=500 * MS)
    sizes = [delay(i * 100 * MS, i * 100 * MS + 490 * MS)[0] for i in range(60)]
    assert sizes[0] == 500 * MS and 560 * MS < sizes[39] < 570 * MS and any(b - a == clock.NS for a, b in zip(sizes, sizes[1:], strict=False))
    # above the comfortable zone from the start, far above it after two seconds: twenty seconds later it shrinks, then faster
    delay = jitter.AdaptiveDelay()
    sizes = [delay(i * clock.NS, max(0, i - 5) * clock.NS)[0] for i in range(40)]
    assert sizes[19] == 500 * MS and sizes[21] == pytest.approx(500 * MS * 0.997**2, abs=2) and sizes[39] == pytest.approx(sizes[21] * 0.99**18, abs=20)


def test_jitter_buffer_against_a_plain_one(spark):
    """Events of random packets, repeats among them, by a buffer that is searched whole each time."""
    rng = random.Random(21)

    def plain(packets, size):
        held, expected, out = {}, None, []

        def leave():
            nonlocal expected
            first = min(held)
            if expected is not None and first != expected:
                out.append(("lost", expected, None))
                expected += 1
            else:
                out.append(("packet", first, held.pop(first)[1]))
                expected = first + 1

        for number, pts, row in packets:
            if expected is not None and number < expected:
                out.append(("late", number, row))
                continue
            if number in held:
                out.append(("replaced", number, held[number][1]))
            held[number] = pts, row
            while held and (min(held) == expected or max(p for p, _ in held.values()) - min(p for p, _ in held.values()) >= size):
                leave()
        while held:
            leave()
        return out

    rows, want = [], {}
    for track in range(6):
        packets = [(n + rng.choice([0, 0, 0, 2, -3, -9]), n * 10 + rng.randint(-15, 15), 1000 * track + i) for i, n in enumerate(sorted(rng.choices(range(150), k=120)))]
        rows += [(track, n, p, r, i) for i, (n, p, r) in enumerate(packets)]
        want[track] = plain(packets, 60)
    df = spark.createDataFrame(rows, "track long, number long, pts long, frame_id long, arrival long")
    out = jitter.jitter(df, ["track"], 60).orderBy("track", "nth").collect()
    for track, events in want.items():
        assert [(r.event, r.number, r.frame_id) for r in out if r.track == track] == events
    assert jitter.jitter(df.limit(0), ["track"], 60).count() == 0


def test_synchronised_tracks_against_a_loop(spark):
    rng = random.Random(22)
    packets, reports = [], []
    for source in range(2):
        for track in range(2):
            at = 5.0 + source + 0.3 * track
            for i in range(80):
                at += 0.5 + rng.uniform(-0.05, 0.05) + (30 if (source, track, i) == (1, 0, 50) else 0)
                packets.append((source, track, 45_000 * (i + 1), round(at, 6), 1000 * source + 100 * track + i))
                if i % 13 == 5:
                    reports.append((source, track, 45_000 * (i + 1) + 100, 1e6 + 0.5 * i * (1 + 0.02 * track), round(at + 0.01, 6)))
    p = spark.createDataFrame(packets, "source long, track long, stamp long, arrival double, frame_id long")
    r = spark.createDataFrame(reports, "source long, track long, stamp long, ntp double, arrival double")
    got = {x.frame_id: x.pts_secs for x in jitter.synchronised(p, r, resume=10.0, bucket=7.0).collect()}
    for source in range(2):
        anchor, state = None, {}
        events = sorted([(a, 0, t, s, f) for so, t, s, a, f in packets if so == source] + [(a, 1, t, s, n) for so, t, s, n, a in reports if so == source])
        for at, kind, track, stamp, x in events:
            if kind == 0:
                if track not in state:
                    state[track] = {"first": stamp, "came": at, "offset": at, "top": stamp, "target": None, "at": at}
                z = state[track]
                gap = (stamp - z["top"]) / 90_000
                if stamp > z["top"] and at - z["at"] - gap > 10:
                    z["offset"] = z["target"] = z["offset"] + at - z["at"] - gap
                if z["target"] is not None:
                    z["offset"] += max(-0.01 * gap, min(0.01 * gap, z["target"] - z["offset"]))
                z["top"], z["at"] = max(z["top"], stamp), at
                assert got[x] == pytest.approx((stamp - z["first"]) / 90_000 + z["offset"], abs=1e-6)
            elif track in state:
                z = state[track]
                sent = x + (z["first"] - stamp) / 90_000
                anchor = sent - z["came"] if anchor is None else anchor
                z["target"] = sent - anchor
                if abs(z["target"] - z["offset"]) > 0.3:
                    z["offset"] = z["target"]


def test_queue_of_one_open_and_one_ended_input(spark):
    """Frames at 0, 15, ... 75 ms from 60 ms on; then the stream stays open, or ends after two."""
    slots = clock.period_grid(spark, 60 * MS, 160 * MS, 20 * MS)
    frames = [("a", i, (60 + 15 * i) * MS, i) for i in range(6)]
    df = spark.createDataFrame(frames, "input_id string, frame_id long, pts long, arrival_pts long")
    assert values(align.sample_frames(df, slots.where("slot_pts < 140000000")), "slot_pts", "frame_id") == sorted([(60 * MS, 0), (80 * MS, 1), (100 * MS, 2), (120 * MS, 4)], key=repr)
    ready = align.ready_at(slots, df)
    sent = {r.slot_pts // MS: r.sent_at for r in align.emitted(slots, ready, ["a"], ahead=True).collect()}
    assert [t for t, at in sent.items() if at is not None] == [60, 80, 100, 120]
    closed = spark.createDataFrame([("a", 9)], "input_id string, closed_at long")
    short = df.where("frame_id < 2")
    sent = {r.slot_pts // MS: (r.sent_at, r.complete) for r in align.emitted(slots, align.ready_at(slots, short, closed), ["a"], ahead=True).collect()}
    assert sent == {60: (1, True), 80: (9, True), 100: (9, True), 120: (9, True), 140: (9, True)}
    # no inputs at all: every slot leaves at its time
    none = align.emitted(slots, ready.limit(0), []).collect()
    assert all(r.sent_at == r.slot_pts and r.complete for r in none) and len(none) == 5
    # audio: a batch has to reach 80 ms beyond the chunk's end
    batches = spark.createDataFrame([("a", (15 + 15 * i) * MS, i) for i in range(8)], "input_id string, end_pts long, arrival_pts long")
    got = {r.slot_pts // MS: r.ready for r in align.chunk_ready_at(clock.period_grid(spark, 0, 60 * MS, 20 * MS), batches).collect()}
    assert got == {0: 6, 20: 7, 40: None}


def test_empty_and_unknown_conditions(spark):
    outputs = spark.createDataFrame([("a", "all_of", []), ("b", "any_of", []), ("c", "any_of", ["gone"])], "output_id string, condition string, inputs array<string>")
    ends = spark.createDataFrame([("x", 7)], "input_id string, end_pts long")
    assert values(lifecycle.ends(outputs, ends), "output_id", "end_pts") == [("a", 0), ("b", None), ("c", 0)]


def test_rotation_and_masks_add_up(spark):
    rows = [view("o", "r", width=100.0, height=100.0, scale_x=2.0, scale_y=0.5, rotation=10.0), view("o", "c", "r", 1, top=10.0, left=10.0, width=5.0, height=5.0, rotation=5.0, border=2.0)]
    schema = "output_id string, node_id string, parent_id string, child_ix int, top double, left double, width double, height double, scale_x double, scale_y double, rotation double, border double, mask struct<top:double,left:double,width:double,height:double,radius:double>"
    out = {r.node_id: r for r in scene.flatten(spark.createDataFrame(rows, schema)).collect()}
    c = out["c"]
    assert (c.abs_top, c.abs_left, c.abs_width, c.abs_height, c.abs_rotation, c.abs_border) == (5.0, 20.0, 10.0, 2.5, 15.0, 1.0)
    with pytest.raises(RequestError):
        view("o", "x", colour=1)


def test_masks_that_cut_nothing_go_and_the_rest_is_capped(spark):
    mask = lambda top, left, w, h, r: {"top": top, "left": left, "width": w, "height": h, "radius": r}
    holds, corner, cuts = mask(0.0, 0.0, 100.0, 100.0, 5.0), mask(0.0, 0.0, 100.0, 100.0, 20.0), mask(0.0, 0.0, 30.0, 100.0, 0.0)
    row = ("o", "1", 10.0, 10.0, 50.0, 50.0, 0.4, "color", 255, 0, [holds, corner, cuts])
    schema = "output_id string, path string, abs_top double, abs_left double, abs_width double, abs_height double, abs_border double, kind string, alpha int, border_alpha int, masks array<struct<top:double,left:double,width:double,height:double,radius:double>>"
    out = scene.drawn(spark.createDataFrame([row], schema), 100.0, 100.0)
    r = out.first()
    assert [m.asDict() for m in r.masks] == [corner, cuts] and r.abs_border == 0.0
    assert [m.asDict() for m in scene.capped(out, masks=1).first().masks] == [corner]


def test_full_range_colors(spark):
    r = spark.range(1).select(colors.yuv_to_rgb(F.lit(0.5), F.lit(0.5), F.lit(0.5), limited=False).alias("c"), colors.yuv_to_rgb(F.lit(0.5), F.lit(0.5), F.lit(1.0), limited=False).alias("d")).first()
    assert (r.c.r, r.c.g, r.c.b) == (0.5, 0.5, 0.5) and r.d.r == 1.0 and r.d.g == pytest.approx(0.5 - 0.4681 / 2) and r.d.b == 0.5


def test_colors_that_are_none(spark):
    texts = ["red", "#12", "#GG0000", "rgb(1,2)", "rgba(1,2,3,1.5)", "rgba(1, 2, 3,0.5)", " #FF000080 ", "rebeccapurple", "", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(colors.parse_color(F.col("t")).alias("c")).collect()
    got = [r.c and tuple(r.c) for r in out]
    assert got == [(255, 0, 0, 255), None, None, None, None, (1, 2, 3, 128), (255, 0, 0, 128), (102, 51, 153, 255), None, None]


def test_bytes_round_trips(spark):
    df = spark.createDataFrame([(5, 48_000, [[0.5, -1.0], [0.25, 2.0]])], "pts long, rate long, s array<array<double>>")
    r = df.select(media.unpack_audio(media.pack_audio("pts", "rate", "s")).alias("x")).first().x
    assert (r.pts, r.rate, r.samples) == (5, 48_000, [[0.5, -1.0], [0.25, 2.0]])
    stream = b"\0\0\1abc\0\0\0\1de\0\0\1f"
    out = spark.createDataFrame([(bytearray(stream),)], "b binary").select(media.start_codes_to_lengths("b").alias("l")).select("l", media.lengths_to_start_codes("l").alias("a")).first()
    assert bytes(out.l) == b"\0\0\0\3abc\0\0\0\2de\0\0\0\1f" and media.units(bytes(out.a)) == [b"abc", b"de", b"f"]
    wave = np.sin(2 * np.pi * 4 * np.arange(64) / 64).tolist()
    bins = spark.createDataFrame([(wave,)], "s array<double>").select(media.spectrum("s").alias("m")).first().m
    assert int(np.argmax(bins)) == 4


def test_named_functions(spark):
    known = media.Functions()
    known.register("scale", lambda x, k: x * k, "double", (float,))
    with pytest.raises(ValueError):
        known.register("scale", lambda x: x, "double")
    with pytest.raises(TypeError):
        known.call("scale", F.col("id"), params=("a",))
    assert [r[0] for r in spark.range(3).select(known.call("scale", F.col("id"), params=(2.0,))).collect()] == [0.0, 2.0, 4.0]
    with pytest.raises(TypeError):
        known.register("short", lambda x: x, "double", (float,), columns=1)
    known.register("mixed", lambda x, p: x * p["a"][0], "double", ({"a": [float]},), columns=1)
    with pytest.raises(TypeError):
        known.call("mixed", F.col("id"), params=({"a": ["x"]},))
    assert spark.range(1, 2).select(known.call("mixed", F.col("id"), params=({"a": [3.0]},))).first()[0] == 3.0
    known.unregister("scale")
    with pytest.raises(KeyError):
        known.unregister("scale")


def test_engine(spark):
    e = Engine(spark, num=50)
    for name in "ab":
        rows = [(name, i, i * 20 * MS) for i in range(5)]
        e.register_input(name, rows=rows, schema="input_id string, frame_id long, pts long")
    with pytest.raises(RequestError):
        e.register_input("a", rows=[], schema="input_id string, frame_id long, pts long")
    e.register_output("o", "any_of", ("a",))
    assert e.update_output("o", "one", at=0) and not e.update_output("o", "late", at=5, received=9) and e.update_output("o", "two", at=40 * MS)
    with pytest.raises(RequestError):
        e.set_volume("o", "a", 3.0)
    e.start()
    assert e.shown(100 * MS).count() == 10 and values(e.ends(), "output_id", "end_pts") == [("o", 80 * MS)]
    assert [s for _, s in values(e.scenes(100 * MS), "slot_pts", "scene")].count("two") == 2
    assert [r.input_id for r in e.stats().collect()] == ["a", "b"] and e.status()["started"]
    e.unregister_input("b")
    assert e.status()["inputs"] == ["a"] and e.events().count() == 5 and e.events(after=3).count() == 2
    e.request_key_frame("o")
    assert e.events(after=5).first().kind == "key_frame_requested"
    for wrong in ({"scene": None}, {"scene": "x", "volumes": {"a": 1.0}}, {"scene": "x", "transition": {"easing": "cubic_bezier", "points": (1.5, 0, 0, 0)}}, {"scene": "x", "transition": {"duration_ms": -1}}):
        with pytest.raises(RequestError):
            e.update_output("o", **wrong)
    e.register_output("sound", video=False, audio=True, start_at=40 * MS)
    assert e.update_output("sound", volumes={"a": 2.0})
    with pytest.raises(RequestError):
        e.request_key_frame("sound")
    with pytest.raises(RequestError):
        e.register_output("nothing", video=False)
    assert [t for t, _ in values(e.scenes(100 * MS).where("output_id = 'sound'"), "slot_pts", "scene")] == [60 * MS, 80 * MS]
    e.register_asset("image", "logo", b"...")
    with pytest.raises(RequestError):
        e.register_asset("image", "logo", b"...")
    e.unregister_asset("image", "logo")
    assert sorted(r.pts for r in e.tap("a", offset=5).collect())[:2] == [5, 20 * MS + 5]
    e.reset()
    assert e.status() == {"started": False, "inputs": [], "outputs": []}


def test_sinks_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a", s, s * 10 + i, i) for s in range(5) for i in range(3)], "input_id string, segment long, pts long, arrival long")
    with pytest.raises(sinks.NotRegistered):
        sinks.open_sink("nowhere", rows)
    with pytest.raises(sinks.AlreadyRegistered):
        sinks.register("file", sinks.file)
    back = spark.read.parquet(sinks.open_sink("file", rows, num=1, den=500_000_000))
    assert {(r.pts, r.file_pts) for r in back.collect()} == {(p, (p + 1) // 2) for s in range(5) for p in range(s * 10, s * 10 + 3)}
    kept = spark.read.parquet(sinks.open_sink("segments", rows, path=f"file://{tmp_path}/seg", keep=2))
    assert values(kept.groupBy("segment").count(), "segment", "count") == [(3, 3), (4, 3)]
    assert values(spark.read.parquet(sinks.open_sink("tap", rows.limit(1), offset=7, start_pts=3)), "pts")[0][0] >= 4
    sinks.open_sink("none", rows)
    (tmp_path / "pictures").mkdir()
    (tmp_path / "pictures" / "a.png").write_bytes(b"png")
    assert [(r.length, bytes(r.content)) for r in tables.open_source(spark, "assets", path=str(tmp_path / "pictures")).collect()] == [(3, b"png")]


def test_streams_write_segments(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([(i, i * 10) for i in range(20)], "frame_id long, pts long").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("frame_id long, pts long").parquet(str(folder))
    live.write_segments(stream, str(tmp_path / "out"), 50, str(tmp_path / "state")).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out")).groupBy("segment").count(), "segment", "count") == [(0, 5), (1, 5), (2, 5), (3, 5)]


def test_late_packets_of_a_stream_and_its_end(spark, tmp_path):
    folder = tmp_path / "in"
    for n, numbers in enumerate(([1, 2, 5, 9], [3, 4, 12], [13, 11])):
        rows = [("t", i, n * 10 + 10) for i in numbers]
        spark.createDataFrame(rows, "track string, number long, s long").select("track", "number", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("track string, number long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = live.drain(live.in_order(stream, hold=4)).collect()
    assert sorted(r.number for r in out) == [1, 2, 3, 4, 5, 9, 11, 12, 13] and {r.number for r in out if r.late} == {3, 4}


def test_packets_of_a_batch_are_not_late_by_each_other(spark, tmp_path):
    """One file is one batch, in whatever order its rows reach the task and however many pieces they come in."""
    folder = tmp_path / "in"
    for n, numbers in enumerate((range(30_000, 0, -1), [30_100, 29_960, 29_940, 30_100])):
        rows = [("t", i, n * 10 + 10) for i in numbers]
        spark.createDataFrame(rows, "track string, number long, s long").select("track", "number", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("track string, number long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = live.drain(live.in_order(stream, hold=50)).collect()
    assert sorted((r.number, r.late) for r in out) == sorted([(i, False) for i in range(1, 30_001)] + [(29_940, True), (30_100, False)])


def test_views_with_borders_wider_than_they_are(spark, tmp_path):
    """Against the query's SQL over more parts than the smallest tables have, and the clipped form."""
    import duckdb

    from chronoloom.plans.queries import ORACLE_SQL, QUERIES

    spark.range(5000, 5200).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    out = QUERIES["view_flex"](spark, str(tmp_path))
    want = duck.sql(f"SELECT * FROM ({ORACLE_SQL['view_flex']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and min(r[5] for r in want) < -6
    parents = spark.createDataFrame([(1, 100.0, 50.0, "row", 30.0, 3.0, 5.0, 3.0, 5.0, "hidden")], "parent_id long, view_width double, view_height double, direction string, border double, pad_top double, pad_right double, pad_bottom double, pad_left double, overflow string")
    children = spark.createDataFrame([(1, 0, 10.0, None)], "parent_id long, child_ix long, width double, height double")
    assert [values(scene.flex(parents, children, clip=c), "child_height") for c in (True, False)] == [[(-6.0,)], [(-16.0,)]]


def test_sliding_windows_against_a_plain_loop(spark):
    """Ties of time, times below zero and missing, null, infinite and uneven values, windows that hold all rows, and none but their own."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-60, 60)]), rng.choice([None, 1e16, 0.1, -3.25, rng.random()]), rng.choice([None, *range(-9, 9)])) for i in range(400)]
    rows += [(400, "c", 0, float("inf"), 1), (401, "c", 3, 1e300, 1), (402, "c", 30, 2.0, 2)]
    df = spark.createDataFrame(rows, "id long, k string, t long, x double, y long")
    for window in (0, 1, 7, 1000):
        out = stats.sliding(df, ["k"], "t", window, {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "m": ("avg", F.col("y")), "lo": ("min", F.col("x")), "hi": ("max", F.col("y")), "ys": ("sum", F.col("y"))})
        assert out.columns == [*df.columns, "n", "s", "m", "lo", "hi", "ys"] and out.schema["ys"].dataType == df.schema["y"].dataType
        found = {r.id: tuple(r)[5:] for r in out.collect()}
        for i, k, t, _, _ in rows:
            inside = [r for r in rows if r[1] == k and (r[2] is None if t is None else r[2] is not None and t - window <= r[2] <= t)]
            x, y = [r[3] for r in inside if r[3] is not None], [r[4] for r in inside if r[4] is not None]
            want = (len(inside), sum(x) if float("inf") in x else math.fsum(x) if x else None, sum(y) / len(y) if y else None, min(x, default=None), max(y, default=None), sum(y) if y else None)
            assert all(a == b or a is not None and b is not None and a == pytest.approx(b, rel=1e-15) for a, b in zip(found[i], want, strict=True)), (window, i)


def test_sliding_windows_that_are_dense(spark):
    """A window of 30,000 rows at every row, 60,000 rows in all; sums don't drift."""
    df = spark.range(60_000).select("id", F.lit("a").alias("k"), (F.col("id") % 7 / 10 + F.lit(0.01)).alias("x"))
    start = time.time()
    out = stats.sliding(df, ["k"], "id", 29_999, {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "hi": ("max", F.col("x"))}).where("id in (29999, 59999)").orderBy("id")
    cents = [1 + 10 * (i % 7) for i in range(60_000)]
    assert [tuple(r)[3:] for r in out.collect()] == [(30_000, sum(cents[lo : lo + 30_000]) / 100, 0.61) for lo in (0, 30_000)]
    assert time.time() - start < 30


def test_timers(spark):
    """5 ms ticks: each slot of 30 a second falls due at the first tick at or after it."""
    timer = live.ticks(spark, 5, per_batch=100)
    out = live.drain(live.due(timer, 5, 30)).collect()
    assert len(out) >= 15 and [r.slot_ix for r in sorted(out, key=lambda r: r.slot_ix)] == list(range(len(out)))
    assert all(r.slot_pts <= r.tick_ms * MS < r.slot_pts + 5 * MS for r in out)


def test_scene_builders(spark):
    tile = component("tiles", component("input_stream", input_id="a"), component("rescaler", component("image", image_id="logo"), mode="fill"), id="t", width=100.0)
    scene_rows = rows("o", 1, component("view", tile, component("text", text="hi", font_size=12.0), component("shader", shader_id="s", resolution=(1, 1)), component("web_view", instance_id="w"), direction="row", transition={"duration_ms": 5.0}))
    df = spark.createDataFrame(scene_rows, COMPONENTS)
    assert [(r.node_id, r.parent_id, r.type) for r in df.collect()] == [
        ("0", None, "view"), ("0/0", "0", "tiles"), ("0/0/0", "0/0", "input_stream"), ("0/0/1", "0/0", "rescaler"), ("0/0/1/0", "0/0/1", "image"), ("0/1", "0", "text"), ("0/2", "0", "shader"), ("0/3", "0", "web_view")
    ]
    bad = [("view", (), {"colour": 1}), ("image", (), {}), ("rescaler", (), {}), ("view", (), {"top": 1, "bottom": 2}), ("view", (), {"direction": "up"}), ("text", (tile,), {"text": "", "font_size": 1}), ("nothing", (), {})]
    for kind, children, props in bad:
        with pytest.raises(RequestError):
            component(kind, *children, **props)
    with pytest.raises(RequestError):
        rows("o", 1, component("view", component("view", id="x"), component("view", id="x")))


def test_pictures_and_side_channels(spark):
    slice_first, slice_next, key = b"\x41\x9a\x01", b"\x41\x21\x02", b"\x65\x88\x03"
    code = b"\0\0\0\1"
    stream = code.join([b"", b"\x67\x01", b"\x68\x02", key, slice_first, slice_next, b"\x09\x10", slice_first, slice_first])
    assert media.access_units(stream) == [code.join([b"", b"\x67\x01", b"\x68\x02", key]), code.join([b"", slice_first, slice_next]), code.join([b"", b"\x09\x10", slice_first]), code.join([b"", slice_first])]
    df = spark.createDataFrame([(2, 1, 77, bytearray(b"abcdefgh"))], "w long, h long, p long, d binary").select(media.pack_frame("w", "h", "p", "d").alias("f"))
    frame = bytes(df.first().f)
    one = df.select(media.unpack_frame("f").alias("x")).first().x
    assert (one.width, one.height, one.pts, bytes(one.rgba)) == (2, 1, 77, b"abcdefgh")
    recorded = media.message(frame) + media.message(frame) + media.message(frame)[:-1]
    whole, rest = media.messages(recorded)
    assert whole == [frame, frame] and rest == media.message(frame)[:-1]
    found = spark.createDataFrame([(bytearray(recorded),)], "b binary").select(media.frames_of("b").alias("f"), media.split_pictures("b").alias("n")).first()
    assert [(x.width, x.pts, bytes(x.rgba)) for x in found.f] == [(2, 77, b"abcdefgh")] * 2


def test_pixel_orders(spark):
    df = spark.createDataFrame([(bytearray(range(8)), 2, 2)], "b binary, w long, h long")
    r = df.select(media.bgra_to_rgba("b").alias("x"), media.argb_to_rgba("b").alias("y"), media.uyvy_planes("b").alias("u"), media.yuyv_planes("b").alias("v"), media.nv12_planes(F.substring("b", 1, 6), "w", "h").alias("n")).first()
    assert bytes(r.x) == bytes([2, 1, 0, 3, 6, 5, 4, 7]) and bytes(r.y) == bytes([1, 2, 3, 0, 5, 6, 7, 4])
    assert [bytes(x) for x in r.u] == [bytes([1, 3, 5, 7]), bytes([0, 4]), bytes([2, 6])] and [bytes(x) for x in r.v] == [bytes([0, 2, 4, 6]), bytes([1, 5]), bytes([3, 7])]
    assert [bytes(x) for x in r.n] == [bytes([0, 1, 2, 3]), bytes([4]), bytes([5])]


def test_spectra_agree_within_tolerances(spark):
    t = np.arange(64) / 64
    a, b, c = (np.sin(2 * np.pi * f * t) * g for f, g in ((4, 1.0), (4, 1.02), (5, 1.0)))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), c.tolist())], "a array<double>, b array<double>, c array<double>")
    levels, bins = (lambda x: media.spectrum_levels(x, F.lit(64)), lambda x: media.strongest_bins(F.col(x), F.lit(64), 1))
    df = df.select(*[levels(x).alias(f"l{x}") for x in "abc"], *[bins(x).alias(f"s{x}") for x in "abc"])
    r = df.select(media.same_levels(F.col("la"), F.col("lb"), 0.1, 0.1, 1.0).alias("w"), media.same_levels(F.col("la"), F.col("lb"), 0.1, 0.1, 0.1).alias("x"), media.same_bins(F.col("sa"), F.col("sb"), 0.01).alias("y"), media.same_bins(F.col("sa"), F.col("sc"), 0.01).alias("z")).first()
    assert (r.w, r.x, r.y, r.z) == (True, False, True, False)


def test_lines_of_text():
    from chronoloom.functions.text import broken

    assert broken("aa bb cc\nd", {}, 1.0, 1.0, None) == [8.0, 1.0] and broken("aa bb cc", {}, 1.0, 1.0, 5.0) == [5.0, 2.0]
    assert broken("abcdefg", {"a": 2.0}, 1.0, 1.0, 3.0) == [3.0, 3.0, 2.0] and broken("", {}, 1.0, 1.0, 3.0) == [0.0]


def test_greedy_walk_needs_little_memory():
    rng = random.Random(23)
    for _ in range(300):
        left, right = (sorted(rng.choices(range(60), k=rng.randint(0, 12))) for _ in range(2))
        walk, got = folds.Walk(), []
        for at, side in sorted([(x, 0) for x in left] + [(x, 1) for x in right]):
            walk.rows[side].append(at)
            got += walk.step()
        walk.ended[:] = [True, True]
        assert got + walk.step() == folds.paired(left, right)


def test_snapshot_and_mono(spark):
    rows_ = [("r", "rtp", "video", 100, 5.0, True, i * clock.NS) for i in range(20)]
    df = spark.createDataFrame(rows_, "ref string, protocol string, track string, size long, buffer double, connected boolean, t long")
    text = Engine(spark).snapshot(df, "t", 19 * clock.NS).first().report
    track = __import__("json").loads(text)["tracks"][0]
    assert track["bitrate_1_second"] == 800 and track["last_10_seconds"]["packets_received"] == 10 and "is_connected" not in track
    assert spark.range(1).select(mix.mono(F.lit(1.0), F.lit(0.5)).alias("m")).first().m == 0.75
    states = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t long, s string")
    assert values(sessions.latest_state(states, ["k"], "t", "s"), "k", "s") == [("a", "y"), ("b", "z")]


def test_entry_imports_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path / "r", capture_output=True, text=True, check=True)
    n, m = map(int, said.stdout.split())
    assert n > 80 and m > 75
