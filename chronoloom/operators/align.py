"""Aligning streams on a common clock: sampling, chunking, interleaving, epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import clock
from .ordered import as_of, with_lag, with_running_max, with_running_sum


def sample_frames(frames: DataFrame, slots: DataFrame, bucket_ns: int = clock.DAY, stale_after: int | None = None, last_once: bool = False) -> DataFrame:
    """Which frame each input shows in each slot: (slot_pts, input_id, frame_id, pts).

    The newest frame at or before the slot; of equal times the later id.
    ``stale_after``: a frame older than that counts as missing.  ``last_once``:
    an ended input's final frame is shown in one slot only.
    """
    inputs = frames.select("input_id").distinct()
    probes = slots.select("slot_pts").crossJoin(inputs)  # the grid itself: slots times inputs
    out = as_of(probes, frames, ["input_id"], "slot_pts", "pts", ["frame_id"], bucket_ns, tie="frame_id")
    if stale_after is not None:
        fresh = F.col("slot_pts") - stale_after <= F.col("pts")
        out = out.withColumn("frame_id", F.when(fresh, F.col("frame_id"))).withColumn("pts", F.when(fresh, F.col("pts")))
    if last_once:
        # the last frame's one slot is the first that found it
        ends = frames.groupBy("input_id").agg(F.max("pts").alias("pts"))
        first = out.join(ends, ["input_id", "pts"], "left_semi").groupBy("input_id").agg(F.min("slot_pts").alias("last_slot"))
        out = out.join(first, "input_id", "left")
        shown = F.col("last_slot").isNull() | (F.col("slot_pts") <= F.col("last_slot"))
        out = out.withColumn("frame_id", F.when(shown, F.col("frame_id"))).withColumn("pts", F.when(shown, F.col("pts"))).drop("last_slot")
    return out.select("slot_pts", "input_id", "frame_id", "pts")


def frame_sets(samples: DataFrame) -> DataFrame:
    """One row for each slot with a map of the inputs that show a frame."""
    entries = F.collect_list(F.when(F.col("frame_id").isNotNull(), F.struct("input_id", "frame_id")))
    return samples.groupBy("slot_pts").agg(F.map_from_entries(F.array_sort(entries)).alias("frames"))


def assign_chunks(batches: DataFrame, from_start: int | None = None) -> DataFrame:
    """The chunk in which each batch is handed out, once: adds chunk_ix.

    A chunk takes batches that start before its end plus the stretch; with an
    offset from the start nothing is handed out before it.
    """
    offset = from_start or 0
    p = F.col("start_pts") + offset
    earliest = F.floor((p - clock.STRETCH) / clock.CHUNK)
    held = -(-offset // clock.CHUNK) - 1 if from_start else 0
    return batches.withColumn("chunk_ix", F.greatest(F.lit(0), earliest, F.lit(held)).cast("long"))


def merge_by_time(*streams: DataFrame) -> DataFrame:
    """Rows of several streams in one order: time, then stream, then id."""
    out = None
    for n, s in enumerate(streams):
        s = s.withColumn("stream", F.lit(n))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out.orderBy("pts", "stream", "frame_id")


def merge_inputs(frames: DataFrame) -> DataFrame:
    """:func:`merge_by_time` for all inputs of one table, numbered in order of their names."""
    numbers = frames.select("input_id").distinct().withColumn("stream", (F.row_number().over(Window.orderBy("input_id")) - 1).cast("int"))
    joined = frames.join(numbers.withColumnRenamed("input_id", "__input"), F.col("input_id").eqNullSafe(F.col("__input"))).drop("__input")
    return joined.orderBy("pts", "stream", "frame_id")


def interleaved(video: DataFrame, audio: DataFrame, events: DataFrame) -> DataFrame:
    """The order in which slots of video, chunks of audio and scheduled events are handled: adds kind and rank.

    At one time video comes first, then audio; an event comes before them only
    if it is strictly earlier.  Rows: (id, pts).
    """
    out = None
    for rank, (kind, rows) in enumerate((("video", video), ("audio", audio), ("event", events))):
        rows = rows.select("id", "pts", F.lit(kind).alias("kind"), F.lit(rank).alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy("pts", "rank", "id")


def with_pauses(slots: DataFrame, pauses: DataFrame, bucket_ns: int = clock.DAY) -> DataFrame:
    """Time that an input has played at each slot: (input_id, slot_pts, paused, played).

    ``pauses``: (input_id, start_pts, end_pts), not overlapping.  While an input
    is paused its time stands still.
    """
    w = Window.partitionBy("input_id").orderBy("start_pts").rowsBetween(Window.unboundedPreceding, -1)
    table = pauses.withColumn("before", F.coalesce(F.sum(F.col("end_pts") - F.col("start_pts")).over(w), F.lit(0)))
    at = as_of(slots, table, ["input_id"], "slot_pts", "start_pts", ["end_pts", "before"], bucket_ns)
    inside = F.coalesce(F.col("slot_pts") < F.col("end_pts"), F.lit(False))
    gone = F.coalesce(F.col("before"), F.lit(0)) + F.coalesce(F.least("slot_pts", "end_pts") - F.col("start_pts"), F.lit(0))
    return at.select("input_id", "slot_pts", inside.alias("paused"), (F.col("slot_pts") - gone).alias("played"))


def frozen(slots: DataFrame, frames: DataFrame, pauses: DataFrame, bucket_ns: int = clock.DAY) -> DataFrame:
    """What an input with pauses shows: (input_id, slot_pts, paused, frame_id, pts).

    In a pause the frame of its beginning is shown again and again, its time
    moving on with the slots; ``slots``: (input_id, slot_pts).
    """
    at = as_of(slots.select("input_id", "slot_pts"), pauses, ["input_id"], "slot_pts", "start_pts", ["end_pts"], bucket_ns)
    paused = F.coalesce(F.col("slot_pts") < F.col("end_pts"), F.lit(False))
    at = at.withColumn("paused", paused).withColumn("look", F.when(F.col("paused"), F.col("start_pts")).otherwise(F.col("slot_pts"))).drop("end_pts", "start_pts")
    found = as_of(at, frames, ["input_id"], "look", "pts", ["frame_id"], bucket_ns, tie="frame_id")
    return found.select("input_id", "slot_pts", "paused", "frame_id", (F.col("pts") + F.col("slot_pts") - F.col("look")).alias("pts"))


def silenced(chunks: DataFrame, pauses: DataFrame, bucket_ns: int = clock.DAY) -> DataFrame:
    """Batches of audio by chunk without those of chunks in a pause: ``chunks`` has input_id, chunk_pts."""
    at = as_of(chunks, pauses, ["input_id"], "chunk_pts", "start_pts", ["end_pts"], bucket_ns)
    return at.where(F.col("end_pts").isNull() | (F.col("chunk_pts") >= F.col("end_pts"))).drop("start_pts", "end_pts")


def epochs(frames: DataFrame, keys: list[str], bucket: str, max_jump: int, order: list[str] | None = None) -> DataFrame:
    """Split streams where time jumps by more than ``max_jump`` either way: adds epoch (from 0) and epoch_pts.

    ``epoch_pts`` is the time since the epoch's first row.
    """
    order = order or ["arrival", "frame_id"]
    out = with_lag(frames, keys, bucket, order, {"__prev_pts": "pts"})
    jump = F.coalesce((F.abs(F.col("pts") - F.col("__prev_pts")) > max_jump).cast("long"), F.lit(0))
    out = with_running_sum(out.withColumn("__jump", jump), keys, bucket, order, {"epoch": F.col("__jump")}).drop("__prev_pts", "__jump")
    # the first row's time is the least by order: kept by a small aggregate, not by a window over the epoch
    anchors = out.groupBy(*keys, "epoch").agg(F.min_by("pts", F.struct(*order)).alias("__anchor"))
    return out.join(anchors, [*keys, "epoch"]).withColumn("epoch_pts", F.col("pts") - F.col("__anchor")).drop("__anchor")


def restarted(packets: DataFrame, keys: list[str], bucket: str, max_jump: int = 10 * clock.NS, order: list[str] | None = None) -> DataFrame:
    """Streams cut where time jumps, each part from its first key packet on: adds epoch and epoch_pts.

    Packets of a part before its first key packet are dropped, corrupt ones
    (where there is a column ``is_corrupt``) everywhere.
    """
    order = order or ["arrival", "frame_id"]
    if "is_corrupt" in packets.columns:
        packets = packets.where(~F.coalesce("is_corrupt", F.lit(False)))
    out = epochs(packets, keys, bucket, max_jump, order).drop("epoch_pts")
    place = F.struct(*order)
    first = out.where("is_key").groupBy(*keys, "epoch").agg(F.min(place).alias("__key"), F.min_by("pts", place).alias("__zero"))
    return out.join(first, [*keys, "epoch"]).where(place >= F.col("__key")).withColumn("epoch_pts", F.greatest(F.lit(0).cast("long"), F.col("pts") - F.col("__zero"))).drop("__key", "__zero")


def key_epochs(frames: DataFrame, keys: list[str], bucket: str, order: list[str], min_step: int = 100 * clock.MS, max_jump: int = 2 * clock.NS) -> DataFrame:
    """New epochs at key frames only: time went back, or a long step along with a jump against arrival."""
    out = with_lag(frames.withColumn("__off", F.col("pts") - F.col("arrival_pts")), keys, bucket, order, {"__p": "pts", "__o": "__off"})
    step = F.col("pts") - F.col("__p")
    new = F.col("is_key") & ((step < 0) | ((step >= min_step) & (F.abs(F.col("__off") - F.col("__o")) > max_jump)))
    out = out.withColumn("__new", F.coalesce(new.cast("long"), F.lit(0)))
    return with_running_sum(out, keys, bucket, order, {"epoch": F.col("__new")}).drop("__new", "__p", "__o", "__off")


def shared_anchor(frames: DataFrame, max_apart: int = 2 * clock.NS) -> DataFrame:
    """Shift of each track: both start together if their first offsets (time against arrival) are near, else each alone.

    ``frames``: (source, track, pts, arrival_pts); returns (source, track, anchor).
    """
    first = frames.groupBy("source", "track").agg(F.min(F.struct("arrival_pts", "pts")).alias("f"))
    first = first.select("source", "track", F.col("f.pts").alias("pts"), F.col("f.arrival_pts").alias("arrival"), (F.col("f.pts") - F.col("f.arrival_pts")).alias("off"))
    w = Window.partitionBy("source")
    near = F.max("off").over(w) - F.min("off").over(w) <= max_apart
    return first.select("source", "track", F.when(near, F.min(F.struct("arrival", "pts")).over(w)["pts"]).otherwise(F.col("pts")).alias("anchor"))


def offset_lock(frames: DataFrame, keys: list[str], bucket: str, order: list[str], epsilon: int = 5 * clock.MS, plateau: int = 3, limit: int = clock.NS) -> DataFrame:
    """When the running greatest offset settles: (keys, lock_arrival).

    An offset locks after ``plateau`` rows that don't raise it by more than
    ``epsilon``, or ``limit`` after the first row.
    """
    rows = frames.withColumn("__off", F.col("pts") - F.col("arrival_pts"))
    rows = with_running_max(rows, keys, bucket, order, {"__top": F.col("__off")})
    rises = (F.col("__top").isNull() | (F.col("__off") > F.col("__top") + epsilon)).cast("long")
    rows = with_running_sum(rows.withColumn("__rise", rises), keys, bucket, order, {"__run": F.col("__rise"), "__n": F.lit(1)})
    runs = rows.groupBy(*keys, "__run").agg(F.min("__n").alias("__from"))
    flat = rows.join(runs, [*keys, "__run"]).where(F.col("__n") - F.col("__from") >= plateau)
    settled = flat.groupBy(*keys).agg(F.min("arrival_pts").alias("__settled"))
    start = frames.groupBy(*keys).agg((F.min("arrival_pts") + limit).alias("__limit"), F.max("arrival_pts").alias("__end"))
    return start.join(settled, keys, "left").select(*keys, F.least(F.coalesce("__settled", F.col("__limit")), "__limit").alias("lock_arrival"))


def track_starts(tracks: DataFrame, pending: int = 5) -> DataFrame:
    """Tracks of an input play one after the other: adds start_pts from the lengths before, and queued_at.

    At most ``pending`` tracks wait: one more is taken in only when the track
    that many places before it starts.  With a column ``abort_pts`` a track may
    be cut short: it ends there if it would play longer.  ``tracks``: input_id,
    track_id, length.
    """
    w = Window.partitionBy("input_id").orderBy("track_id")
    out = tracks.withColumn("start_pts", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.withColumn("queued_at", F.coalesce(F.lag("start_pts", pending).over(w), F.lit(0)))


def aborted(tracks: DataFrame, aborts: DataFrame, bucket_ns: int = clock.DAY) -> DataFrame:
    """Lengths of tracks after forced ends: a track that plays at an abort ends there, what follows moves up.

    ``tracks``: input_id, track_id, length, start_pts; ``aborts``: input_id,
    abort_pts, by the clock without aborts; of several in one track the first counts.
    """
    hit = as_of(aborts, tracks, ["input_id"], "abort_pts", "start_pts", ["track_id", "length"], bucket_ns, tie="track_id")
    cut = hit.where(F.col("abort_pts") < F.col("start_pts") + F.col("length")).groupBy("input_id", "track_id").agg(F.min(F.col("abort_pts") - F.col("start_pts")).alias("__played"))
    out = tracks.drop("start_pts", "queued_at").join(cut, ["input_id", "track_id"], "left")
    return track_starts(out.withColumn("length", F.least("length", F.coalesce("__played", "length"))).drop("__played"))


def seek(samples: DataFrame, seek_pts: int) -> DataFrame:
    """Samples to decode from a seek point on: from the last key sample at or before it, ``present`` from it on.

    ``samples``: (track, ix, pts, is_key).
    """
    target = samples.where(F.col("pts") >= seek_pts).groupBy("track").agg(F.min("ix").alias("target"))
    start = samples.where("is_key").join(target, "track").where("ix <= target").groupBy("track", "target").agg(F.max("ix").alias("start"))
    return samples.join(start, "track").where("ix >= start").withColumn("present", F.col("ix") >= F.col("target")).drop("target", "start")


def edit_list(edits: DataFrame) -> DataFrame:
    """(track, delay, trim): leading empty edits delay a track, the first other edit trims it.

    ``edits``: (track, ix, duration, media_time), media_time -1 for an empty edit.
    """
    media = edits.where("media_time >= 0").groupBy("track").agg(F.min("ix").alias("first"), F.min_by("media_time", "ix").alias("trim"))
    empty = edits.where("media_time < 0").join(media.select("track", "first"), "track", "left").where("first is null or ix < first").groupBy("track").agg(F.sum("duration").alias("delay"))
    tracks = edits.select("track").distinct()
    return tracks.join(media.drop("first"), "track", "left").join(empty, "track", "left").select("track", F.coalesce("delay", F.lit(0)).alias("delay"), F.coalesce("trim", F.lit(0)).alias("trim"))


def looped(frames: DataFrame, times: int, length: int) -> DataFrame:
    """Each input played ``times`` times, each time as a new track."""
    return frames.withColumn("track_id", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("pts", F.col("pts") + F.col("track_id") * F.lit(length).cast("long"))


def trimmed(frames: DataFrame, start: int) -> DataFrame:
    """What is left when the clock starts: rows from then on and each input's newest one before."""
    old = frames.where(F.col("pts") < start).groupBy("input_id").agg(F.max(F.struct("pts", "frame_id")).alias("k"))
    keep = old.select("input_id", F.col("k.pts").alias("pts"), F.col("k.frame_id").alias("frame_id"))
    return frames.where(F.col("pts") >= start).unionByName(frames.join(keep, ["input_id", "pts", "frame_id"], "left_semi"))


def ready_at(slots: DataFrame, arrivals: DataFrame, closed: DataFrame | None = None, bucket_ns: int = clock.DAY, time: str = "pts", beyond: int = 0, strict: bool = True) -> DataFrame:
    """(slot_pts, input_id, ready): when each input was first ready for the slot, null if never.

    An input is ready when it has something newer than the slot, or once it is
    closed.  ``arrivals``: (input_id, pts, arrival_pts); ``closed``: (input_id,
    closed_at).  ``time``, ``beyond`` and ``strict``: which time has to pass
    the slot, by how much, and whether it may be equal.  With the time axis
    turned around this is an as-of lookup into the least arrival of all rows so far.
    """
    rows = arrivals.withColumn("neg", -F.col(time)).withColumn("bucket", F.floor(F.col("neg") / bucket_ns).cast("long"))
    rows = with_running_max(rows, ["input_id"], "bucket", ["neg", "arrival_pts"], {"__m": -F.col("arrival_pts")})
    rows = rows.withColumn("ready", -F.greatest(F.coalesce("__m", -F.col("arrival_pts")), -F.col("arrival_pts")))
    inputs = arrivals.select("input_id")
    if closed is not None:
        inputs = inputs.unionByName(closed.select("input_id"))
    probes = slots.select("slot_pts").crossJoin(inputs.distinct()).withColumn("at", -(F.col("slot_pts") + beyond))
    # of rows at one time the one with the least arrival so far is the last
    found = as_of(probes, rows.withColumn("order", -F.col("ready")), ["input_id"], "at", "neg", ["ready"], bucket_ns, tie="order", strict=strict)
    if closed is not None:
        found = found.join(closed.groupBy("input_id").agg(F.min("closed_at").alias("closed_at")), "input_id", "left").withColumn("ready", F.least("ready", "closed_at"))
    return found.select("slot_pts", "input_id", "ready")


def chunk_ready_at(chunks: DataFrame, batches: DataFrame, closed: DataFrame | None = None, bucket_ns: int = clock.DAY) -> DataFrame:
    """:func:`ready_at` for audio: a batch must end at the chunk's end and the stretch or later.

    ``chunks``: slot_pts (their starts); ``batches``: (input_id, end_pts, arrival_pts).
    """
    return ready_at(chunks, batches, closed, bucket_ns, time="end_pts", beyond=clock.CHUNK + clock.STRETCH, strict=False)


def emitted(slots: DataFrame, ready: DataFrame, required: list[str], ahead: bool = False, bucket_ns: int = clock.DAY) -> DataFrame:
    """When each slot is sent out: (slot_pts, sent_at, complete).

    ``ready``: (slot_pts, input_id, ready), as :func:`ready_at` gives.  A slot
    whose inputs are all ready is sent.  Required inputs hold it back, others
    only up to the slot's own time.  Unless ``ahead``, nothing is sent before
    its time.  Slots leave in order: none before the one ahead of it, and none
    after one whose required inputs never get there (null).
    """
    must = F.col("input_id").isin(required)
    by = ready.groupBy("slot_pts").agg(
        F.max("ready").alias("last"), F.coalesce(F.max(F.when(must, F.col("ready"))), F.lit(0)).alias("must"),
        F.count_if(F.col("ready").isNull()).alias("open"), F.count_if(must & F.col("ready").isNull()).alias("must_open"),
    )
    by = slots.select("slot_pts").join(by, "slot_pts", "left").fillna(0, ["must", "open", "must_open"])
    waits = F.greatest("must", F.when(F.col("open") == 0, F.least(F.coalesce("last", F.lit(0)), F.greatest("slot_pts", "must"))).otherwise(F.col("slot_pts")))
    own = waits if ahead else F.greatest(waits, F.col("slot_pts"))
    by = by.withColumn("__own", F.when(F.col("must_open") == 0, own)).withColumn("__key", F.lit(0)).withColumn("__b", F.floor(F.col("slot_pts") / bucket_ns).cast("long"))
    by = with_running_max(by, ["__key"], "__b", ["slot_pts"], {"__before": F.col("__own"), "__stuck": F.col("__own").isNull().cast("int")})
    sent = F.when(F.coalesce(F.col("__stuck"), F.lit(0)) == 0, F.greatest(F.col("__own"), F.coalesce("__before", "__own")) + F.col("__own") * 0)
    by = by.withColumn("sent_at", sent)
    return by.select("slot_pts", "sent_at", F.coalesce((F.col("open") == 0) & (F.coalesce("last", F.lit(0)) <= F.col("sent_at")), F.lit(False)).alias("complete"))


def delivered(batches: DataFrame) -> DataFrame:
    """When an output takes each batch: adds delivered_at, null if it is dropped.

    ``batches``: slot_pts, sent_at, accept_at (when the output has room),
    required.  A required batch waits for room; any other is dropped if there
    is none by its own time, or by the time it is sent if that is later.
    """
    in_time = F.col("required") | (F.col("accept_at") <= F.greatest("slot_pts", "sent_at"))
    return batches.withColumn("delivered_at", F.when(in_time, F.greatest("sent_at", "accept_at")))
