"""Schedules, versions, ends and one-time events of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import clock
from .ordered import as_of, with_running_max, with_running_sum


def version_at(slots: DataFrame, versions: DataFrame, keys: list[str], values: list[str], bucket_ns: int = clock.DAY, tie: str = "version") -> DataFrame:
    """The version in force in each slot: the newest that took effect before it, not at it."""
    return as_of(slots, versions, keys, "slot_pts", "effective_pts", values, bucket_ns, tie=tie, strict=True)


def accepted_updates(updates: DataFrame, run_late: bool = False) -> DataFrame:
    """Scheduled updates that run: those not in the past when they came, and late ones by policy.

    ``updates``: effective_pts, received_pts, late_policy ('default', 'always').
    """
    late = F.col("effective_pts") < F.col("received_pts")
    return updates.where(~late | (F.col("late_policy") == "always") | F.lit(run_late)).withColumn("late", late)


def ends(outputs: DataFrame, input_ends: DataFrame) -> DataFrame:
    """When each output ends: (output_id, end_pts), null for never.

    ``outputs``: output_id, condition (any_of, all_of, any_input, all_inputs,
    never), inputs (array).  ``input_ends``: input_id, end_pts, null while
    open.  No inputs: all_of ends at once, any_of never.  An input that isn't
    there counts as ended from the start.
    """
    named = outputs.select("output_id", "condition", F.explode_outer("inputs").alias("input_id"))
    listed = named.join(input_ends.withColumn("known", F.lit(True)), "input_id", "left")
    at = F.when(F.col("known"), F.col("end_pts")).otherwise(F.lit(0))
    by = listed.where("input_id is not null").groupBy("output_id").agg(F.min(at).alias("any_end"), F.max(at).alias("all_end"), F.count_if(F.col("known") & F.col("end_pts").isNull()).alias("open"))
    every = input_ends.agg(F.min("end_pts").alias("first_end"), F.max("end_pts").alias("last_end"), F.count_if(F.col("end_pts").isNull()).alias("all_open"))
    out = outputs.join(by, "output_id", "left").crossJoin(every)  # one row
    end = (
        F.when(F.col("condition") == "any_of", F.col("any_end"))
        .when(F.col("condition") == "all_of", F.when(F.size("inputs") == 0, F.lit(0)).when(F.col("open") == 0, F.col("all_end")))
        .when(F.col("condition") == "any_input", F.col("first_end"))
        .when(F.col("condition") == "all_inputs", F.when(F.col("all_open") == 0, F.coalesce("last_end", F.lit(0))))
    )
    return out.select("output_id", "condition", end.cast("long").alias("end_pts"))


def connected(registered: DataFrame, ended: DataFrame) -> DataFrame:
    return registered.join(ended.select("input_id"), "input_id", "left_anti")


def first_events(frames: DataFrame, resumes: DataFrame, bucket_ns: int = clock.DAY) -> DataFrame:
    """One 'delivered' event for each input, one 'playing' after each resume, one 'eos': (input_id, kind, pts)."""
    delivered = frames.groupBy("input_id").agg(F.min("pts").alias("pts")).withColumn("kind", F.lit("delivered"))
    eos = frames.groupBy("input_id").agg(F.max("pts").alias("pts")).withColumn("kind", F.lit("eos"))
    episodes = as_of(frames.select("input_id", "pts"), resumes.select("input_id", F.col("pts").alias("resumed")), ["input_id"], "pts", "resumed", [], bucket_ns)
    playing = episodes.groupBy("input_id", "resumed").agg(F.min("pts").alias("pts")).withColumn("kind", F.lit("playing"))
    cols = ["input_id", "kind", "pts"]
    return delivered.select(*cols).unionByName(playing.select(*cols)).unionByName(eos.select(*cols))


def timeline(shows: DataFrame) -> DataFrame:
    """All times at which something begins or ends, in order: what an offline run has to visit."""
    return shows.select(F.explode(F.array("start_pts", "end_pts")).alias("pts")).where("pts is not null").distinct().orderBy("pts")


def shown(items: DataFrame, at: Column) -> DataFrame:
    """Items on screen at a time: by delay since they were mounted, or by a half-open range."""
    by_delay = F.col("delay").isNotNull() & (at >= F.col("mounted_pts") + F.col("delay"))
    by_range = F.col("delay").isNull() & (F.col("start_pts").isNotNull() | F.col("end_pts").isNotNull()) & (at >= F.coalesce("start_pts", F.lit(0))) & (F.col("end_pts").isNull() | (at < F.col("end_pts")))
    return items.where(by_delay | by_range)


def slide_show(slides: DataFrame, keys: list[str]) -> DataFrame:
    """Slides one after the other: adds start_pts, end_pts. A slide without a length takes its longest child, else one second."""
    length = F.coalesce("duration", "child_duration", F.lit(clock.NS))
    w = Window.partitionBy(*keys).orderBy("slide_ix").rowsBetween(Window.unboundedPreceding, -1)
    out = slides.withColumn("start_pts", F.coalesce(F.sum(length).over(w), F.lit(0)))
    return out.withColumn("end_pts", F.col("start_pts") + length)


def previous_version(nodes: DataFrame, keys: list[str], version: str, values: dict[str, str]) -> DataFrame:
    """Each component's values in the version before: adds ``new: column`` pairs, null where it is new or changed its type."""
    w = Window.partitionBy(*keys).orderBy(version)
    same = (F.lag(version).over(w) == F.col(version) - 1) & (F.lag("type").over(w) == F.col("type"))
    return nodes.withColumns({n: F.when(same, F.lag(c).over(w)) for n, c in values.items()})


def anchored(packets: DataFrame, keys: list[str], start_at: int | None = None, start_pts: int = 0) -> DataFrame:
    """Output times from the first packet of any track, or from a given start: adds out_pts."""
    if start_at is not None:
        return packets.withColumn("out_pts", F.greatest(F.col("pts") - F.lit(start_at + start_pts), F.lit(0).cast("long")))
    first = packets.groupBy(*keys).agg(F.min("pts").alias("__first"))
    return packets.join(first, keys).withColumn("out_pts", F.col("pts") - F.col("__first")).drop("__first")


def anchor_tracks(packets: DataFrame, tracks: DataFrame, keys: list[str], bucket: str, timeout: int = 500 * clock.MS) -> DataFrame:
    """Times of outputs whose tracks begin one after the other: adds offset, resolved_at and out_pts.

    The offset is the lowest time among the packets up to the one that brought
    the last missing track, but packets wait at most until one is more than
    ``timeout`` above the lowest so far; without either, until the end.
    ``packets``: keys, track, pts, arrival; ``tracks``: keys, track, and
    ended_at where a track ends without a packet.
    """
    first = packets.groupBy(*keys, "track").agg(F.min("arrival").alias("__first"))
    met = tracks.join(first, [*keys, "track"], "left").withColumn("__at", F.coalesce("__first", "ended_at"))
    met = met.groupBy(*keys).agg(F.max("__at").alias("__met"), F.count_if(F.col("__at").isNull()).alias("__open"))
    rows = with_running_max(packets, keys, bucket, ["arrival"], {"__low": -F.col("pts")})
    waited = rows.where(F.col("pts") + F.coalesce("__low", -F.col("pts")) > timeout).groupBy(*keys).agg(F.min("arrival").alias("__late"))
    done = packets.groupBy(*keys).agg(F.max("arrival").alias("__end")).join(met, keys, "left").join(waited, keys, "left")
    done = done.select(*keys, F.least(F.when(F.col("__open") == 0, F.col("__met")), "__late", "__end").alias("resolved_at"))
    offsets = packets.join(done, keys).where(F.col("arrival") <= F.col("resolved_at")).groupBy(*keys).agg(F.min("pts").alias("offset"))
    return packets.join(done, keys).join(offsets, keys).withColumn("out_pts", F.col("pts") - F.col("offset"))


def segments(packets: DataFrame, keys: list[str], bucket: str, order: list[str], length: int, keep: int | None = None) -> DataFrame:
    """Cut streams into segments that begin at key packets: (keys, segment, start_pts, n).

    The k-th cut is at the first key packet that is k lengths or more after
    the stream's start and follows the cut before; ``keep`` leaves a stream's
    last ones.  With f the whole lengths that have passed at a key packet, and
    j its number, the cuts made by then are j plus the least f - j so far, 0 at most.
    """
    start = packets.groupBy(*keys).agg(F.min("pts").alias("__start"))
    rows = packets.join(start, keys).withColumn("__key", F.col("is_key").cast("long"))
    rows = with_running_sum(rows, keys, bucket, order, {"__j": F.col("__key")})
    spare = F.when(F.col("is_key"), F.floor((F.col("pts") - F.col("__start")) / length) - F.col("__j"))
    rows = with_running_max(rows.withColumn("__spare", spare), keys, bucket, order, {"__least": -F.col("__spare")})
    least = F.least(F.coalesce(-F.col("__least"), F.lit(0)), F.coalesce("__spare", F.lit(0)), F.lit(0))
    out = rows.withColumn("segment", (F.col("__j") + least).cast("long"))
    out = out.groupBy(*keys, "segment").agg(F.min("pts").alias("start_pts"), F.count(F.lit(1)).alias("n"))
    if keep is None:
        return out
    return out.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("segment")))).where(F.col("__r") <= keep).drop("__r")


def started(slots: DataFrame, outputs: DataFrame) -> DataFrame:
    """Slots that outputs take part in: (output_id, slot_pts), those strictly after ``start_at`` where it is given."""
    return slots.select("slot_pts").crossJoin(outputs.select("output_id", "start_at")).where("start_at is null or slot_pts > start_at").select("output_id", "slot_pts")


def refused(updates: DataFrame, outputs: DataFrame) -> DataFrame:
    """Updates that don't fit their output, with the reason: (update_id, output_id, reason).

    ``outputs``: output_id, has_video, has_audio; ``updates``: update_id,
    output_id, video, audio (whether the update has a scene or a mix).
    """
    both = updates.join(outputs, "output_id", "left")
    differ = (F.col("video") != F.col("has_video")) | (F.col("audio") != F.col("has_audio"))
    reason = F.when(F.col("has_video").isNull(), "not registered").when(differ, "audio or video doesn't match").when(~F.col("video") & ~F.col("audio"), "no audio and no video")
    return both.withColumn("reason", reason).where("reason is not null").select("update_id", "output_id", "reason")


def animation_frame(pts: Column, start: Column, delays: list[int]) -> Column:
    """Index of a looping animation's frame nearest to the time since its start; of two equally near the first."""
    total = max(1, sum(delays))
    at = F.pmod(pts - start, F.lit(total).cast("long"))
    times = [sum(delays[:i]) for i in range(len(delays))]
    options = [F.struct(F.abs(at - t).alias("d"), F.lit(i).alias("i")) for i, t in enumerate(times)]
    return (F.least(*options) if len(options) > 1 else options[0])["i"]


