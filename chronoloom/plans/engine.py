"""A session of named inputs and outputs: register, update, start, and what they show.

The engine holds names and small tables on the driver, rows stay in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from ..operators import align, lifecycle, mix, stats
from ..sources import sinks, tables
from .components import RequestError, checked_transition, checked_volume, view  # noqa: F401 (part of the interface)


@dataclass
class Output:
    condition: str = "never"
    inputs: tuple[str, ...] = ()
    video: bool = True
    audio: bool = False
    start_at: int | None = None
    versions: list[tuple[int, str]] = field(default_factory=list)
    volumes: dict[str, float] = field(default_factory=dict)


class Engine:
    def __init__(self, spark: SparkSession, num: int = 30, den: int = 1, run_late: bool = False):
        self.spark, self.num, self.den, self.run_late = spark, num, den, run_late
        self.reset()

    def reset(self) -> None:
        """Forget everything that is registered; the engine can be started again."""
        self._inputs: dict[str, DataFrame] = {}
        self._outputs: dict[str, Output] = {}
        self._assets: dict[tuple[str, str], object] = {}
        self._events: list[tuple[int, str, str]] = []
        self._started: int | None = None

    def _emit(self, kind: str, name: str, pts: int = 0) -> None:
        self._events.append((pts, kind, name))

    def register_input(self, name: str, kind: str = "memory", **options) -> None:
        if name in self._inputs:
            raise RequestError(f"input {name} is registered")
        rows = tables.open_source(self.spark, kind, **options)
        self._inputs[name] = rows.where(F.col("input_id") == name) if "input_id" in rows.columns else rows.withColumn("input_id", F.lit(name))
        self._emit("input_registered", name)

    def unregister_input(self, name: str) -> None:
        if self._inputs.pop(name, None) is None:
            raise RequestError(f"no input {name}")
        self._emit("input_unregistered", name)

    def register_output(self, name: str, condition: str = "never", inputs: tuple[str, ...] = (), video: bool = True, audio: bool = False, start_at: int | None = None) -> None:
        if name in self._outputs:
            raise RequestError(f"output {name} is registered")
        if not video and not audio:
            raise RequestError("an output needs video or audio")
        self._outputs[name] = Output(condition, inputs, video, audio, start_at)
        self._emit("output_registered", name)

    def unregister_output(self, name: str) -> None:
        if self._outputs.pop(name, None) is None:
            raise RequestError(f"no output {name}")
        self._emit("output_unregistered", name)

    def _output(self, name: str) -> Output:
        if name not in self._outputs:
            raise RequestError(f"no output {name}")
        return self._outputs[name]

    def update_output(self, name: str, scene: str | None = None, at: int = 0, received: int = 0, policy: str = "default", volumes: dict[str, float] | None = None, transition: dict | None = None) -> bool:
        """Schedule a scene and a mix; false if they came too late to run.

        An output with video must get a scene and one with audio a mix, and neither the other.
        """
        output = self._output(name)
        if (scene is not None) != output.video or (volumes is not None) != output.audio:
            raise RequestError(f"audio or video doesn't match output {name}")
        if transition is not None:
            checked_transition(**transition)
        mixed = {i: checked_volume(v) for i, v in (volumes or {}).items()}
        if at < received and policy != "always" and not self.run_late:
            return False
        if scene is not None:
            output.versions.append((at, scene))
        output.volumes.update(mixed)
        return True

    def set_volume(self, name: str, input_id: str, volume: float = 1.0) -> None:
        self._output(name).volumes[input_id] = checked_volume(volume)

    def request_key_frame(self, name: str) -> None:
        """Ask an output's encoder for a key frame: an event that its writer reads."""
        if not self._output(name).video:
            raise RequestError(f"output {name} has no video")
        self._emit("key_frame_requested", name)

    def register_asset(self, kind: str, name: str, asset: object) -> None:
        """Images, shaders, web pages and fonts by name."""
        if kind not in ("image", "shader", "web_renderer", "font"):
            raise RequestError(f"unknown kind {kind}")
        if (kind, name) in self._assets:
            raise RequestError(f"{kind} {name} is registered")
        self._assets[kind, name] = asset

    def unregister_asset(self, kind: str, name: str) -> None:
        if self._assets.pop((kind, name), None) is None:
            raise RequestError(f"no {kind} {name}")

    def tap(self, name: str, offset: int = 0) -> DataFrame:
        """A copy of an input before the queue uses it, times from the start on."""
        if name not in self._inputs:
            raise RequestError(f"no input {name}")
        return sinks.tapped(self._inputs[name], offset, self._started or 0)

    def write(self, rows: DataFrame, kind: str, **options) -> object:
        return sinks.open_sink(kind, rows, **options)

    def start(self, pts: int = 0) -> None:
        if self._started is not None:
            raise RequestError("started already")
        self._started = pts
        self._emit("started", "", pts)

    def status(self) -> dict:
        return {"started": self._started is not None, "inputs": sorted(self._inputs), "outputs": sorted(self._outputs)}

    def events(self, after: int = 0) -> DataFrame:
        """All events in order, or those after the first ``after``, as a follower reads them."""
        return self.spark.createDataFrame([(i, *e) for i, e in enumerate(self._events)][after:], "nth long, pts long, kind string, name string")

    def frames(self) -> DataFrame:
        out = None
        for rows in self._inputs.values():
            rows = rows.select("input_id", "frame_id", "pts")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "input_id string, frame_id long, pts long")

    def shown(self, until: int, **rules) -> DataFrame:
        """Frames of all inputs in each slot from the start on."""
        slots = clock.slot_grid(self.spark, self._started or 0, until, self.num, self.den)
        return align.sample_frames(self.frames(), slots, **rules)

    def scenes(self, until: int) -> DataFrame:
        """The scene of each output in each slot."""
        rows = [(o, at, i, s) for o, x in self._outputs.items() for i, (at, s) in enumerate(x.versions)]
        versions = self.spark.createDataFrame(rows, "output_id string, effective_pts long, version long, scene string")
        slots = clock.slot_grid(self.spark, self._started or 0, until, self.num, self.den).select("slot_pts")
        outputs = self.spark.createDataFrame([(o, x.start_at) for o, x in self._outputs.items()], "output_id string, start_at long")
        return lifecycle.version_at(lifecycle.started(slots, outputs), versions, ["output_id"], ["scene"])

    def ends(self) -> DataFrame:
        rows = [(o, x.condition, list(x.inputs)) for o, x in self._outputs.items()]
        outputs = self.spark.createDataFrame(rows, "output_id string, condition string, inputs array<string>")
        return lifecycle.ends(outputs, self.frames().groupBy("input_id").agg(F.max("pts").alias("end_pts")))

    def mixed(self, samples: DataFrame) -> DataFrame:
        rows = [(o, i, float(v)) for o, x in self._outputs.items() for i, v in x.volumes.items()]
        volumes = self.spark.createDataFrame(rows, "output_id string, input_id string, volume double")
        return mix.weighted_sum(samples, volumes)

    def stats(self) -> DataFrame:
        f = self.frames()
        return stats.report(stats.counters(f, ["input_id"], {}), ["input_id"], [stats.frame_rate(f, ["input_id"], "pts")])

    def snapshot(self, measured: DataFrame, time: str, now: int) -> DataFrame:
        """Rates and buffers of all references as one document each."""
        return stats.snapshot(stats.protocol_report(measured, time, now))
