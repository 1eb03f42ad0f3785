"""Live frame gating as keyed state."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from labelwise.functions import fixed as K
from labelwise.operators import live as B
from labelwise.sources.readers import FRAMES

OUT = (
    "cam string, seq long, ts timestamp, detected boolean, n_classes int, fps double, "
    "captured boolean, best_seq long, best_sharpness double, error string, "
    "frames long, detect_calls long, captures long"
)
STATE = (
    "last_detect long, classes array<string>, error string, last_capture long, "
    "arrivals array<long>, ring_seq array<long>, ring_sharp array<double>, "
    "frames long, detect_calls long, captures long"
)
EMPTY = (None, [], None, None, [], [], [], 0, 0, 0)


def read_stream(spark, path: str, schema=FRAMES, files: int = 64) -> DataFrame:
    """Frame files (or others, by their schema) as a stream, a few files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def advance(cam: str, state: tuple, frames: pd.DataFrame, gap: int, cool: int, floor: float, min_classes: int) -> tuple[tuple, pd.DataFrame]:
    """One camera's next frames in order: its new state (bounded rings and a few scalars) and a status for each."""
    state, rows = statuses(cam, state, frames.sort_values(["us", "seq"]).itertuples(index=False), gap, cool, floor, min_classes)
    return state, status_table(rows)


def status_table(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in OUT.split(",")])
    out["best_seq"] = out["best_seq"].astype("Int64")
    return out


def statuses(cam: str, state: tuple, frames: Iterable, gap: int, cool: int, floor: float, min_classes: int) -> tuple[tuple, list[tuple]]:
    """``advance`` over one camera's frames, sorted rows with ``us, seq, ts, sharpness, classes, det_error``."""
    last, classes, error, shot, arrivals, ring_seq, ring_sharp, count, calls, shots = state
    classes, arrivals, ring_seq, ring_sharp = list(classes), list(arrivals), list(ring_seq), list(ring_sharp)
    rows = []
    for r in frames:
        count += 1
        arrivals = [*arrivals, r.us][-K.RATE_FRAMES:]
        run = error is None and (last is None or r.us - last >= gap)
        if run:
            calls, last = calls + 1, r.us
            bad = isinstance(r.det_error, str)
            error = r.det_error if bad else None
            classes = [] if bad else sorted(set(r.classes))
        ring_seq = [*ring_seq, r.seq][-K.RECENT_FRAMES:]
        ring_sharp = [*ring_sharp, r.sharpness][-K.RECENT_FRAMES:]
        span = (arrivals[-1] - arrivals[0]) / B.US
        fire = (shot is None or r.us - shot >= cool) and r.sharpness >= floor and len(classes) >= min_classes
        best = max(range(len(ring_sharp)), key=lambda i: ring_sharp[i])
        if fire:
            shot, shots = r.us, shots + 1
        rows.append((
            cam, r.seq, r.ts, run, len(classes), (len(arrivals) - 1) / span if span > 0 else 0.0,
            fire, ring_seq[best] if fire else None, ring_sharp[best] if fire else None, error, count, calls, shots,
        ))
    return (last, classes, error, shot, arrivals, ring_seq, ring_sharp, count, calls, shots), rows


def gate(interval_s: float, cooldown_s: float, floor: float, min_classes: int) -> Callable:
    """State transition over one camera's new frames."""
    gap, cool = round(interval_s * B.US), round(cooldown_s * B.US)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else EMPTY
        held, out = advance(key[0], held, pd.concat(list(batches), ignore_index=True), gap, cool, floor, min_classes)
        state.update(held)
        yield out

    return step


def live_status(
    frames: DataFrame,
    interval_s: float = K.DETECT_INTERVAL_S,
    cooldown_s: float = K.CAPTURE_COOLDOWN_S,
    floor: float = K.SHARPNESS_FLOOR,
    min_classes: int = K.MIN_CLASSES,
) -> DataFrame:
    """Stream of frame statuses: throttle, carry-forward, rate, capture, counters."""
    keyed = frames.withColumn("us", B.micros(F.col("ts"))).select(
        "cam", "ts", "us", "seq", "sharpness", "classes", "det_error"
    )
    return keyed.groupBy("cam").applyInPandasWithState(
        gate(interval_s, cooldown_s, floor, min_classes),
        OUT, STATE, "append", GroupStateTimeout.NoTimeout,
    )


# --- frames that come late --------------------------------------------------

HELD = "cam string, us long, seq long, ts timestamp, sharpness double, classes array<string>, det_error string"
ORDERED = OUT + ", late boolean, late_frames long"
#: Cameras are dealt into so many buckets: a call for each costs far more than its few frames.
BUCKETS = 256


def _names(ddl: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in ddl.split(",")]


Frame = namedtuple("Frame", _names(HELD))


class Reorder(StatefulProcessor):
    """Holds the frames of a bucket of cameras until the watermark has passed them, and gates each camera's in the order of
    their time.

    A frame older than the watermark when it comes is not gated; it goes out as ``late`` with its camera's count
    of late frames so far.  What is held is bounded by the frames within the watermark's delay.
    """

    def __init__(self, interval_s: float, cooldown_s: float, floor: float, min_classes: int) -> None:
        self.rule = (round(interval_s * B.US), round(cooldown_s * B.US), floor, min_classes)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.gates = handle.getListState("gates", "cam string, " + STATE)
        self.late = handle.getListState("late", "cam string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        gone, held = [], []
        for frames in rows:
            for r in frames[_names(HELD)].itertuples(index=False):
                cam, error = (x if isinstance(x, str) else None for x in (r.cam, r.det_error))
                if mark > 0 and r.us <= mark:
                    gone.append((int(r.us), int(r.seq), cam, r.ts))
                else:
                    held.append((cam, int(r.us), int(r.seq), r.ts.to_pydatetime(), float(r.sharpness), list(r.classes), error))
        if gone:
            counts = {r[0]: r[1] for r in self.late.get()} if self.late.exists() else {}
            told = []
            for _, seq, cam, ts in sorted(gone, key=lambda g: g[:2]):
                counts[cam] = counts.get(cam, 0) + 1
                told.append((cam, seq, ts, counts[cam]))
            self.late.put(list(counts.items()))
            out = pd.DataFrame(told, columns=["cam", "seq", "ts", "n"])
            yield self._told(out.drop(columns="n"), True, out["n"])
        if held:
            self.held.appendList(held)
            # one timer per bucket and batch: the watermark passes its oldest frame first, and comes back for the rest
            self.handle.registerTimer(max(h[1] for h in held) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [Frame(*r) for r in self.held.get()]
        rest = [tuple(f) for f in held if f.us > mark]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        due: dict[str | None, list[Frame]] = {}
        for f in sorted((f for f in held if f.us <= mark), key=lambda f: (f.us, f.seq)):
            due.setdefault(f.cam, []).append(f)
        if due:
            gates = {r[0]: tuple(r)[1:] for r in self.gates.get()} if self.gates.exists() else {}
            out = []
            for cam, frames in due.items():
                gates[cam], said = statuses(cam, gates.get(cam, EMPTY), frames, *self.rule)
                out += said
            self.gates.put([(cam, *g) for cam, g in gates.items()])
            yield self._told(status_table(out), False, None)

    def _told(self, out: pd.DataFrame, late: bool, counts) -> pd.DataFrame:
        told = out.assign(late=late, late_frames=None if counts is None else list(counts)).reindex(columns=_names(ORDERED))
        # plain objects: Arrow-backed strings come in chunks, which a struct column does not take
        return told.astype(object)


def ordered_status(
    frames: DataFrame,
    late: str,
    interval_s: float = K.DETECT_INTERVAL_S,
    cooldown_s: float = K.CAPTURE_COOLDOWN_S,
    floor: float = K.SHARPNESS_FLOOR,
    min_classes: int = K.MIN_CLASSES,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``live_status`` of frames that arrive out of order by up to ``late``, and what came later than that.

    The watermark moves by ``ts``, but that column goes no further: Spark would drop late rows before the operator
    sees them, and here they are to be told.
    """
    marked = frames.withWatermark("ts", late)
    keyed = marked.withColumn("us", B.micros(F.col("ts"))).select(
        "cam", "us", "seq", F.timestamp_micros("us").alias("ts"), "sharpness", "classes", "det_error",
        F.pmod(F.xxhash64("cam"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    return keyed.groupBy("bucket").transformWithStateInPandas(
        Reorder(interval_s, cooldown_s, floor, min_classes), ORDERED, "Append", "EventTime"
    )


# --- captures handed over once ----------------------------------------------

HANDED = "cam string, seq long, ts timestamp, drain long"


class Handover(StatefulProcessor):
    """A ring of a camera's newest captures; a row with ``drain`` hands all of them over and empties it."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "seq long, ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = [tuple(r) for r in self.ring.get()]
        # at one time captures come before the drain
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "drain", "seq"], na_position="first")
        handed = []
        for r in batch.itertuples(index=False):
            if pd.isna(r.drain):
                ring = [*ring, (int(r.seq), r.ts.to_pydatetime())][-self.keep:]
            else:
                handed += [(key[0], seq, ts, int(r.drain)) for seq, ts in ring]
                ring = []
        if ring:
            self.ring.put(ring)
        else:
            self.ring.clear()
        yield pd.DataFrame(handed, columns=["cam", "seq", "ts", "drain"])


def handed_over(captures: DataFrame, keep: int = K.CAPTURE_KEEP) -> DataFrame:
    """From a stream of ``cam, seq, ts, drain``: captures (null ``drain``) as a drain hands them over, each at most once.

    Between drains at most the newest ``keep`` of a camera stay.  The stream comes in the order of ``ts``.
    """
    return captures.select("cam", "seq", "ts", "drain").groupBy("cam").transformWithStateInPandas(
        Handover(keep), HANDED, "Append", "None"
    )


def stateful(spark) -> None:
    """List state and timers live in the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def captures(frames: DataFrame, **settings) -> DataFrame:
    return live_status(frames, **settings).where("captured")


def windows(frames: DataFrame, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Event-time windows with a watermark; later frames are dropped."""
    return B.frame_windows(frames.withWatermark("ts", late), size, slide)


def sessions(frames: DataFrame, late: str, gap: str) -> DataFrame:
    return B.frame_sessions(frames.withWatermark("ts", late), gap)


def serve_latest(frames: DataFrame, path: str, checkpoint: str):
    """Serve only the newest frame of each micro-batch; the backlog is counted and dropped.

    An epoch has a folder of its own, so one that is tried again writes the same rows once.
    """
    return _by_epoch(frames.writeStream, B.latest_only, path, checkpoint)


def serve_rows(stream: DataFrame, path: str, checkpoint: str, after: Callable[[int], None] | None = None):
    """Every row once, however often the stream stops: an epoch has a folder of its own, which a repeated epoch writes
    anew, and the checkpoint says where to go on.  ``after`` is called when an epoch's folder is written."""
    return _by_epoch(stream.writeStream, lambda rows: rows, path, checkpoint, after)


def serve_updates(stream: DataFrame, path: str, checkpoint: str):
    """Rows of an aggregate as they change, a folder for each epoch; windows still open at the end are there too."""
    return _by_epoch(stream.writeStream.outputMode("update"), lambda rows: rows, path, checkpoint)


def newest_updates(spark, path: str, schema, keys: list[str]) -> DataFrame:
    """The last state of each key that ``serve_updates`` wrote."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(path)
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v")).select(*keys, "_v.*").drop("epoch")


def _by_epoch(
    writer, rows: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, after: Callable[[int], None] | None = None
):
    def write(batch: DataFrame, epoch: int) -> None:
        rows(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        if after:
            after(epoch)

    return writer.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """Append to files; the checkpoint makes each row arrive once and resumes after a stop."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
