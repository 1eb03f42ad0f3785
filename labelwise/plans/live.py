"""Live frame queries: batch twins, and streams run to completion over the events."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwise.functions import predicates as Q
from labelwise.operators import live as V
from labelwise.plans import bindings as B
from labelwise.plans.bindings import with_cte
from labelwise.session import shared_dir, written
from labelwise.sources.readers import FRAMES
from labelwise.streaming import frames as T

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


HOUR = 3600.0
SETTINGS = {"interval_s": HOUR, "cooldown_s": 6 * HOUR, "floor": 100.0, "min_classes": 3}

RANKED = """
  , f AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY cam ORDER BY ts, seq) AS rn FROM frames),
  nx AS (SELECT a.cam, a.rn, min(b.rn) AS n FROM f a JOIN f b ON a.cam = b.cam AND b.us >= a.us + 3600000000 GROUP BY 1, 2),
  acc AS (SELECT cam, CAST(1 AS BIGINT) AS rn FROM f WHERE rn = 1
    UNION ALL SELECT acc.cam, nx.n FROM acc JOIN nx ON nx.cam = acc.cam AND nx.rn = acc.rn),
  br AS (SELECT f.cam, min(f.rn) AS b FROM f JOIN acc ON f.cam = acc.cam AND f.rn = acc.rn WHERE det_error IS NOT NULL GROUP BY 1),
  t AS (SELECT f.*, acc.rn IS NOT NULL AND (br.b IS NULL OR f.rn <= br.b) AS accepted FROM f
    LEFT JOIN acc ON acc.cam = f.cam AND acc.rn = f.rn LEFT JOIN br ON br.cam = f.cam),
  l AS (SELECT *, coalesce(last_value(CASE WHEN accepted THEN CASE WHEN det_error IS NOT NULL THEN 0 ELSE n_det END END IGNORE NULLS)
      OVER (PARTITION BY cam ORDER BY rn), 0) AS live_n FROM t)"""
CAPTURED = RANKED + """,
  e AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY rn) AS er FROM l WHERE sharpness >= 100 AND live_n >= 3),
  en AS (SELECT a.cam, a.er, min(b.er) AS n FROM e a JOIN e b ON a.cam = b.cam AND b.us >= a.us + 21600000000 GROUP BY 1, 2),
  cp AS (SELECT cam, CAST(1 AS BIGINT) AS er FROM e WHERE er = 1
    UNION ALL SELECT cp.cam, en.n FROM cp JOIN en ON en.cam = cp.cam AND en.er = cp.er),
  s AS (SELECT e.* FROM e JOIN cp ON cp.cam = e.cam AND cp.er = e.er),
  bs AS (SELECT s.cam, s.seq, arg_max(f.seq, f.sharpness * 1000 - f.rn * 1e-6) AS best_seq, max(f.sharpness) AS best_sharpness
    FROM s JOIN f ON f.cam = s.cam AND f.rn BETWEEN s.rn - 9 AND s.rn GROUP BY 1, 2)"""


def sql(cte: str, body: str) -> str:
    return with_cte("frames", cte.strip() + body).replace("\n, f AS", ", f AS")


@query("detect_throttle", sql(RANKED, " SELECT cam, seq FROM t WHERE accepted"))
def detect_throttle(spark, sf):
    return V.detect_throttle(B.frames(spark, sf), HOUR).where("accepted").select("cam", "seq")


@query("carry_forward", sql(RANKED, " SELECT cam, seq, CAST(live_n AS INTEGER) AS live_n FROM l"))
def carry_forward(spark, sf):
    return V.carry_detections(V.detect_throttle(B.frames(spark, sf), HOUR)).select("cam", "seq", "live_n")


@query("sticky_error", sql(RANKED, """ SELECT cam, count(*) AS frames_after FROM l
    WHERE rn >= (SELECT b FROM br WHERE br.cam = l.cam) GROUP BY cam"""))
def sticky_error(spark, sf):
    t = V.detect_throttle(B.frames(spark, sf), HOUR).where("sticky_error is not null")
    return t.groupBy("cam").agg(F.count("*").alias("frames_after"))


@query("frame_rate", with_cte("frames", """
  SELECT cam, seq, round(CASE WHEN epoch_us(ts) > epoch_us(first_value(ts) OVER w) THEN (count(*) OVER w - 1) * 1e6
      / (epoch_us(ts) - epoch_us(first_value(ts) OVER w)) ELSE 0 END, 9) AS fps
  FROM frames WINDOW w AS (PARTITION BY cam ORDER BY ts, seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def frame_rate(spark, sf):
    return V.frame_rate(B.frames(spark, sf)).select("cam", "seq", F.round("fps", 9).alias("fps"))


@query("sharpest_recent", with_cte("frames", """
  SELECT cam, seq, max(sharpness) OVER w AS best_sharpness FROM frames
  WINDOW w AS (PARTITION BY cam ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def sharpest_recent(spark, sf):
    return V.sharpest_recent(V.ranked_frames(B.frames(spark, sf))).select("cam", "seq", "best_sharpness")


def shots(spark, sf) -> DataFrame:
    return V.auto_capture(B.frames(spark, sf), **SETTINGS)


@query("auto_capture", sql(CAPTURED, " SELECT cam, seq, best_seq, best_sharpness FROM bs"))
def auto_capture(spark, sf):
    return shots(spark, sf).select("cam", "seq", "best_seq", "best_sharpness")


@query("capture_buffer", sql(CAPTURED, """ SELECT cam, seq FROM (SELECT cam, seq, row_number() OVER (PARTITION BY cam
    ORDER BY ts DESC, seq DESC) AS r FROM s) WHERE r <= 6"""))
def capture_buffer(spark, sf):
    return V.capture_buffer(shots(spark, sf)).select("cam", "seq")


@query("frame_counters", sql(CAPTURED, """ SELECT cam, count(*) AS frames, count_if(accepted) AS detect_calls,
    (SELECT count(*) FROM s WHERE s.cam = t.cam) AS captures FROM t GROUP BY cam"""))
def frame_counters(spark, sf):
    return V.frame_counters(V.detect_throttle(B.frames(spark, sf), HOUR), shots(spark, sf))


@query("latest_only", with_cte("frames", """ SELECT cam, max(seq) AS seq, arg_max(sharpness, seq) AS sharpness,
    count(*) - 1 AS dropped FROM frames GROUP BY cam"""))
def latest_only(spark, sf):
    return V.latest_only(B.frames(spark, sf))


@query("capture_hints", with_cte("frames", """
  SELECT seq, CASE WHEN sharpness < 180 THEN 'very_blurred' WHEN sharpness < 300 THEN 'soft' ELSE 'sharp' END AS focus,
    CASE WHEN det_error IS NOT NULL THEN concat('Detector unavailable: ', det_error)
      WHEN sharpness < 180 THEN 'Very blurred - hold the phone still and let the camera focus.'
      WHEN sharpness < 300 THEN 'Slightly soft - steady the pack or add light before capturing.'
      WHEN n_det = 0 THEN 'No statutory panel found - bring the printed label into frame.'
      WHEN n_det < 3 THEN concat('Only ', n_det, ' of 7 panels visible - move closer or rotate the pack; missing: ',
        CASE n_det WHEN 1 THEN 'net_quantity, mrp_declaration, date_declarations.' ELSE 'mrp_declaration, date_declarations, batch_number.' END)
      WHEN width = 480 THEN 'Camera is streaming a low resolution; small print will not be readable.'
      ELSE 'Good frame - capture now.' END AS hint FROM frames"""))
def capture_hints(spark, sf):
    c = F.col
    hints = Q.capture_hints(c("det_error"), F.lit(1), c("sharpness"), c("n_det"), c("classes"), c("width"), c("height"))
    return B.frames(spark, sf).select("seq", Q.focus_gate(c("sharpness")).alias("focus"), F.get(hints, F.lit(0)).alias("hint"))


@query("frame_windows", with_cte("frames", """ SELECT cam, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us,
    count(*) AS frames, max(sharpness) AS sharpest FROM frames GROUP BY 1, 2"""))
def frame_windows(spark, sf):
    w = V.frame_windows(B.frames(spark, sf), "1 day")
    return w.select("cam", F.unix_micros("start").alias("start_us"), "frames", "sharpest")


@query("frame_sliding_windows", with_cte("frames", """ SELECT cam, epoch_us(time_bucket(INTERVAL 12 HOUR, ts) - o * INTERVAL 12 HOUR) AS start_us,
    count(*) AS frames FROM frames, (VALUES (0), (1)) AS v(o) GROUP BY 1, 2"""))
def frame_sliding_windows(spark, sf):
    w = V.frame_windows(B.frames(spark, sf), "1 day", "12 hours")
    return w.select("cam", F.unix_micros("start").alias("start_us"), "frames")


@query("frame_sessions", with_cte("frames", """
  SELECT cam, min(us) AS start_us, count(*) AS frames FROM (SELECT cam, us, sum(brk) OVER (PARTITION BY cam ORDER BY us) AS s FROM
    (SELECT cam, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY cam ORDER BY ts) < 43200000000
      THEN 0 ELSE 1 END AS brk FROM frames)) GROUP BY cam, s"""))
def frame_sessions(spark, sf):
    w = V.frame_sessions(B.frames(spark, sf), "12 hours")
    return w.select("cam", F.unix_micros("start").alias("start_us"), "frames")


# --- streams ----------------------------------------------------------------


def frame_stream(spark, sf) -> DataFrame:
    """The events as a stream of frame files, written once in the shared folder."""
    path = shared_dir(spark, "frames")
    frames = B.frames(spark, sf).select("cam", "ts", "seq", "sharpness", "width", "height", "classes", "n_det", "det_error")
    frames.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(path)
    return T.read_stream(spark, path)


def run(spark, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into files and read them back."""
    out, mark = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    T.append_once(stream, out, mark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_auto_capture", sql(CAPTURED, " SELECT cam, seq, best_seq, best_sharpness FROM bs"))
def stream_auto_capture(spark, sf):
    got = run(spark, T.captures(frame_stream(spark, sf), **SETTINGS), "captures")
    return got.select("cam", "seq", "best_seq", "best_sharpness")


@query("stream_frame_windows", with_cte("frames", """
  SELECT cam, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS frames FROM frames GROUP BY 1, 2"""))
def stream_frame_windows(spark, sf):
    out, mark = shared_dir(spark, "windows"), shared_dir(spark, "windows-state")
    windows = T.windows(frame_stream(spark, sf), "1 hour", "1 day")
    T.serve_updates(windows, out, mark).awaitTermination()
    got = T.newest_updates(spark, out, windows.schema, ["cam", "start"])
    return got.select("cam", F.unix_micros("start").alias("start_us"), "frames")


@query("stream_latest_only", with_cte("frames", """
  SELECT cam, max(seq) AS seq, arg_max(sharpness, seq) AS sharpness, count(*) AS frames FROM frames GROUP BY cam"""))
def stream_latest_only(spark, sf):
    """What was served last, and how many frames were served or dropped, however the stream was cut into batches."""
    out, mark = shared_dir(spark, "latest"), shared_dir(spark, "latest-state")
    T.serve_latest(frame_stream(spark, sf), out, mark).awaitTermination()
    served = spark.read.parquet(out).groupBy("cam")
    return served.agg(
        F.max("seq").alias("seq"), F.max_by("sharpness", "seq").alias("sharpness"), F.sum(F.col("dropped") + 1).alias("frames")
    )


# --- late frames, handovers, resuming ---------------------------------------


def numbered_files(spark, rows: DataFrame, part, path: str, schema: str, files: int = 1) -> DataFrame:
    """``rows`` as a stream of one file for each value of ``part``, in that order."""
    rows = written(rows.withColumn("_part", part))  # or every file would make all rows again
    names = [r[0] for r in rows.select("_part").distinct().orderBy("_part").collect()]
    for n in names:  # files are streamed by the time they were written
        rows.where(F.col("_part") == n).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return T.read_stream(spark, path, schema, files)


# five files of six days each; a frame is late if the files before its own hold one more than two days newer
LATE = """,
  g AS (SELECT *, epoch_us(ts) // 86400000000 AS day, (SELECT min(epoch_us(ts) // 86400000000) FROM frames) AS d FROM frames),
  m AS (SELECT *, least(4, CASE WHEN seq % 40 = 0 THEN (day - d) // 6 + 1 WHEN seq % 5 = 0 THEN (day + 1 - d) // 6
      ELSE (day - d) // 6 END) AS part FROM g),
  newest AS (SELECT part, max(epoch_us(ts)) // 1000 AS ms FROM m GROUP BY part),
  marks AS (SELECT m.seq, coalesce(max(n.ms) - 172800000, -1) AS mark FROM m LEFT JOIN newest n ON n.part < m.part GROUP BY m.seq),
  lost AS (SELECT m.* FROM m JOIN marks USING (seq) WHERE epoch_us(ts) <= mark * 1000),
  kept AS (SELECT * FROM frames WHERE seq NOT IN (SELECT seq FROM lost))"""


@query("stream_late_frames", sql(LATE + RANKED.replace("FROM frames)", "FROM kept)"), """
  SELECT cam, seq, accepted AS detected, false AS late FROM t UNION ALL SELECT cam, seq, false, true FROM lost"""))
def stream_late_frames(spark, sf):
    """Frames in five files, every fifth a day early or late and every fortieth a file late, read back in the order of time."""
    frames = B.frames(spark, sf).select("cam", "ts", "seq", "sharpness", "width", "height", "classes", "n_det", "det_error")
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    first = frames.agg(F.min(day)).collect()[0][0]
    part = (
        F.when(F.col("seq") % 40 == 0, F.least(F.lit(4), F.floor((day - first) / 6) + 1))
        .when(F.col("seq") % 5 == 0, F.least(F.lit(4), F.floor((day + 1 - first) / 6)))
        .otherwise(F.least(F.lit(4), F.floor((day - first) / 6)))
    )
    path = shared_dir(spark, "late_frames")
    # a last file far ahead moves the watermark past all frames
    end = frames.limit(1).withColumns({"cam": F.lit("end"), "seq": F.lit(-1).cast("long"), "ts": F.col("ts") + F.expr("interval 2000 days")})
    stream = numbered_files(spark, frames.withColumn("part", part).unionByName(end.withColumn("part", F.lit(99).cast("long"))), F.col("part"), path, FRAMES)
    T.stateful(spark)
    got = run(spark, T.ordered_status(stream, "2 days", **SETTINGS), "late")
    return got.where("cam <> 'end'").select("cam", "seq", F.coalesce("detected", F.lit(False)).alias("detected"), "late")


@query("stream_handover", sql(CAPTURED, """,
  n AS (SELECT cam, max(seq) AS last FROM frames GROUP BY cam),
  dr AS (SELECT cam, seq AS drain, ts FROM frames WHERE seq % 300 = 7),
  nextd AS (SELECT s.cam, s.seq, s.ts, (SELECT min((dr.ts, dr.drain)) FROM dr WHERE dr.cam = s.cam AND dr.ts >= s.ts) AS d FROM s)
  SELECT cam, seq, struct_extract(d, 2) AS drain FROM (SELECT *, row_number() OVER (PARTITION BY cam, d ORDER BY ts DESC, seq DESC) AS r FROM nextd
    WHERE d IS NOT NULL) WHERE r <= 6"""))
def stream_handover(spark, sf):
    """Captures and drains as one stream: every drain takes the newest six since the last one, and nothing twice."""
    frames = B.frames(spark, sf)
    drains = frames.where("seq % 300 = 7").select("cam", "seq", "ts", F.col("seq").alias("drain"))
    both = shots(spark, sf).select("cam", "seq", "ts", F.lit(None).cast("long").alias("drain")).unionByName(drains)
    path = shared_dir(spark, "handover")
    part = F.floor(F.unix_micros("ts") / (5 * 86_400_000_000))
    stream = numbered_files(spark, both, part, path, T.HANDED)
    T.stateful(spark)
    return run(spark, T.handed_over(stream), "handed").select("cam", "seq", "drain")


@query("stream_resume", with_cte("log", """
  SELECT image_path, count(*) AS records, max(ln) AS last FROM log GROUP BY image_path"""))
def stream_resume(spark, sf):
    """A stream that is lost after an epoch was written but not yet noted, and started again: each image comes once."""
    path, out, mark = (shared_dir(spark, n) for n in ("images", "images-out", "images-state"))
    images = B.bound(spark, sf, "log").groupBy("image_path").agg(F.count("*").alias("records"), F.max("ln").alias("last"))
    stream = numbered_files(spark, images, F.abs(F.hash("image_path")) % 5, path, "image_path string, records long, last long")

    def lost(epoch: int) -> None:
        if epoch == 2:
            raise RuntimeError("the driver is lost here")

    try:
        T.serve_rows(stream, out, mark, lost).awaitTermination()
    except StreamingQueryException:
        T.serve_rows(stream, out, mark).awaitTermination()
    return spark.read.parquet(out).select("image_path", "records", "last")
