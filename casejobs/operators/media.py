"""Video frames and telemetry."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.naming import frame_name
from ..session import scratch


#: A video with more frames than that, and with more than one of so many of all frames, is hot: there are fewer hot videos
#: than the latter number.
HOT_FRAMES, HOT_SHARE = 1_000_000, 1000


def number_frames(frames: DataFrame, video: str = "video_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Frame numbers from 0 in each video, by the order's columns. Frames without a video are numbered as one.

    Videos are counted first. The frames of a hot one are not numbered in one task but in ranges of the order.
    """
    counts = frames.groupBy(video).agg(F.count("*").alias("n"))
    total = frames.count()
    hot = [r[0] for r in counts.where(F.col("n") > max(HOT_FRAMES, total // HOT_SHARE)).select(video).collect()]  # fewer than HOT_SHARE
    if not hot:
        return _numbered(frames, video, order)
    known = F.lit(False) if hot == [None] else F.coalesce(F.col(video).isin([v for v in hot if v is not None]), F.lit(False))
    among = known | F.col(video).isNull() if None in hot else known
    return _numbered(frames.where(~among), video, order).unionByName(_numbered_in_ranges(frames.where(among), video, order))


def _numbered(frames: DataFrame, video: str, order: tuple[str, ...]) -> DataFrame:
    return frames.withColumn("frame_no", (F.row_number().over(Window.partitionBy(video).orderBy(*order)) - 1).cast("bigint"))


def _numbered_in_ranges(frames: DataFrame, video: str, order: tuple[str, ...]) -> DataFrame:
    """Numbers within ranges of (video, order), and the counts of the video's earlier ranges added.

    The dealt rows are written to the shared folder, so that both steps and a task that is run again see the same ranges.
    Only the first video of a range can have frames in earlier ones, so no more rows than ranges are broadcast.
    """
    path = scratch(frames.sparkSession, "frames")
    frames.select(F.struct("*").alias("frame")).repartitionByRange(*(F.col(f"frame.{c}") for c in (video, *order))).withColumn("range", F.spark_partition_id()).write.parquet(path)
    dealt = frames.sparkSession.read.parquet(path).withColumn("video", F.col(f"frame.{video}"))
    earlier = Window.partitionBy("video").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("video", "range").agg(F.count("*").alias("n"))
    before = counts.select("video", "range", F.sum("n").over(earlier).alias("before")).where("before > 0")
    same = dealt["video"].eqNullSafe(before["video"]) & (dealt["range"] == before["range"])
    within = Window.partitionBy(dealt["range"], dealt["video"]).orderBy(*(F.col(f"frame.{c}") for c in order))
    number = F.row_number().over(within) - 1 + F.coalesce("before", F.lit(0))
    return dealt.join(F.broadcast(before), same, "left").select("frame.*", number.cast("bigint").alias("frame_no"))


def sample_frames(frames: DataFrame, stride: int = C.FRAME_STRIDE) -> DataFrame:
    """Every ``stride``-th frame, from the first on, with its file name."""
    return frames.where(F.pmod("frame_no", F.lit(stride)) == 0).withColumn("frame_name", frame_name(F.col("frame_no")))


def frame_report(frames: DataFrame, stride: int = C.FRAME_STRIDE) -> DataFrame:
    saved = F.count_if(F.pmod("frame_no", F.lit(stride)) == 0)
    return frames.groupBy("video_id").agg(F.count("*").alias("total_frames"), saved.alias("saved_frames"))


def hud_parallax(telemetry: DataFrame) -> DataFrame:
    """Metres, corrected speed, and the constants that go with them, from altitude_ft, azimuth and speed_kn."""
    speed = F.col("speed_kn")
    return telemetry.withColumns({
        "altitude_m": F.bround(F.col("altitude_ft") * 0.3048, 2), "azimuth_deg": F.col("azimuth"),
        "true_speed_knots": F.bround(speed - speed * 0.05, 2), "parallax_anomaly": F.lit(True), "note": F.lit(C.HUD_NOTE),
    })
