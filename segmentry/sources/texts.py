"""Text and JSON sources: scene lists, packets, probes, metric output. Each takes a DataFrame with the raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.functions.rules import rate
from segmentry.operators import ordered

from .tables import near, settled

# Patterns of scene lines and of the encoder's metric output.
SCENE = r"frames \[\s*(\d+),\s*(\d+)\)"
SSIM = r"(?i)SSIM\s+YUV:\s*([\d.]+)\s*\([\d.]+\),.*?All:\s*([\d.]+)\s*\(([\d.]+)\)"
PSNR = r"(?i)PSNR\s+YUV:\s*([\d.]+),.*?Avg:\s*([\d.]+)"
PROBE = "streams array<struct<width:int,height:int,avg_frame_rate:string,r_frame_rate:string>>, format struct<duration:string>"
AUDIO = "streams array<struct<index:int,codec_name:string,profile:string,channels:int,channel_layout:string>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of each line; _metadata keeps files apart."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def scene_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """df's lines that name a scene, with start_frame and end_frame."""
    part = [F.regexp_extract(column, SCENE, i).cast("long") for i in (1, 2)]
    return df.filter(F.col(column).rlike(SCENE)).withColumns({"start_frame": part[0], "end_frame": part[1]})


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(path, start_frame, end_frame) of the scene lists at path; ValueError where no line names a scene."""
    found = scene_lines(lines(spark, path)).drop("value")
    if not found.limit(1).count():
        raise ValueError(f"no scene in {path}")
    return found


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of each file with their numbers from 0, however many splits a file is read in.

    A split is read in order by one task, so a line's place in it is the difference of row ids, and the splits' line counts, by
    where they begin in the file, give the rest.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), "value", F.monotonically_increasing_id().alias("_at"))
    rows = settled(rows, "lines")
    splits = rows.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    shifts = settled(splits.select("path", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "splits")
    return rows.join(near(shifts), ["path", "_block"]).select("path", (F.col("_at") + F.col("_shift")).alias("line"), "value")


def ordered_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(path, scene, start_frame, end_frame) of the scene lists at path, numbered in the order of their lines; ValueError where no line names a scene."""
    found = settled(scene_lines(numbered_lines(spark, path)).select("path", "line", "start_frame", "end_frame", F.floor(F.col("line") / 65536).alias("_bucket")), "scene-lines")
    if not found.limit(1).count():
        raise ValueError(f"no scene in {path}")
    return ordered.position(found, ["path"], ["line"], "_bucket", "scene").select("path", "scene", "start_frame", "end_frame")


def metric_values(df: DataFrame, column: str = "value") -> DataFrame:
    """df with ssim_y, ssim_all, ssim_db, psnr_y, psnr_avg; null where the text has none."""
    def groups(pattern: str, n: int) -> Column:
        # the first match, cut out once and turned into its groups
        return F.split(F.regexp_replace(F.regexp_extract(column, pattern, 0), pattern, "|".join(f"${i + 1}" for i in range(n))), "\\|")

    found = df.withColumns({"_ssim": groups(SSIM, 3), "_psnr": groups(PSNR, 2)})
    at = {"ssim_y": ("_ssim", 0), "ssim_all": ("_ssim", 1), "ssim_db": ("_ssim", 2), "psnr_y": ("_psnr", 0), "psnr_avg": ("_psnr", 1)}
    return found.withColumns({c: F.get(of, F.lit(i)).try_cast("double") for c, (of, i) in at.items()}).drop("_ssim", "_psnr")


def keyframes(packets: DataFrame, fps: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """(frame, pts_time) of packets (pts_time, flags as text) that are keyframes, in a window of times if given."""
    t = F.col("pts_time").try_cast("double")
    rows = packets.filter(F.contains("flags", F.lit("K")) & t.isNotNull())
    if low is not None:
        rows = rows.filter(t >= max(0.0, low))
    if high is not None:
        rows = rows.filter(t <= high)
    return rows.select(*(c for c in packets.columns if c not in ("pts_time", "flags")), F.rint(t * fps).cast("long").alias("frame"), t.alias("pts_time"))


def without_first(table: DataFrame, by: str) -> DataFrame:
    """(by) of the sources in a keyframe table whose frame 0 is none of them."""
    return table.groupBy(by).agg(F.min("frame").alias("_first")).filter("_first <> 0").select(by)


def require_first(table: DataFrame, by: str) -> DataFrame:
    """The table; ValueError where a source in it has no keyframe at frame 0."""
    bad = without_first(table, by).limit(1).collect()
    if bad:
        raise ValueError(f"no keyframe at frame 0: {bad[0][0]}")
    return table


def probe(df: DataFrame, column: str = "value") -> DataFrame:
    """df with width, height, frame_rate and duration_sec of its first stream; a frame_rate of null is for the caller to reject."""
    rows = df.withColumn("_p", F.from_json(column, PROBE)).withColumn("_s", F.get("_p.streams", F.lit(0)))
    out = {"width": F.col("_s.width"), "height": F.col("_s.height"), "frame_rate": F.coalesce(rate(F.col("_s.avg_frame_rate")), rate(F.col("_s.r_frame_rate"))), "duration_sec": F.col("_p.format.duration").try_cast("double")}
    return rows.withColumns(out).drop("_p", "_s")


def audio_streams(df: DataFrame, column: str = "value") -> DataFrame:
    """df with a row for each audio stream: number and its fields (null for none)."""
    return df.withColumn("_a", F.from_json(column, AUDIO)).select(*df.columns, F.posexplode_outer("_a.streams").alias("number", "_s")).select(*df.columns, "number", "_s.*")


def packet_count(column: Column) -> Column:
    """The number that a packet count prints; -1 for anything but digits."""
    text = F.regexp_replace(F.regexp_replace(column, r"^\s+|\s+$", ""), ",+$", "")
    return F.coalesce(F.when(text.rlike(r"^[0-9]+$"), text.try_cast("long")), F.lit(-1))


def hdr_probe(df: DataFrame, column: str = "value") -> DataFrame:
    """df with transfer (the first stream's, up to a comma) and side_data (the first frame's list of side data, as text, however nested) of probe output in JSON; null where there is none, or no JSON."""
    probed = F.try_parse_json(column)
    transfer = F.trim(F.split_part(F.try_variant_get(probed, "$.streams[0].color_transfer", "string"), F.lit(","), F.lit(1)))
    return df.withColumns({"transfer": transfer, "side_data": F.to_json(F.try_variant_get(probed, "$.frames[0].side_data_list", "variant"))})
