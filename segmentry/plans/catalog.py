"""Named queries over the test tables, each with the SQL that must give the same rows.

Users of `events` stand for sources: a user's events in order are frames, `value` in hundredths is a frame's score, sign-ups
(and frame 0) are keyframes, and frames are 1/24 of a second apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions import rules
from segmentry.operators import metrics, ordered, scenes
from segmentry.sources import texts
from segmentry.sources.tables import finished, settled

FPS = 24.0
GAP = 8
JOBS = 4
BY = ["source_id"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PARTS = {
    "frames": "frames AS (SELECT user_id AS source_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, CAST(round_even(value * 100, 0) AS BIGINT) AS score FROM events)",
    "totals": "totals AS (SELECT source_id, count(*) AS total FROM frames GROUP BY source_id)",
    "cuts": """rolled AS (SELECT *, sum(score) OVER w AS s, count(*) OVER w AS n FROM frames WINDOW w AS (PARTITION BY source_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
cuts AS (SELECT source_id, frame FROM rolled WHERE n = 5 AND score >= 1500 AND 4 * score >= 3 * (s - score))""",
    "scenes": """starts AS (SELECT source_id, 0 AS frame FROM totals UNION SELECT source_id, frame FROM cuts WHERE frame > 0),
scenes AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY frame) - 1 AS scene, frame AS start_frame, coalesce(lead(frame) OVER (PARTITION BY source_id ORDER BY frame), total) AS end_frame FROM starts JOIN totals USING (source_id))""",
    "keys": "keys AS (SELECT source_id, frame FROM frames WHERE event_type = 'signup' OR frame = 0)",
    "based": "based AS (SELECT s.source_id, s.scene, s.start_frame, s.end_frame, max(k.frame) AS key_frame FROM scenes s JOIN keys k ON s.source_id = k.source_id AND k.frame <= s.start_frame GROUP BY ALL)",
    "marks": "marks AS (SELECT source_id, CAST(round_even(total * i / 4.0, 0) AS BIGINT) AS mark FROM totals, (SELECT unnest([1, 2, 3]) AS i))",
}


def _sql(parts: str, body: str) -> str:
    return "WITH " + ",\n".join(_PARTS[p] for p in parts.split()) + "\n" + body


def query(sql: str | None) -> Callable:
    """Registers a query and its SQL. Tables that it settles on the way go with it: only its result is left."""
    def named(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finished(spark, lambda: f(spark, sf_dir), f.__name__)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return named


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", "ts", "event_type", F.rint(F.col("value") * 100).cast("long").alias("score"), F.date_trunc("day", "ts").alias("_day"))
    return ordered.position(e, BY, ["ts", "event_id"], "_day", "frame").drop("_day", "ts")


def _settled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames, made once, for plans whose branches read them several times."""
    return settled(frames(spark, sf_dir), "frames")


def _totals(f: DataFrame) -> DataFrame:
    return f.groupBy("source_id").agg(F.count("*").alias("total"))


def _keys(f: DataFrame) -> DataFrame:
    return f.filter("event_type = 'signup' OR frame = 0").select("source_id", "frame")


def _scenes(f: DataFrame) -> DataFrame:
    return scenes.scenes(scenes.candidate_cuts(f), _totals(f))


def _based(f: DataFrame) -> DataFrame:
    s = _scenes(f).withColumn("frame", F.col("start_frame"))
    k = _keys(f).withColumn("key_frame", F.col("frame"))
    return ordered.as_of(s, k, BY, "frame", ["key_frame"], scenes.PART).drop("frame")


@query(_sql("frames", "SELECT source_id, event_id, frame FROM frames"))
def frame_index(spark, sf_dir):
    return frames(spark, sf_dir).select("source_id", "event_id", "frame")


@query(_sql("frames cuts", "SELECT source_id, frame FROM cuts"))
def candidate_cuts(spark, sf_dir):
    return scenes.candidate_cuts(frames(spark, sf_dir))


@query(_sql("frames totals cuts scenes", "SELECT * FROM scenes"))
def scene_index(spark, sf_dir):
    return _scenes(_settled_frames(spark, sf_dir))


@query("WITH RECURSIVE " + ",\n".join(_PARTS[p] for p in ("frames", "totals", "cuts")) + f""",
kept AS (SELECT source_id, CAST(0 AS BIGINT) AS frame FROM totals UNION ALL
  SELECT k.source_id, (SELECT min(c.frame) FROM cuts c WHERE c.source_id = k.source_id AND c.frame >= k.frame + {GAP}) FROM kept k WHERE k.frame IS NOT NULL)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY frame) - 1 AS scene, frame AS start_frame, coalesce(lead(frame) OVER (PARTITION BY source_id ORDER BY frame), total) AS end_frame
FROM kept JOIN totals USING (source_id) WHERE frame IS NOT NULL""")
def scenes_min_len(spark, sf_dir):
    f = _settled_frames(spark, sf_dir)
    return scenes.scenes(scenes.min_gap(scenes.candidate_cuts(f), GAP), _totals(f))


@query(_sql("frames totals cuts scenes", "SELECT source_id, count(*) AS n_scenes, CAST(sum(end_frame - start_frame) AS BIGINT) AS n_frames, max(end_frame - start_frame) AS longest FROM scenes GROUP BY source_id"))
def scene_summary(spark, sf_dir):
    size = F.col("end_frame") - F.col("start_frame")
    return _scenes(_settled_frames(spark, sf_dir)).groupBy("source_id").agg(F.count("*").alias("n_scenes"), F.sum(size).alias("n_frames"), F.max(size).alias("longest"))


@query(_sql("frames totals cuts scenes keys based", "SELECT source_id, scene, start_frame, key_frame FROM based"))
def scene_keyframe_asof(spark, sf_dir):
    return _based(_settled_frames(spark, sf_dir)).select("source_id", "scene", "start_frame", "key_frame")


@query(_sql("frames totals cuts scenes keys based", """, ms AS (SELECT *, CAST(floor(key_frame / 24.0 * 1000) AS BIGINT) AS ms FROM based)
SELECT source_id, scene, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS seek, (start_frame - key_frame) || ':' || (end_frame - 1 - key_frame) AS trim FROM ms"""))
def seek_trim(spark, sf_dir):
    b = _based(_settled_frames(spark, sf_dir))
    return b.select("source_id", "scene", rules.seek(F.col("key_frame") / F.lit(FPS)).alias("seek"), rules.trim(F.col("start_frame"), F.col("end_frame"), F.col("key_frame")).alias("trim"))


@query(_sql("frames cuts keys", "SELECT c.source_id, c.frame, arg_min(k.frame, (abs(k.frame - c.frame), k.frame)) AS key_frame FROM cuts c JOIN keys k USING (source_id) GROUP BY c.source_id, c.frame"))
def nearest_keyframe(spark, sf_dir):
    f = _settled_frames(spark, sf_dir)
    return ordered.nearest(scenes.candidate_cuts(f), _keys(f), BY, "frame", scenes.PART, "key_frame")


@query(_sql("frames totals cuts keys marks", """SELECT m.source_id, m.mark, (SELECT min(c.frame) FROM cuts c WHERE c.source_id = m.source_id AND c.frame >= m.mark) AS cut,
coalesce((SELECT max(k.frame) FROM keys k WHERE k.source_id = m.source_id AND k.frame <= m.mark - 10), 0) AS window_start FROM marks m"""))
def first_cut_after_mark(spark, sf_dir):
    f = _settled_frames(spark, sf_dir)
    m = scenes.marks(_totals(f), JOBS).withColumn("frame", F.col("mark"))
    cuts = scenes.candidate_cuts(f).withColumn("cut", F.col("frame"))
    keys = _keys(f).withColumn("window_start", F.col("frame"))
    ahead = ordered.as_of(m, cuts, BY, "frame", ["cut"], scenes.PART, forward=True).withColumn("frame", F.col("mark") - 10)
    return ordered.as_of(ahead, keys, BY, "frame", ["window_start"], scenes.PART).select("source_id", "mark", "cut", F.coalesce("window_start", F.lit(0).cast("long")).alias("window_start"))


@query(_sql("frames totals keys marks", "SELECT m.source_id, m.mark, k.frame AS key_frame FROM marks m JOIN keys k ON k.source_id = m.source_id AND k.frame BETWEEN m.mark - 14 AND m.mark + 30"))
def keyframes_in_window(spark, sf_dir):
    f = frames(spark, sf_dir)
    m = scenes.marks(_totals(f), JOBS).withColumn("frame", F.col("mark"))
    return ordered.within(m, _keys(f), BY, "frame", -14, 30).select("source_id", "mark", F.col("r_frame").alias("key_frame"))


@query(_sql("frames totals", """, b AS (SELECT source_id, event_id, score % 200 - 20 AS frame, event_type = 'click' AS is_cut FROM frames)
SELECT source_id, frame, max(event_id) AS ord, arg_max(is_cut, event_id) AS is_cut FROM b JOIN totals USING (source_id) WHERE frame BETWEEN 0 AND total GROUP BY source_id, frame"""))
def sanitized_boundaries(spark, sf_dir):
    f = frames(spark, sf_dir)
    b = f.select("source_id", F.col("event_id").alias("ord"), (F.col("score") % 200 - 20).alias("frame"), (F.col("event_type") == "click").alias("is_cut"))
    return scenes.sanitized(b, _totals(f))


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset, l_partkey, l_suppkey FROM lineitem")
def segment_offsets(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("size"), F.floor(F.col("l_linenumber") / 64).alias("_bucket"))
    return ordered.running_sum(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "_bucket", "size", "start_offset").drop("size", "_bucket")


@query(_sql("frames totals cuts scenes", """, marked AS (SELECT s.*, CASE WHEN lag(end_frame) OVER w = start_frame AND f.event_type <> 'click' THEN 0 ELSE 1 END AS opens
FROM scenes s JOIN frames f ON f.source_id = s.source_id AND f.frame = s.start_frame WINDOW w AS (PARTITION BY s.source_id ORDER BY start_frame)),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY source_id ORDER BY start_frame) AS island FROM marked)
SELECT source_id, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM islands GROUP BY source_id, island"""))
def merged_scenes(spark, sf_dir):
    f = _settled_frames(spark, sf_dir)
    return scenes.merged(_scenes(f), f.filter("event_type <> 'click'").select("source_id", "frame"))


@query("""WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn >= 0), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM t),
r AS (SELECT conv_id, count(*) FILTER (WHERE turn = i) AS run FROM n GROUP BY conv_id) SELECT c.conv_id, coalesce(run, 0) AS run, coalesce(run, 0) = c.turns AS complete
FROM (SELECT conv_id, count(DISTINCT turn) AS turns FROM conversations GROUP BY conv_id) c LEFT JOIN r USING (conv_id)""")
def contiguous_prefix(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    turns = c.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.count("turn").alias("turns"))
    return scenes.contiguous(c, "conv_id", "turn").join(turns, "conv_id").select("conv_id", "run", (F.col("run") == F.col("turns")).alias("complete"))


_WEIGHTED = "CAST(l_quantity AS BIGINT) AS weight, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(round_even(l_discount * 100, 0) AS BIGINT) END AS quality"


@query(f"""WITH r AS (SELECT l_returnflag AS scene, {_WEIGHTED} FROM lineitem)
SELECT coalesce(scene, 'total') AS scene, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(weight * quality) AS DOUBLE) / nullif(sum(CASE WHEN quality IS NOT NULL THEN weight END), 0) AS quality FROM r GROUP BY ROLLUP (scene)""")
def weighted_totals(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("scene"), F.col("l_quantity").cast("long").alias("weight"), F.when(F.col("l_linenumber") % 5 != 0, F.rint(F.col("l_discount") * 100).cast("long")).alias("quality")
    )
    return metrics.with_total(rows, ["scene"], ["weight"], ["quality"], "weight").select("scene", "weight", "quality")


@query("""WITH c AS (SELECT o_orderpriority, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS cents FROM orders)
SELECT o_orderpriority, count(*) AS n, min(cents) AS least, max(cents) AS most, CAST(sum(cents) AS BIGINT) AS total, CAST(sum(cents) AS BIGINT) // count(*) AS mean FROM c GROUP BY 1""")
def chunk_stats(spark, sf_dir):
    c = _table(spark, sf_dir, "orders").select("o_orderpriority", F.rint(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return c.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("cents").alias("least"), F.max("cents").alias("most"), F.sum("cents").alias("total"), F.expr("sum(cents) div count(*)").alias("mean"))


_SKIP = """reasons AS (SELECT c_custkey, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'missing'
WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'done' END AS reason FROM customer)"""


def _reasons(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return metrics.skip_reasons(_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders, orders.filter("o_orderpriority = '1-URGENT'"))


@query(f"WITH {_SKIP} SELECT c_custkey, reason FROM reasons")
def skip_existing(spark, sf_dir):
    return _reasons(spark, sf_dir)


@query(f"WITH {_SKIP} SELECT CASE WHEN reason IS NULL THEN 'ok' ELSE 'skipped' END AS status, reason, count(*) AS n FROM reasons GROUP BY ALL")
def batch_outcome(spark, sf_dir):
    status = F.when(F.col("reason").isNull(), F.lit("ok")).otherwise(F.lit("skipped"))
    return _reasons(spark, sf_dir).groupBy(status.alias("status"), "reason").agg(F.count("*").alias("n"))


@query(_sql("frames totals cuts scenes", "SELECT source_id, scene, printf('scene %4d  frames [%8d, %8d)  %10.3fs .. %10.3fs', scene, start_frame, end_frame, start_frame / 24.0, end_frame / 24.0) AS value FROM scenes"))
def scene_text(spark, sf_dir):
    return _scenes(_settled_frames(spark, sf_dir)).select("source_id", "scene", rules.scene_line(F.col("scene"), F.col("start_frame"), F.col("end_frame"), FPS).alias("value"))


@query(_sql("frames totals cuts scenes", "SELECT source_id, start_frame, end_frame FROM scenes"))
def parse_scene_lines(spark, sf_dir):
    lines = scene_text(spark, sf_dir).select("source_id", F.explode(F.array("value", F.lit("# no scene"))).alias("value"))
    return texts.scene_lines(lines).select("source_id", "start_frame", "end_frame")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS ssim_y, l_tax AS ssim_all, l_linenumber + CAST(0.5 AS DOUBLE) AS ssim_db, CAST(NULL AS DOUBLE) AS psnr_y, CAST(NULL AS DOUBLE) AS psnr_avg FROM lineitem")
def parse_metric_lines(spark, sf_dir):
    text = F.format_string("ssim/psnr: SSIM YUV: %s (10.5), 0.9 (9.1), 0.8 (8.2), All: %s (%d.5), (Frames: 7)", F.col("l_discount").cast("string"), F.col("l_tax").cast("string"), "l_linenumber")
    return texts.metric_values(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("value"))).drop("value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_probe(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


@query("""WITH r AS (SELECT p_partkey, p_size % 4 AS a, p_size % 3 AS b FROM part)
SELECT p_partkey, CASE WHEN a > 0 AND b > 0 THEN a ELSE 25 END AS num, CASE WHEN a > 0 AND b > 0 THEN b ELSE 1 END AS den FROM r""")
def rate_probe(spark, sf_dir):
    avg = F.concat_ws("/", (F.col("p_size") % 4).cast("string"), (F.col("p_size") % 3).cast("string"))
    text = F.to_json(F.struct(F.array(F.struct(F.lit(1920).alias("width"), F.lit(1080).alias("height"), avg.alias("avg_frame_rate"), F.lit("25").alias("r_frame_rate"))).alias("streams")))
    return texts.probe(_table(spark, sf_dir, "part").select("p_partkey", text.alias("value"))).select("p_partkey", F.col("frame_rate.num").cast("int").alias("num"), F.col("frame_rate.den").cast("int").alias("den"))


_CODECS = ("pcm_s16le", "flac", "opus", "DTS", "aac", "truehd", "ac3")


@query(f"""WITH r AS (SELECT p_partkey, lower(list_extract({list(_CODECS)}, CAST(p_partkey % 7 + 1 AS INTEGER))) AS codec, CASE WHEN p_size % 2 = 0 THEN 'DTS-HD MA' ELSE '' END AS profile,
CASE WHEN p_size % 9 = 0 THEN 2 ELSE p_size % 9 END AS n, CASE WHEN p_size % 5 = 0 THEN '5.1(side)' ELSE '' END AS layout FROM part),
s AS (SELECT *, codec LIKE 'pcm%' OR codec IN ('flac', 'truehd') OR (codec = 'dts' AND profile = 'DTS-HD MA') AS lossless FROM r)
SELECT p_partkey, CASE WHEN codec IN ('opus', 'flac') THEN '-c:a:0 copy' WHEN lossless THEN '-c:a:0 flac -compression_level:a:0 8'
ELSE '-c:a:0 libopus -b:a:0 ' || CASE WHEN n <= 2 THEN '128k' WHEN layout <> '' THEN '256k -filter:a:0 aformat=channel_layouts=5.1'
WHEN n = 6 THEN '256k -filter:a:0 aformat=channel_layouts=5.1' WHEN n = 8 THEN '256k -filter:a:0 aformat=channel_layouts=7.1' ELSE '256k' END END AS args FROM s""")
def codec_rules(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    codec = F.element_at(F.array(*map(F.lit, _CODECS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    profile, layout = F.when(F.col("p_size") % 2 == 0, F.lit("DTS-HD MA")), F.when(F.col("p_size") % 5 == 0, F.lit("5.1(side)"))
    return p.select("p_partkey", F.concat_ws(" ", rules.audio_args(codec, profile, F.col("p_size") % 9, layout, F.lit(0))).alias("args"))


@query("""SELECT c_custkey, trim(CASE WHEN c_nationkey % 3 = 0 THEN '--master-display copy --max-cll copy ' ELSE '' END
|| CASE WHEN c_nationkey % 4 = 0 THEN '--dhdr10-info copy ' ELSE '' END || CASE WHEN c_nationkey % 5 = 0 THEN '--dolby-vision-rpu copy --dolby-vision-profile 10.1' ELSE '' END) AS args FROM customer""")
def hdr_flags(spark, sf_dir):
    n = F.col("c_nationkey")
    side = F.concat(F.when(n % 4 == 0, F.lit("HDR10+ ")).otherwise(F.lit("")), F.when(n % 5 == 0, F.lit("DOVI record")).otherwise(F.lit("")))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", rules.hdr_args(F.when(n % 3 == 0, F.lit("smpte2084")), side)).alias("args"))


@query("""SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(floor(abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * 1000000) AS BIGINT))) AS BIGINT) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1""")
def content_score(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("before"))
    step = F.zip_with("embedding", "before", lambda a, b: F.floor(F.abs(a.cast("double") - b.cast("double")) * 1000000).cast("long"))
    return e.join(before, "vec_id").select("vec_id", F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


def _name() -> Column:
    n = F.col("page_id") % 5
    return F.concat(F.lit("/in/p"), F.col("page_id").cast("string"), F.when(n == 0, F.lit(".mkv")).when(n == 1, F.lit(".MP4")).when(n == 2, F.lit(".av1.mkv")).when(n == 3, F.lit(".Encoded.mkv")).otherwise(F.lit(".a.txt")))


@query("""WITH p AS (SELECT page_id, '/in/p' || page_id AS stem, page_id % 5 AS n FROM pages)
SELECT page_id, n < 2 AS taken, stem || (['', '', '.av1', '.Encoded', '.a'])[n + 1] || '.av1.mkv' AS beside, replace(stem, '/in/', '/out/') || (['', '', '.av1', '.Encoded', '.a'])[n + 1] || '.Encoded' || (['.mkv', '.MP4', '.mkv', '.mkv', '.txt'])[n + 1] AS inside FROM p""")
def output_rule(spark, sf_dir):
    path = _table(spark, sf_dir, "pages").select("page_id", _name().alias("path"))
    return path.select("page_id", rules.is_input(rules.base_name(F.col("path"))).alias("taken"), rules.output_path(F.col("path")).alias("beside"), rules.output_path(F.col("path"), F.lit("/out")).alias("inside"))


@query("SELECT event_id, right(props, 5) AS tail FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 10")
def first_errors(spark, sf_dir):
    return _table(spark, sf_dir, "events").filter("event_type = 'error'").orderBy("ts", "event_id").limit(10).select("event_id", F.right("props", F.lit(5)).alias("tail"))


@query(_sql("frames cuts keys", """(SELECT source_id, frame, 'left' AS side FROM (FROM keys EXCEPT ALL FROM cuts)) UNION ALL (SELECT source_id, frame, 'right' AS side FROM (FROM cuts EXCEPT ALL FROM keys))"""))
def keyframe_difference(spark, sf_dir):
    f = frames(spark, sf_dir)
    return metrics.symmetric_difference(_keys(f), scenes.candidate_cuts(f))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'exit code 1' WHEN o_orderkey % 5 = 0 THEN '47 frames instead of 48' WHEN o_orderkey % 11 = 0 THEN '-1 frames instead of 48' END AS err FROM orders""")
def chunk_verdicts(spark, sf_dir):
    k = F.col("o_orderkey")
    got = texts.packet_count(F.when(k % 5 == 0, F.lit("47,")).when(k % 11 == 0, F.lit("N/A")).otherwise(F.lit("48\n")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", rules.verdict(F.when(k % 7 == 0, F.lit(1)).otherwise(F.lit(0)), got, F.lit(48)).alias("err"))


#: Segmented detection on the events: a frame a second, windows of 14 frames before to 30 after a mark.
SEGMENTS = 3
_SEGMENTS = f"""marks3 AS (SELECT source_id, total, i, CAST(round_even(total * i / 3.0, 0) AS BIGINT) AS mark FROM totals, (SELECT unnest([1, 2]) AS i)),
inwin AS (SELECT m.source_id, m.mark, k.frame AS key FROM marks3 m JOIN keys k ON k.source_id = m.source_id AND k.frame BETWEEN m.mark - 14 AND m.mark + 30),
wins AS (SELECT source_id, mark, coalesce(max(key) FILTER (WHERE key <= mark - 10), min(key)) AS b, mark + 30 AS e FROM inwin GROUP BY ALL),
firsts AS (SELECT w.source_id, w.mark, min(c.frame) AS cut FROM wins w JOIN totals t USING (source_id) JOIN cuts c ON c.source_id = w.source_id AND c.frame >= w.mark AND c.frame >= w.b + 2 AND c.frame < least(w.e, t.total) - 2 GROUP BY ALL),
found AS (SELECT f.source_id, f.mark, arg_min(i.key, (abs(i.key - f.cut), i.key)) AS frame, min(abs(i.key - f.cut)) <= 1 AS is_cut FROM firsts f JOIN inwin i ON i.source_id = f.source_id AND i.mark = f.mark GROUP BY ALL)"""
@query(_sql("frames totals cuts keys", f", {_SEGMENTS} SELECT source_id, mark, frame, is_cut FROM found"))
def segment_boundaries(spark, sf_dir):
    f = _settled_frames(spark, sf_dir)
    t = _totals(f)
    found = scenes.boundaries(f, _keys(f), t, SEGMENTS, 1, 1.0)
    return found.select("source_id", "mark", "frame", "is_cut")


@query("WITH RECURSIVE " + ",\n".join(_PARTS[p] for p in ("frames", "totals", "cuts")) + f""",
kept AS (SELECT source_id, CAST(0 AS BIGINT) AS frame FROM totals UNION ALL
  SELECT k.source_id, (SELECT min(c.frame) FROM cuts c WHERE c.source_id = k.source_id AND c.frame >= k.frame + {GAP}) FROM kept k WHERE k.frame IS NOT NULL)
SELECT source_id, frame AS start_frame, coalesce(lead(frame) OVER (PARTITION BY source_id ORDER BY frame), total) AS end_frame FROM kept JOIN totals USING (source_id) WHERE frame IS NOT NULL""")
def segmented_scenes(spark, sf_dir):
    # sources of SEGMENTS times 20 frames or more are cut into segments, the others not; the SQL goes through each source in one pass
    f = _settled_frames(spark, sf_dir)
    return scenes.segmented(f, _keys(f), _totals(f), SEGMENTS, GAP, 1.0, least=20.0)


@query(_sql("frames totals cuts scenes", """, n AS (SELECT source_id, count(*) AS n FROM scenes GROUP BY source_id)
SELECT source_id, scene, start_frame, end_frame, NOT (n - 2 = n) AS partial FROM scenes JOIN n USING (source_id) WHERE scene >= 1 AND scene < n - 2"""))
def scene_slice(spark, sf_dir):
    return scenes.sliced(_scenes(_settled_frames(spark, sf_dir)), 1, -2)


@query("""WITH r AS (SELECT *, CAST(l_quantity AS BIGINT) AS n, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS bytes FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber + 4 AS scene, n AS frames, CAST(printf('%.2f', n / 4.0) AS DOUBLE) AS encode_sec, 4.0::DOUBLE AS fps,
CAST(printf('%.2f', bytes / 1e6) AS DOUBLE) AS size_mb, CAST(round_even(n / 50.0 * 100, 0) AS BIGINT) AS ratio, greatest(n - 1, 0) / 24.0 * 1000.0 AS ms,
CASE WHEN l_linenumber > 1 THEN n / 24.0 END AS begin_sec, CASE WHEN l_linenumber > 1 THEN l_linenumber / 24.0 END AS duration FROM r""")
def chunk_rows(spark, sf_dir):
    r = _table(spark, sf_dir, "lineitem")
    n, line = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    derived = rules.chunk_columns(line, 4, n, 2 * n, n / 4.0, F.rint("l_extendedprice").cast("long"))
    window = rules.audio_window(n, line, F.lit(FPS), line > 1)
    return r.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(v.alias(k) for k, v in derived.items()), rules.size_ratio(n, F.lit(50)).alias("ratio"),
        rules.stream_position(n, F.lit(FPS)).getField("ms").alias("ms"), window.getField("begin").alias("begin_sec"), window.getField("duration").alias("duration"),
    )


@query("""WITH r AS (SELECT l_returnflag AS scene, CAST(l_quantity AS BIGINT) AS frames, round_even(l_quantity / 8 * 10, 0) / 10 AS encode_sec FROM lineitem)
SELECT coalesce(scene, 'total') AS scene, CAST(sum(frames) AS BIGINT) AS frames, CAST(round_even(sum(CAST(round_even(encode_sec * 10, 0) AS BIGINT)), 0) AS BIGINT) AS tenths FROM r GROUP BY ROLLUP (scene)""")
def rounded_totals(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("scene"), F.col("l_quantity").cast("long").alias("frames"), (F.col("l_quantity") / 8).alias("encode_sec"))
    done = metrics.with_total(rows, ["scene"], ["frames", "encode_sec"], [], "frames", digits={"encode_sec": (1, 1)})
    return done.select("scene", "frames", F.rint(F.col("encode_sec") * 10).cast("long").alias("tenths"))


@query("""SELECT conv_id, coalesce(run, 0) AS run, turns AS expected FROM (SELECT conv_id, count(DISTINCT turn) AS turns FROM conversations WHERE turn <> 1 OR conv_id % 2 = 0 GROUP BY conv_id)
LEFT JOIN (SELECT conv_id, count(*) FILTER (WHERE turn = i) AS run FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn <> 1 OR conv_id % 2 = 0)) GROUP BY conv_id) USING (conv_id)
WHERE coalesce(run, 0) <> turns""")
def incomplete_parts(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").filter("turn <> 1 OR conv_id % 2 = 0")
    expected = c.groupBy("conv_id").agg(F.count_distinct("turn").alias("expected"))
    return scenes.incomplete(scenes.contiguous(c, "conv_id", "turn"), expected, "conv_id")


@query("""WITH r AS (SELECT p_partkey AS k, p_size AS n FROM part)
SELECT k AS p_partkey, CASE WHEN n % 11 = 0 THEN '' ELSE trim(CASE WHEN n % 3 = 0 THEN '--master-display copy --max-cll copy ' ELSE '' END
|| CASE WHEN n % 4 = 0 THEN '--dhdr10-info copy ' ELSE '' END || CASE WHEN n % 5 = 0 THEN '--dolby-vision-rpu copy --dolby-vision-profile 10.1' ELSE '' END) END AS args FROM r""")
def hdr_probe(spark, sf_dir):
    n = F.col("p_size")
    kind = lambda name: F.struct(F.struct(F.lit(name).alias("side_data_type")).alias("entry"))
    plus, vision = kind("HDR Dynamic Metadata SMPTE2094-40 (HDR10+)"), kind("DOVI configuration record")
    side = F.filter(F.array(F.when(n % 4 == 0, plus), F.when(n % 5 == 0, vision)), lambda x: x.isNotNull())
    frame = F.struct(side.alias("side_data_list"))
    other = F.struct(F.array(vision, plus).alias("side_data_list"))  # a second frame doesn't count
    stream = F.struct(F.when(n % 3 == 0, F.lit("smpte2084")).otherwise(F.lit("bt709")).alias("color_transfer"))
    text = F.to_json(F.struct(F.array(stream).alias("streams"), F.array(frame, other).alias("frames")))
    probed = texts.hdr_probe(_table(spark, sf_dir, "part").select("p_partkey", F.when(n % 11 == 0, F.lit("no json")).otherwise(text).alias("value")))
    return probed.select("p_partkey", F.concat_ws(" ", rules.hdr_args(F.col("transfer"), F.col("side_data"))).alias("args"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS frames FROM lineitem
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 3 OR l_shipdate > DATE '1998-06-01')""")
def valid_sources(spark, sf_dir):
    # orders are sources, lines their parts: a part of under three frames, or a late one, voids its source
    parts = _table(spark, sf_dir, "lineitem")
    bad = (F.col("l_quantity") < 3) | (F.col("l_shipdate") > F.lit("1998-06-01").cast("date"))
    return metrics.whole_groups(parts, "l_orderkey", bad).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("frames"))


@query("""WITH r AS (SELECT event_type, epoch_us(ts) AS b, epoch_us(ts) + CAST(round_even(value * 1000, 0) AS BIGINT) * 1000 AS e FROM events WHERE value >= 0)
SELECT event_type, CAST(sum(e - b) AS BIGINT) AS busy, max(e) - min(b) AS wall, CAST(sum(e - b) AS BIGINT) / nullif(max(e) - min(b), 0) AS ratio FROM r GROUP BY event_type""")
def wall_parallelism(spark, sf_dir):
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = _table(spark, sf_dir, "events").filter("value >= 0").select("event_type", begin.alias("begin"), (begin + F.rint(F.col("value") * 1000).cast("long") * 1000).alias("end"))
    return metrics.parallelism(timed, ["event_type"], "begin", "end")


@query("""WITH k AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'signup'), m AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error')
SELECT m.user_id AS source_id, m.event_id, m.t, coalesce((SELECT max(k.t) FROM k WHERE k.user_id = m.user_id AND k.t <= m.t - 10000000), (SELECT min(k.t) FROM k WHERE k.user_id = m.user_id)) AS key_t FROM m""")
def lead_by_time(spark, sf_dir):
    # for each mark the last keyframe at least ten seconds before it, by time, else the source's first
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    marks = e.filter("event_type = 'error'").withColumn("at", F.col("t") - 10_000_000)
    keys = e.filter("event_type = 'signup'").select("source_id", F.col("t").alias("at"), F.col("t").alias("key_t"))
    return ordered.as_of(marks, keys, BY, "at", ["key_t"], 3_600_000_000 * 24, else_first=True).select("source_id", "event_id", "t", "key_t")
