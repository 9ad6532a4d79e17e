"""Sources on the smallest inputs: text, probes, binary index, files, streams."""

import pytest
from pyspark.sql import functions as F

from segmentry.functions import rules
from segmentry.operators import scenes
from segmentry.sources import binary, files, raw, texts
from segmentry.streaming import stateful

HEAD = bytes.fromhex(
    "1a45dfa38018538067ce114d9b748e4dbb8b53ab841c53bb6b53ac81201654ae6b88ae86d781018381011c53bb6ba9bb8bb38100b786f78101f18100bb8cb38201f4b786f78101f18100bb8cb38203e8b786f78101f18100"
)


def test_binary_index(spark, tmp_path):
    assert binary.index_place(HEAD, len(HEAD) + 1000) == (42, 1_000_000, 1)
    assert binary.element(HEAD, 42) == (binary.CUES, 41, 47)
    (tmp_path / "a.mkv").write_bytes(HEAD)
    (tmp_path / "cut.mkv").write_bytes(HEAD[:60])
    (tmp_path / "none.mkv").write_bytes(b"")
    found = binary.keyframes(spark.read.format("binaryFile").load(str(tmp_path)), 24.0)
    assert sorted((r.path.split("/")[-1], r.frame, r.pts_time) for r in found.collect()) == [("a.mkv", 0, 0.0), ("a.mkv", 12, 0.5), ("a.mkv", 24, 1.0)]


def test_index_never_raises():
    for cut in range(len(HEAD)):
        binary.index_place(HEAD[:cut], 10**6)
        binary.index_keyframes(HEAD[47 : 47 + cut], 1, 1_000_000, 24.0)
    assert binary.index_place(HEAD, 42) is None
    assert binary.index_keyframes(HEAD[60:88], 1, 1_000_000, 24.0) is None  # no frame 0
    assert binary.varint(b"\x82", 0, False) == (2, 1) and binary.varint(b"\x41\x00", 0, False) == (256, 2) and binary.varint(b"\xa3", 0, True) == (0xA3, 1)


def test_raw_frames(spark, tmp_path):
    (tmp_path / "f.bgr").write_bytes(bytes([0] * 6 + [9] * 6 + [5] * 4))
    got = binary.frame_scores(spark.read.format("binaryFile").load(str(tmp_path)), 6)
    assert sorted((r.frame, r.score) for r in got.collect()) == [(0, 0.0), (1, 9.0)]


def test_text_sources(spark):
    lines = spark.createDataFrame([("# head",), ("scene    0  frames [       0,       48)       0.000s ..      2.000s",), ("frames [48, 96) x",), (None,)], "value string")
    assert sorted((r.start_frame, r.end_frame) for r in texts.scene_lines(lines).collect()) == [(0, 48), (48, 96)]
    out = spark.createDataFrame([("x SSIM YUV: 0.99 (20.1), 0.9 (1), 0.9 (1), All: 0.99985 (38.2), (Frames: 7)\nPSNR YUV: 45.1, 46, 47, Avg: 44.8, (Frames: 7)",), ("none",)], "value string")
    assert [(r.ssim_all, r.psnr_avg) for r in texts.metric_values(out).collect()] == [(0.99985, 44.8), (None, None)]
    packets = spark.createDataFrame([("0.000000", "K__"), ("0.041667", "___"), ("2.000000", "K__"), ("N/A", "K__")], "pts_time string, flags string")
    assert sorted((r.frame, r.pts_time) for r in texts.keyframes(packets, 24.0).collect()) == [(0, 0.0), (48, 2.0)]
    assert [r.frame for r in texts.keyframes(packets, 24.0, 1.0, 3.0).collect()] == [48]
    probe = spark.createDataFrame([('{"streams":[{"width":1920,"height":1080,"avg_frame_rate":"0/0","r_frame_rate":"24000/1001"}],"format":{"duration":"120.5"}}',), ("{}",)], "value string")
    a, b = texts.probe(probe).collect()
    assert (a.width, a.height, tuple(a.frame_rate), a.duration_sec) == (1920, 1080, (24000, 1001), 120.5) and b.frame_rate is None
    audio = spark.createDataFrame([('{"streams":[{"index":1,"codec_name":"aac","channels":2}]}',), ("{}",)], "value string")
    assert [(r.number, r.codec_name) for r in texts.audio_streams(audio).collect()] == [(0, "aac"), (None, None)]
    counts = spark.createDataFrame([("48,\n",), ("N/A",)], "v string").select(texts.packet_count(F.regexp_replace("v", "\n", "")).alias("n"))
    assert [r.n for r in counts.collect()] == [48, -1]


def test_discovery(spark, tmp_path):
    for n in ("a.mkv", "b.MP4", "movie.Encoded.mkv", "movie.av1.mkv", "movie.mkv.scenes", "_u.mov"):
        (tmp_path / n).touch()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.ts").touch()
    names = lambda r: [x.path.split("/")[-1] for x in files.discover(spark, str(tmp_path), r).collect()]
    assert names(False) == ["_u.mov", "a.mkv", "b.MP4"] and names(True) == ["_u.mov", "a.mkv", "b.MP4", "c.ts"]
    assert files.discover(spark, str(tmp_path / "movie.mkv.scenes")).count() == 1 and files.discover(spark, str(tmp_path / "no")).count() == 0


def test_scene_text_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 48), (1, 48, 120), (2, 120, 121)], "scene long, s long, e long")
    files.write_scene_text(rows.select("scene", rules.scene_line(F.col("scene"), F.col("s"), F.col("e"), 24.0).alias("value")), str(tmp_path / "x"))
    back = texts.scene_lines(texts.lines(spark, str(tmp_path / "x")))
    assert sorted((r.start_frame, r.end_frame) for r in back.collect()) == [(0, 48), (48, 120), (120, 121)]


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_streams_equal_batches(spark, tmp_path):
    batches = [[(1, 3), (1, 0)], [(1, 1), (2, 1)], [(1, 2), (1, 2), (1, 9)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "source_id long, idx long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source_id long, idx long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(run(spark, stateful.in_order(stream), tmp_path, "ordered")) == [(1, 0), (1, 1), (1, 2), (1, 3)]
    import random

    rng = random.Random(5)
    rows = [(s, f, rng.choice([10, 100, 2000])) for s in (1, 2) for f in range(60)]
    mixed = rows[:]
    rng.shuffle(mixed)
    for i in range(0, len(mixed), 50):
        spark.createDataFrame(mixed[i : i + 50], "source_id long, frame long, score long").coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("source_id long, frame long, score long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f"))
    batch = scenes.min_gap(scenes.candidate_cuts(spark.createDataFrame(rows, "source_id long, frame long, score long")), 6)
    assert sorted(run(spark, stateful.cuts(stream, gap=6), tmp_path, "cuts")) == sorted((r.source_id, r.frame) for r in batch.collect())


def test_raw_frames_by_ranges(spark, tmp_path):
    path = str(tmp_path / "f.bgr")
    records = [bytes([k] * 6) for k in (0, 9, 5, 5, 1, 200)]
    with open(path, "wb") as f:
        f.write(b"".join(records) + b"tail")
    read = lambda **o: [(r.frame, r.data) for r in raw.raw_frames(spark, path, 6, part_frames=2, **o).orderBy("frame").collect()]
    assert read() == [(i, x) for i, x in enumerate(records)]
    assert read(fps=2.0, seek=0.503, to=2.0) == [(i, x) for i, x in enumerate(records[1:4])]
    assert read(fps=2.0, seek=1.0, max_frames=2) == [(i, x) for i, x in enumerate(records[2:4])] and read(decode="false", max_frames=1) == [(0, None)]
    paths = spark.createDataFrame([(path,), (str(tmp_path / "none"),)], "path string")
    assert {r.path: r.frames for r in raw.frame_counts(paths, 6).collect()} == {path: 6, str(tmp_path / "none"): 0}
    got = {r.frame: r.score for r in raw.frame_scores(paths, 6, part_frames=2).collect()}
    assert got == {0: 0.0, 1: 9.0, 2: 4.0, 3: 0.0, 4: 4.0, 5: 199.0}


def test_keyframes_by_seeking_else_by_packets(spark, tmp_path):
    names = {"a.mkv": HEAD, "cut.mkv": HEAD[:60], "b.mp4": HEAD}
    for n, data in names.items():
        (tmp_path / n).write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*names, "gone.mkv"]], "path string")
    assert sorted((r.path.split("/")[-1], r.frame) for r in raw.seek_keyframes(paths, 24.0).collect()) == [(n, f) for n in ("a.mkv", "b.mp4") for f in (0, 12, 24)]
    packets = paths.select("path", F.lit(0).cast("long").alias("frame"), F.lit(0.0).alias("pts_time"))
    got = sorted((r.path.split("/")[-1], r.frame) for r in raw.keyframe_table(paths, packets, 24.0).collect())
    assert got == [("a.mkv", 0), ("a.mkv", 12), ("a.mkv", 24), ("b.mp4", 0), ("cut.mkv", 0), ("gone.mkv", 0)]


def test_strict_text_rules(spark, tmp_path):
    rows = spark.createDataFrame([("frames[0,48)",), ("frames [ 0,48)",)], "value string")
    assert [r.value for r in texts.scene_lines(rows).collect()] == ["frames [ 0,48)"]
    counts = spark.createDataFrame([("-5",), (" 48,",), ("+4",), ("4 8",), (None,)], "v string").select(texts.packet_count(F.col("v")).alias("n"))
    assert [r.n for r in counts.collect()] == [-1, 48, -1, -1, -1]
    table = spark.createDataFrame([(1, 0), (1, 9), (2, 9)], "source_id long, frame long")
    assert [r.source_id for r in texts.without_first(table, "source_id").collect()] == [2]
    (tmp_path / "x").write_text("nothing here")
    with pytest.raises(ValueError):
        texts.require_first(table, "source_id")
    with pytest.raises(ValueError):
        texts.read_scenes(spark, str(tmp_path / "x"))
    fps = spark.createDataFrame([("0/0", "24000/1001"), ("25", "30/1"), ("25", "x")], "a string, r string").select(rules.strict_frame_rate(F.col("a"), F.col("r")).alias("f"))
    assert [r.f for r in fps.collect()] == [24000 / 1001, 30.0, None]
