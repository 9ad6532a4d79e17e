"""Operators on small fixtures and on random data against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from segmentry.functions import rules
from segmentry.operators import metrics, ordered, scenes


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_as_of_and_nearest_match_a_plain_search(spark, size):
    rng = random.Random(size)
    keys = [(s, rng.randrange(200), rng.randrange(9)) for s in (1, 2) for _ in range(25)]
    asks = [(s, rng.randrange(220)) for s in (1, 2, 3) for _ in range(40)]
    left, right = frame(spark, asks, "source_id long, frame long"), frame(spark, keys, "source_id long, frame long, v long")
    back = ordered.as_of(left, right, ["source_id"], "frame", ["v"], size, "k_")
    want = [(s, f, max(((k, v) for t, k, v in keys if t == s and k <= f), default=(None, None))[1]) for s, f in asks]
    assert sorted(map(repr, want)) == sorted(map(repr, [(r.source_id, r.frame, r.k_v) for r in back.collect()]))
    ahead = ordered.as_of(left, right, ["source_id"], "frame", ["v"], size, "k_", forward=True)
    want = [(s, f, min(((k, v) for t, k, v in keys if t == s and k >= f), default=(None, None))[1]) for s, f in asks]
    assert sorted(map(repr, want)) == sorted(map(repr, [(r.source_id, r.frame, r.k_v) for r in ahead.collect()]))
    near = ordered.nearest(left, right, ["source_id"], "frame", size, "key")
    want = [(s, f, min((k for t, k, _ in keys if t == s), key=lambda k: (abs(k - f), k), default=None)) for s, f in asks]
    assert sorted(map(repr, want)) == sorted(map(repr, [(r.source_id, r.frame, r.key) for r in near.collect()]))


def test_keyframe_fixture(spark):
    table = frame(spark, [(0, 0, 0.0), (0, 48, 2.0), (0, 96, 4.0)], "source_id long, frame long, t double").withColumn("key", F.col("frame"))
    asked = frame(spark, [(0, 48), (0, 70), (0, 0)], "source_id long, frame long")
    got = ordered.as_of(asked, table, ["source_id"], "frame", ["key"], 50)
    assert values(got, "frame", "key") == [(0, 0), (48, 48), (70, 48)]


@pytest.mark.parametrize("size", [1, 5, 100])
def test_running_sum_and_range_join(spark, size):
    rng = random.Random(size)
    rows = [(s, i, rng.randrange(10)) for s in (1, 2) for i in range(40)]
    df = frame(spark, rows, "source_id long, i long, v long").withColumn("b", F.floor(F.col("i") / size))
    got = {(r.source_id, r.i): r.t for r in ordered.running_sum(df, ["source_id"], ["i"], "b", "v", "t").collect()}
    assert got == {(s, i): sum(v for q, j, v in rows if q == s and j < i) for s, i, _ in rows}
    pairs = ordered.within(df.select("source_id", "i"), df.select("source_id", "i"), ["source_id"], "i", -2, size)
    assert values(pairs, "source_id", "i", "r_i") == sorted((s, i, j) for s, i, _ in rows for q, j, _ in rows if q == s and i - 2 <= j <= i + size)


@pytest.mark.parametrize("part", [5, 64, 1 << 16])
def test_parts_do_not_change_cuts_or_scenes(spark, part):
    rng = random.Random(3)
    rows = [(s, f, rng.choice([10, 100, 2000])) for s, n in ((1, 150), (2, 4), (3, 1)) for f in range(n)]
    df = frame(spark, rows, "source_id long, frame long, score long")
    score = {(s, f): v for s, f, v in rows}
    near = lambda s, f: [score.get((s, f + d)) for d in (-2, -1, 1, 2)]
    want = sorted((s, f) for s, f, v in rows if None not in near(s, f) and v >= 1500 and 4 * v >= 3 * sum(near(s, f)))
    cuts = scenes.candidate_cuts(df, part=part)
    assert values(cuts, "source_id", "frame") == want
    kept = []
    for s in (1, 2, 3):
        last = 0
        for q, f in want:
            if q == s and f - last >= 6:
                kept.append((s, f))
                last = f
    assert values(scenes.min_gap(cuts, 6, part), "source_id", "frame") == kept
    totals = df.groupBy("source_id").agg(F.count("*").alias("total"))
    found = values(scenes.scenes(cuts, totals, part), "source_id", "scene", "start_frame", "end_frame")
    for s, n in ((1, 150), (2, 4), (3, 1)):
        mine = [r for r in found if r[0] == s]
        assert [r[1] for r in mine] == list(range(len(mine)))
        assert [r[2] for r in mine] == [0, *[f for q, f in want if q == s]] and [r[3] for r in mine] == [*[r[2] for r in mine[1:]], n]


def test_toy_gap(spark):
    cuts = frame(spark, [(1, f) for f in (10, 50, 80, 90, 200)], "source_id long, frame long")
    assert values(scenes.min_gap(cuts, 72), "frame") == [(80,), (200,)]


def test_merge_chains(spark):
    parts = frame(spark, [(1, 0, 1680), (1, 1680, 3360), (1, 3360, 5040), (1, 6000, 6100)], "source_id long, start_frame long, end_frame long")
    soft = frame(spark, [(1, 3360), (1, 6000)], "source_id long, frame long")
    assert values(scenes.merged(parts, soft), "start_frame", "end_frame") == [(0, 1680), (1680, 5040), (6000, 6100)]


def test_sanitized_boundaries(spark):
    b = [(1, i, f, t, c) for i, (f, t, c) in enumerate([(100, 4.0, True), (-5, -1.0, True), (0, 0.0, False), (50, 2.0, False), (50, 2.0, True), (999, 40.0, True), (100, 4.0, False)])]
    got = scenes.sanitized(frame(spark, b, "source_id long, ord int, frame long, time double, is_cut boolean"), frame(spark, [(1, 200)], "source_id long, total long"))
    assert values(got, "frame", "time", "is_cut") == [(0, 0.0, False), (50, 2.0, True), (100, 4.0, False)]


@pytest.mark.parametrize("begin, ready, run", [(0, [], 0), (0, [0], 1), (0, [0, 1, 3], 2), (0, [1, 2], 0), (0, [0, 1, 2], 3), (5, [5], 1), (10, [0, 1, 2], 0)])
def test_contiguous_run(spark, begin, ready, run):
    df = frame(spark, [(1, i) for i in ready], "g long, i long")
    assert values(scenes.contiguous(df, "g", "i", begin), "g", "run") == ([(1, run)] if ready else [])


def test_marks_and_gate(spark):
    assert values(scenes.marks(frame(spark, [(1, 5040)], "source_id long, total long"), 3), "mark") == [(1680,), (3360,)]
    assert scenes.marks(frame(spark, [(1, 5040)], "source_id long, total long"), 1).count() == 0
    assert scenes.worth_splitting(220 * 24, 3, 72, 24.0) and not scenes.worth_splitting(30 * 24, 2, 72, 24.0) and not scenes.worth_splitting(None, 4, 72, 24.0)


def test_weighted_total(spark):
    rows = frame(spark, [("0", 100, 10.0, 0.9, None), ("1", 300, 30.0, 0.8, None)], "scene string, frames long, sec double, ssim double, psnr double")
    total = [r for r in metrics.with_total(rows, ["scene"], ["frames", "sec"], ["ssim", "psnr"], "frames").collect() if r.scene == "total"][0]
    assert (total.frames, total.sec, round(total.ssim, 5), total.psnr) == (400, 40.0, 0.825, None)


def test_rules(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(rules.seek(F.lit(2.0009))) == "00:00:02.000" and pick(rules.seek(F.lit(3661.5))) == "01:01:01.500"
    assert pick(rules.trim(F.lit(70), F.lit(96), F.lit(48))) == "22:47"
    assert tuple(pick(rules.rate(F.lit("24000/1001")))) == (24000, 1001) and pick(rules.rate(F.lit("0/0"))) is None and tuple(pick(rules.rate(F.lit("25")))) == (25, 1)
    assert pick(rules.strict_rate(F.lit("25"))) is None and pick(rules.strict_rate(F.lit("50/2"))) == 25.0
    none = F.lit(None).cast("string")
    args = lambda codec, profile, n, layout: pick(rules.audio_args(F.lit(codec), F.lit(profile), F.lit(n), layout, F.lit(0)))
    assert args("aac", "LC", 2, F.lit("stereo")) == ["-c:a:0", "libopus", "-b:a:0", "128k"]
    assert args("flac", "", 2, none) == ["-c:a:0", "copy"] and args("pcm_s24le", "", 6, none)[1] == "flac"
    assert args("ac3", "", 6, F.lit("5.1(side)"))[-1] == "aformat=channel_layouts=5.1" and args("dts", "DTS-HD MA", 8, none)[1] == "flac"
    assert pick(rules.hdr_args(F.lit("smpte2084"), none)) == ["--master-display", "copy", "--max-cll", "copy"] and pick(rules.hdr_args(F.lit("bt709"), F.lit(""))) == []
    assert pick(rules.hdr_args(F.lit(""), F.lit("DOVI configuration record")))[-1] == "10.1"
    assert pick(rules.output_path(F.lit("/a/A.B.C.mkv"), F.lit("/out"))) == "/out/A.B.C.Encoded.mkv" and pick(rules.output_path(F.lit("/a/m.mkv"))) == "/a/m.av1.mkv"
    command = pick(rules.chunk_args(F.lit("in.mkv"), F.lit("00:00:00.000"), F.lit("0:47"), F.lit("o.obu"), rules.hdr_args(none, none), True))
    assert command[:4] == ["qsvencc", "--avhw", "--va", "-i"] and command[-6:] == ["--seek", "00:00:00.000", "--trim", "0:47", "-o", "o.obu"] and "--ssim" in command
    assert pick(rules.verdict(F.lit(0), F.lit(48), F.lit(48))) is None and "47" in pick(rules.verdict(F.lit(0), F.lit(47), F.lit(48)))
    assert tuple(pick(rules.geometry(F.lit(1920), F.lit(1080), 320))) == (320, 180, 320 * 180 * 3)
    assert rules.min_scene_len(72, 3.0, 24) == 72 and rules.min_scene_len(None, 2.5, 24) == 60 and rules.min_scene_len(0, 1, 24) == 1


def test_a_missing_exit_code_or_count_is_an_error(spark):
    rows = spark.createDataFrame([(0, 48), (0, None), (None, 48), (1, 48), (0, 47)], "code int, got int")
    got = [r.v for r in rows.select(rules.verdict(F.col("code"), F.col("got"), F.lit(48)).alias("v")).collect()]
    assert got == [None, "-1 frames instead of 48", "exit code unknown", "exit code 1", "47 frames instead of 48"]


def test_as_of_may_fall_back_to_the_first_row(spark):
    left = spark.createDataFrame([(1, 3), (1, 50), (2, 1)], "source_id long, frame long")
    right = spark.createDataFrame([(1, 10), (1, 40)], "source_id long, frame long").withColumn("key", F.col("frame"))
    got = {(r.source_id, r.frame): r.key for r in ordered.as_of(left, right, ["source_id"], "frame", ["key"], 16, else_first=True).collect()}
    assert got == {(1, 3): 10, (1, 50): 40, (2, 1): None}


def test_windows_wider_than_a_part(spark):
    frames = spark.createDataFrame([(1, i, 9000 if i == 20 else 10) for i in range(41)], "source_id long, frame long, score long")
    for part in (1, 2, 3, 100):
        assert [r.frame for r in scenes.candidate_cuts(frames, width=5, part=part).collect()] == [20]


def test_contiguous_counts_a_null_group(spark):
    ready = spark.createDataFrame([(None, 0), (None, 1), (None, 3), (4, 1)], "g long, i long")
    runs = scenes.contiguous(ready, "g", "i")
    assert {(r.g, r.run) for r in runs.collect()} == {(None, 2), (4, 0)}
    expected = spark.createDataFrame([(None, 4), (4, 0), (7, 1)], "g long, expected long")
    assert {(r.g, r.run, r.expected) for r in scenes.incomplete(runs, expected, "g").collect()} == {(None, 2, 4), (7, 0, 1)}
    with pytest.raises(ValueError):
        scenes.require_complete(runs, expected, "g")


def test_scene_slices_as_python_slices(spark):
    rows = spark.createDataFrame([(s, i, 10 * i, 10 * i + 10) for s, n in ((1, 5), (2, 2)) for i in range(n)], "source_id long, scene long, start_frame long, end_frame long")
    for low, high in ((0, None), (-3, 2), (1, -1), (1, 9), (3, -9), (0, 5)):
        want = {(s, i) for s, n in ((1, 5), (2, 2)) for i in list(range(n))[max(0, low) : high]}
        assert {(r.source_id, r.scene) for r in scenes.sliced(rows, low, high).collect()} == want
    with pytest.raises(ValueError):
        scenes.require_scenes(scenes.sliced(rows, 7))


def test_chunk_columns_windows_and_lengths(spark):
    one = spark.range(1).select(
        *(v.alias(k) for k, v in rules.chunk_columns(F.lit(2), 3, F.lit(48), F.lit(96), F.lit(1.238), F.lit(1_234_567)).items()),
        rules.size_ratio(F.lit(50), F.lit(200)).alias("ratio"), rules.stream_position(F.lit(0), F.lit(24.0)).alias("a"), rules.stream_position(F.lit(25), F.lit(24.0)).alias("b"),
        rules.audio_window(F.lit(48), F.lit(24), F.lit(24.0), F.lit(True)).alias("w"), rules.audio_window(F.lit(48), F.lit(24), F.lit(24.0), F.lit(False)).alias("n"),
    ).first()
    assert (one.scene, one.frames, one.encode_sec, one.fps, one.size_mb, one.ratio) == (5, 48, 1.24, 38.8, 1.23, 25)
    assert (tuple(one.a), tuple(one.b), tuple(one.w), tuple(one.n)) == ((0, 0.0), (24, 1000.0), (2.0, 1.0), (None, None))
    parts = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 5, 9), (1, 1, 0, 4)], "source_id long, part long, start_frame long, end_frame long")
    assert {(r.part, r.length) for r in scenes.segment_lengths(parts).collect()} == {(0, 9), (1, 4)}
    assert rules.min_scene_len() == 72 and rules.mux_rate(24000 / 1001) == "24000/1001" and rules.mux_rate(25.0) == "25/1"


def test_segmented_detection_equals_sequential_detection(spark):
    rng = random.Random(3)
    rows = [(s, f, 5000 if f in cuts else rng.randrange(20)) for s, cuts in ((1, {100, 310, 480, 700}), (2, {333, 660})) for f in range(1000)]
    frames = spark.createDataFrame(rows, "source_id long, frame long, score long")
    totals = frames.groupBy("source_id").agg(F.count("*").alias("total"))
    keys = spark.createDataFrame([(s, f) for s in (1, 2) for f in [*range(0, 1000, 12), 310, 700]], "source_id long, frame long").distinct()
    whole = scenes.scenes(scenes.min_gap(scenes.candidate_cuts(frames), 8), totals)
    found = scenes.boundaries(frames, keys, totals, 3, 8, 1.0, before=60, lead=40, after=150)
    assert {(r.source_id, r.mark, r.frame, r.is_cut) for r in found.collect()} == {(1, 333, 480, True), (1, 667, 700, True), (2, 333, 336, False)}
    got = scenes.segmented(frames, keys, totals, 3, 8, 1.0, before=60, lead=40, after=150)
    want = {(r.source_id, r.start_frame, r.end_frame) for r in whole.collect()}
    assert {(r.source_id, r.start_frame, r.end_frame) for r in got.collect()} == want and len(want) == 8


@pytest.mark.parametrize(("jobs", "gap"), [(3, 7), (5, 1), (1, 4)])
def test_segments_hand_their_last_cut_on(spark, jobs, gap):
    rng = random.Random(jobs)
    sizes = {1: 900, 2: 420, 3: 59, 4: 1, 5: 300}  # the gate leaves the small ones whole
    rows = [(s, f, 5000 if rng.random() < 0.2 else rng.randrange(900)) for s, n in sizes.items() for f in range(n)]
    frames = spark.createDataFrame(rows, "source_id long, frame long, score long")
    totals = spark.createDataFrame([*sizes.items(), (6, 0)], "source_id long, total long")
    keys = spark.createDataFrame([(s, f) for s, n in sizes.items() for f in range(n) if f % 9 == 0], "source_id long, frame long")
    whole = scenes.scenes(scenes.min_gap(scenes.candidate_cuts(frames), gap), totals)
    got = scenes.segmented(frames, keys, totals, jobs, gap, 1.0, least=20.0)
    want = sorted((r.source_id, r.start_frame, r.end_frame) for r in whole.collect())
    assert sorted((r.source_id, r.start_frame, r.end_frame) for r in got.collect()) == want and len(want) > 100
    long = totals.filter(f"total >= {jobs * scenes.shortest_span(gap, 1.0, 20.0)}")
    inner = scenes.boundaries(frames, keys, long, jobs, gap, 1.0).collect()
    assert {r.source_id for r in inner} == ({1, 2, 5} if jobs > 1 else set())
    assert jobs < 3 or any(not r.is_cut for r in inner)
