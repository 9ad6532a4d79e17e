"""Pushed filters, growing files, ordered text sinks and numbered lines."""

import os

import pytest
from pyspark.sql import functions as F

from segmentry.functions import rules
from segmentry.operators import metrics
from segmentry.sources import ordered_text, raw, texts

PUSH = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def pushing(spark):
    spark.conf.set(PUSH, "true")
    yield spark
    spark.conf.unset(PUSH)


def records(path, n, size=4, begin=0):
    with open(path, "ab") as f:
        for i in range(begin, begin + n):
            f.write(i.to_bytes(size, "big"))


def frames(df):
    return sorted((os.path.basename(r.path), r.frame, int.from_bytes(r.data, "big")) for r in df.collect())


def test_filters_bound_what_is_read(pushing, tmp_path):
    for name in ("a", "b"):
        records(tmp_path / name, 100)
    df = raw.raw_frames(pushing, f"{tmp_path}/a,{tmp_path}/b", 4, part_frames=8)
    at = str(tmp_path / "a")
    cases = [
        (F.col("frame") == 7, [7], "ab", ["EqualTo(frame"]), ((F.col("frame") >= 90) & (F.col("frame") < 92), [90, 91], "ab", ["GreaterThanOrEqual(frame", "LessThan(frame"]),
        ((F.col("frame") > 97) & (F.col("path") == at), [98, 99], "a", ["EqualTo(path", "GreaterThan(frame"]), (F.col("frame").isin(3, 5), [3, 5], "ab", []), (F.col("frame") <= -1, [], "ab", []),
        (F.col("path").startswith(str(tmp_path / "b")) & (F.col("frame") <= 0), [0], "b", []), ((F.col("frame") % 50 == 1) & (F.col("frame") > 40), [51], "ab", []), (F.col("frame") > 1e6, [], "ab", []),
    ]
    for condition, want, names, shown in cases:
        got = df.filter(condition)
        assert frames(got) == [(n, i, i) for n in names for i in want]
        plan = pushing.sparkContext._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        assert all(x in plan for x in shown), plan


def test_pushed_bounds_in_bytes(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

    records(tmp_path / "a", 1000)
    reader = raw._PushingReader({"path": str(tmp_path / "a"), "record_bytes": "4", "part_frames": "64"})
    bytes_of = lambda: sum(4 * (p.end - p.begin) for p in reader.partitions())
    assert bytes_of() == 4000
    assert list(reader.pushFilters([GreaterThanOrEqual(("frame",), 100), LessThan(("frame",), 110)])) == [] and bytes_of() == 40
    rest = [In(("frame",), (105, 107)), StringContains(("path",), "a")]
    assert list(reader.pushFilters(rest)) == rest and bytes_of() == 12
    list(reader.pushFilters([EqualTo(("path",), "other")]))
    assert bytes_of() == 0


def test_a_huge_file_is_read_where_asked(pushing, tmp_path):
    with open(tmp_path / "huge", "wb") as f:
        f.truncate(1 << 42)  # sparse; reading all of it would never end
    df = raw.raw_frames(pushing, str(tmp_path / "huge"), 1 << 20).filter("frame BETWEEN 3999999 AND 4000001")
    assert sorted((r.frame, r.n) for r in df.select("frame", F.length("data").alias("n")).collect()) == [(i, 1 << 20) for i in (3999999, 4000000, 4000001)]


def test_filters_in_windows_count_from_the_window(pushing, tmp_path):
    records(tmp_path / "a", 100)
    df = raw.raw_frames(pushing, str(tmp_path / "a"), 4, fps=10.0, seek=2.0, to=5.0)
    assert frames(df.filter("frame >= 28")) == [("a", 28, 48), ("a", 29, 49)]


def test_growing_files_are_streamed_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    records(folder / "a", 10)
    (folder / "_ignored").write_bytes(b"0000")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        stream = raw.raw_frame_stream(spark, str(folder), 4, part_frames=3)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        return frames(spark.read.parquet(out))

    assert run() == [("a", i, i) for i in range(10)]
    records(folder / "a", 5, begin=10)
    records(folder / "b", 2)
    with open(folder / "b", "ab") as f:
        f.write(b"\0\0")  # half a record: not yet
    assert run() == [("a", i, i) for i in range(15)] + [("b", 0, 0), ("b", 1, 1)]
    with open(folder / "b", "ab") as f:
        f.write(b"\0\x02")
    got = run()
    assert got == [("a", i, i) for i in range(15)] + [("b", i, i) for i in range(3)]
    assert run() == got  # nothing new
    assert frames(raw.raw_frames(spark, f"{folder}/a,{folder}/b", 4)) == got  # as a batch


def test_a_file_for_each_name_in_order(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(n, i, f"{n} {i}") for n in ("a", "b/c", "ü") for i in range(200)], "name string, place long, value string").repartition(7, F.rand(3))
    ordered_text.write_ordered(rows, out, ".scenes")
    assert sorted(os.listdir(out)) == ["%C3%BC.scenes", "a.scenes", "b%2Fc.scenes"]
    assert open(f"{out}/b%2Fc.scenes", encoding="utf-8").read() == "".join(f"b/c {i}\n" for i in range(200))
    with pytest.raises(Exception, match="already"):
        ordered_text.write_ordered(rows, out, ".scenes")
    ordered_text.write_ordered(rows.filter("name = 'a' AND place < 2"), out, ".scenes", mode="overwrite")
    assert os.listdir(out) == ["a.scenes"] and open(f"{out}/a.scenes").read() == "a 0\na 1\n"


def test_nothing_is_left_of_a_failed_job(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([(n, i, None if (n, i) == ("b", 99) else "x") for n in "abcd" for i in range(100)], "name string, place long, value string")
    with pytest.raises(Exception, match="null name or line"):
        ordered_text.write_ordered(rows, str(out))
    assert not out.exists() or os.listdir(out) == []
    split = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "name string, place long, value string").repartition(2)
    with pytest.raises(Exception, match="several partitions"):
        split.write.format("ordered_text").option("path", str(out)).mode("append").save()
    assert not out.exists() or os.listdir(out) == []


def test_metric_files(spark, tmp_path):
    rows = spark.createDataFrame([("m", 10, 1.5, 'a"b'), ("m", 2, None, "x,y"), ("n", 0, 0.1, "")], "source string, scene long, q double, note string")
    total = rows.withColumn("scene", F.col("scene").cast("string")).unionByName(spark.createDataFrame([("m", "total", 1.5, None)], "source string, scene string, q double, note string"))
    ordered_text.write_ordered(ordered_text.csv_lines(total, "source", "scene", ["scene", "q", "note"]), str(tmp_path / "out"), ".csv")
    assert open(tmp_path / "out" / "m.csv").read() == 'scene,q,note\n2,,"x,y"\n10,1.5,"a""b"\ntotal,1.5,\n'
    assert open(tmp_path / "out" / "n.csv").read() == "scene,q,note\n0,0.1,\n"


def test_lines_keep_their_numbers_in_several_splits(spark, tmp_path):
    lines = {"a": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b": ["", "only", ""], "c": []}
    for n, ls in lines.items():
        (tmp_path / n).write_text("".join(x + "\n" for x in ls))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = texts.numbered_lines(spark, str(tmp_path)).collect()
        assert len({r.block for r in spark.read.text(str(tmp_path)).select(F.col("_metadata.file_block_start").alias("block")).collect()}) > 5
        scenes = [(10 * i, 10 * i + 10) for i in range(2000)]
        (tmp_path / "scenes").write_text("# head\n" + "".join(f"scene {i:4d}  frames [{s:8d}, {e:8d})\n" for i, (s, e) in enumerate(reversed(scenes))))
        got = texts.ordered_scenes(spark, str(tmp_path / "scenes"))
        assert [(r.start_frame, r.end_frame) for r in got.orderBy("scene").collect()] == scenes[::-1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in found:
        got.setdefault(os.path.basename(r.path), {})[r.line] = r.value
    assert got == {n: dict(enumerate(ls)) for n, ls in lines.items() if ls}


def test_hdr_probe_reads_the_first_frame_only(spark):
    rows = [
        '{"streams":[{"color_transfer":"smpte2084"}],"frames":[{"side_data_list":[{"side_data_type":"HDR Dynamic Metadata SMPTE2094-40 (HDR10+)"}]}]}',
        '{"streams":[{"color_transfer":"bt709"}],"frames":[{"side_data_list":[]},{"side_data_list":[{"side_data_type":"DOVI configuration record"}]}]}',
        '{"frames":[{"side_data_list":[{"pieces":[{"deep":{"side_data_type":"Dolby Vision Metadata"}}]}]}]}', "{}", "no json", None,
        '{"streams":[{"color_transfer":"arib-std-b67,x"}]}',
    ]
    df = texts.hdr_probe(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, value string"))
    got = {r.i: r.args for r in df.select("i", rules.hdr_args(F.col("transfer"), F.col("side_data")).alias("args")).collect()}
    hdr, plus, dv = ["--master-display", "copy", "--max-cll", "copy"], ["--dhdr10-info", "copy"], ["--dolby-vision-rpu", "copy", "--dolby-vision-profile", "10.1"]
    assert got == {0: hdr + plus, 1: [], 2: dv, 3: [], 4: [], 5: [], 6: hdr}


def test_one_bad_part_voids_its_source(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "bad"), ("b", 1, None), (None, 1, None), (None, 2, None), ("c", 1, "bad")], "s string, part int, err string")
    got = {(r.s, r.part) for r in metrics.whole_groups(rows, "s", F.col("err").isNotNull()).collect()}
    assert got == {("b", 1), (None, 1), (None, 2)}
    nulls = rows.withColumn("err", F.when(F.col("s").isNull(), F.lit("x")))
    assert {r.s for r in metrics.whole_groups(nulls, "s", F.col("err") == "x").collect()} == {"a", "b", "c"}


def test_parallelism_to_wall_time(spark):
    rows = spark.createDataFrame([("x", 0.0, 4.0), ("x", 1.0, 5.0), ("x", None, 9.0), ("y", 3.0, 3.0)], "g string, begin double, end double")
    got = {r.g: (r.busy, r.wall, r.ratio) for r in metrics.parallelism(rows, ["g"], "begin", "end").collect()}
    assert got == {"x": (8.0, 5.0, 1.6), "y": (0.0, 0.0, None)}


def test_metric_files_of_several_sources(spark, tmp_path):
    import csv
    import random

    rng = random.Random(2)
    rows, shape = [], "source string, scene long, start_frame long, end_frame long, frames long, seek string, trim string, encode_sec double, fps double, size_mb double, ssim_all double, ssim_db double, psnr_avg double, ssim_y double, psnr_y double"
    for source in ("a", "b"):
        for i in range(12):
            n = rng.randrange(1, 300)
            measured = [rng.random() if rng.random() < 0.8 else None for _ in range(4)]
            rows.append((source, i, 10 * i, 10 * i + n, n, "00:00:01.000", f"0:{n}", round(rng.random() * 9, 2), 24.5, round(rng.random() * 5, 2), *measured, None))
    ordered_text.write_metric_files(spark.createDataFrame(rows, shape).repartition(5), str(tmp_path / "out"), "source")
    for source in ("a", "b"):
        got = list(csv.DictReader(open(tmp_path / "out" / f"{source}.csv", newline="")))
        mine = [r for r in rows if r[0] == source]
        assert list(got[0]) == list(ordered_text.METRICS) and [g["scene"] for g in got] == [*(str(i) for i in range(12)), "total"]
        assert [g["seek"] for g in got] == ["00:00:01.000"] * 12 + [""] and all(float(g["encode_sec"]) == r[7] for g, r in zip(got, mine))
        total = got[-1]
        assert int(total["frames"]) == sum(r[4] for r in mine) and float(total["encode_sec"]) == round(sum(r[7] for r in mine), 1) and float(total["size_mb"]) == round(sum(r[9] for r in mine), 1)
        for k, c in enumerate(("ssim_all", "ssim_db", "psnr_avg", "ssim_y")):
            known = [(r[4], r[10 + k]) for r in mine if r[10 + k] is not None]
            assert float(total[c]) == pytest.approx(sum(n * v for n, v in known) / sum(n for n, _ in known), abs=1e-5)
        assert total["psnr_y"] == "" and total["start_frame"] == ""
