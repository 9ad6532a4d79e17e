"""Cuts and scenes of ordered, scored frames: (source_id, frame, score) with frames 0..N-1 in each source."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.sources.tables import near, settled

from .ordered import _carried, _with, neighbours, running_sum, within

#: Frames of a source that one task takes at a time.
PART = 1 << 16


def candidate_cuts(frames: DataFrame, width: int = 2, least: int = 1500, ratio: int = 3, part: int = PART) -> DataFrame:
    """(source_id, frame) whose score is at least `least` and `ratio` times the mean of its 2 * width neighbours."""
    near = neighbours(frames.select("source_id", "frame", "score"), ["source_id"], "frame", part, width)
    w = Window.partitionBy("source_id", "_part").orderBy("frame").rowsBetween(-width, width)
    rolled = near.withColumn("_sum", F.sum("score").over(w)).withColumn("_n", F.count("*").over(w))
    cut = (F.col("_n") == 2 * width + 1) & (F.col("score") >= least) & (2 * width * F.col("score") >= ratio * (F.col("_sum") - F.col("score")))
    return rolled.filter(F.col("_own") & cut).select("source_id", "frame")


def _follow(frames: np.ndarray, gap: int) -> np.ndarray:
    """For each candidate, the index of the one accepted after it (len(frames) for none)."""
    return np.searchsorted(frames, frames + gap)


def min_gap(cuts: DataFrame, gap: int, part: int = PART) -> DataFrame:
    """The cuts accepted in order, each at least `gap` after the last accepted one; frame 0 counts as accepted.

    Acceptance is sequential, but within a part it depends only on where the part is entered: at one of its first
    candidates. Each part maps every entry to its exit; the entries are followed over these small maps, a row for
    each candidate in the first `gap` frames of a part; then all parts mark what they accept.
    """
    size = max(part, 4 * gap)
    parts = settled(cuts.select("source_id", "frame", F.floor(F.col("frame") / size).alias("part")).distinct(), "candidates")

    def exits(key: tuple, frame: np.ndarray) -> dict[str, np.ndarray]:
        follow = _follow(frame, gap)
        # where the part may be entered: at any candidate in its first frames, or at the first one after them
        entries = np.arange(min(len(frame), np.searchsorted(frame, key[1] * size + gap) + 1))
        last = entries.copy()
        while len(last) and (follow[last] < len(frame)).any():
            go = follow[last] < len(frame)
            last[go] = follow[last[go]]
        return {"source_id": np.full(len(last), key[0]), "part": np.full(len(last), key[1]), "entry": frame[entries], "last": frame[last]}

    maps = _by_group(parts, ["source_id", "part"], ["frame"], exits, "source_id long, part long, entry long, last long")

    def walk(key: tuple, part: np.ndarray, entry: np.ndarray, last: np.ndarray) -> dict[str, np.ndarray]:
        free, out = gap, []
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            at = a + int(np.searchsorted(entry[a:b], free))
            if at < b:
                out.append(at)
                free = int(last[at]) + gap
        return {"source_id": np.full(len(out), key[0]), "part": part[out], "entry": entry[out]}

    entered = _by_group(maps, ["source_id"], ["part", "entry", "last"], walk, "source_id long, part long, entry long")

    def accept(key: tuple, frame: np.ndarray, entry: np.ndarray) -> dict[str, np.ndarray]:
        at, out = int(np.searchsorted(frame, entry[0])), []
        follow = _follow(frame, gap)
        while at < len(frame):
            out.append(at)
            at = follow[at]
        return {"source_id": np.full(len(out), key[0]), "frame": frame[out]}

    return _by_group(parts.join(entered, ["source_id", "part"]), ["source_id", "part"], ["frame", "entry"], accept, "source_id long, frame long")


def _by_group(rows: DataFrame, keys: list[str], order: list[str], step: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """step(key, *columns in order) of each group of rows, its columns as arrays sorted by `order`.

    Groups stream through sorted partitions, so a task holds one group and one batch, and a small group costs no more than its arrays.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            columns = [batch[c].to_numpy() for c in [*keys, *order]]
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)] if held else columns
            ids = columns[: len(keys)]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ids], axis=0)) + 1 if len(ids[0]) else np.zeros(0, dtype=np.int64)
            # the last group may go on in the next batch
            held = [c[edges[-1] if len(edges) else 0 :] for c in columns]
            if len(edges):
                yield gathered(columns, np.append(0, edges))
        if held and len(held[0]):
            yield gathered(held, np.array([0, len(held[0])]))

    def gathered(columns: list[np.ndarray], edges: np.ndarray) -> pd.DataFrame:
        found = [step(tuple(int(c[a]) for c in columns[: len(keys)]), *(c[a:b] for c in columns[len(keys) :])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in names})

    return rows.select(*keys, *order).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def scenes(cuts: DataFrame, totals: DataFrame, part: int = PART) -> DataFrame:
    """(source_id, scene, start_frame, end_frame): a contiguous partition of [0, total) of each source that cuts divide.

    totals has (source_id, total); a source of total 0 has no scene, one without cuts has one.
    """
    whole = totals.filter("total > 0")
    inner = cuts.join(whole, "source_id").filter("frame > 0 AND frame < total").select("source_id", "frame").distinct()
    starts = settled(inner.unionByName(whole.select("source_id", F.lit(0).cast("long").alias("frame"))).withColumn("_bucket", F.floor(F.col("frame") / part)), "starts")
    w = Window.partitionBy("source_id", "_bucket").orderBy("frame")
    inside = starts.withColumn("_next", F.lead("frame").over(w)).withColumn("_one", F.lit(1).cast("long"))
    first = starts.groupBy("source_id", "_bucket").agg(F.min("frame").alias("_s")).withColumn("_bucket", -F.col("_bucket"))
    after = _carried(first, ["source_id"], "_bucket", F.last("_s")).withColumn("_bucket", -F.col("_bucket"))
    ended = _with(inside, after, ["source_id"], "_bucket").join(whole, "source_id").withColumn("end_frame", F.coalesce("_next", "_before", "total"))
    numbered = running_sum(ended.drop("_before"), ["source_id"], ["frame"], "_bucket", "_one", "scene")
    return numbered.select("source_id", "scene", F.col("frame").alias("start_frame"), "end_frame")


def merged(parts: DataFrame, joins: DataFrame, part: int = PART) -> DataFrame:
    """Intervals (source_id, start_frame, end_frame) where one that starts at its predecessor's end and at a frame of
    `joins` (source_id, frame) is merged into it, in chains."""
    rows = parts.select("source_id", "start_frame", "end_frame")
    ends = rows.select("source_id", F.col("end_frame").alias("start_frame")).distinct().withColumn("_meets", F.lit(True))
    soft = joins.select("source_id", F.col("frame").alias("start_frame")).distinct().withColumn("_soft", F.lit(True))
    flagged = rows.join(ends, ["source_id", "start_frame"], "left").join(soft, ["source_id", "start_frame"], "left")
    opens = flagged.withColumn("_open", (~F.coalesce(F.col("_meets") & F.col("_soft"), F.lit(False))).cast("long")).withColumn("_bucket", F.floor(F.col("start_frame") / part))
    islands = running_sum(opens, ["source_id"], ["start_frame"], "_bucket", "_open", "_island", inclusive=True)
    return islands.groupBy("source_id", "_island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")).drop("_island")


def sanitized(boundaries: DataFrame, totals: DataFrame) -> DataFrame:
    """Boundaries (source_id, ord, frame, ...) within [0, total]; of several at a frame, the last by ord."""
    rest = [c for c in boundaries.columns if c not in ("source_id", "frame", "total")]
    kept = boundaries.join(totals.select("source_id", "total"), "source_id").filter("frame BETWEEN 0 AND total")
    return kept.groupBy("source_id", "frame").agg(F.max_by(F.struct(*rest), "ord").alias("_r")).select("source_id", "frame", "_r.*")


def marks(totals: DataFrame, jobs: int) -> DataFrame:
    """(source_id, mark): jobs - 1 evenly spaced frames of each source, rounded half to even."""
    if jobs < 2:
        return totals.select("source_id", F.col("total").alias("mark")).limit(0)
    return totals.select("source_id", F.explode(F.sequence(F.lit(1), F.lit(jobs - 1))).alias("i"), "total").select("source_id", F.rint(F.col("total") * F.col("i") / jobs).cast("long").alias("mark"))


def worth_splitting(total: int | None, jobs: int, min_len: int, fps: float, least: float = 60.0) -> bool:
    """Whether a source is long enough to be cut into segments for `jobs` tasks."""
    return total is not None and jobs >= 2 and total >= jobs * shortest_span(min_len, fps, least)


def shortest_span(min_len: int, fps: float, least: float = 60.0) -> int:
    """Frames that each of a source's segments should have: two shortest scenes, and `least` seconds."""
    return max(2 * min_len, round(least * fps))


def contiguous(ready: DataFrame, by: str, on: str, begin: int = 0) -> DataFrame:
    """(by, run): how many values begin, begin + 1, ... each group has without a gap. By joins, so a hot group is no one task's.

    A null group is a group; a null value is none.
    """
    have = ready.filter(F.col(on) >= begin).select(F.col(by).alias("g"), F.col(on).alias("v")).distinct()
    x, y = have.alias("x"), have.select("g", (F.col("v") - 1).alias("v")).alias("y")
    last = x.join(y, F.col("x.g").eqNullSafe(F.col("y.g")) & (F.col("x.v") == F.col("y.v")), "left_anti").groupBy("g").agg(F.min("v").alias("_end"))
    opened = have.filter(F.col("v") == begin).select("g", F.lit(True).alias("_open"))
    groups = ready.select(by).distinct().alias("a")
    both = groups.join(opened.alias("o"), F.col(f"a.{by}").eqNullSafe(F.col("o.g")), "left").join(last.alias("l"), F.col(f"a.{by}").eqNullSafe(F.col("l.g")), "left")
    return both.select(F.col(f"a.{by}").alias(by), F.when(F.col("_open"), F.col("_end") - begin + 1).otherwise(F.lit(0)).cast("long").alias("run"))


def incomplete(runs: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """(by, run, expected) of the groups of expected (by, expected) that reach less far without a gap than they should."""
    r = runs.select(F.col(by).alias("_by"), "run")
    both = expected.select(by, "expected").join(r, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, F.coalesce("run", F.lit(0)).alias("run"), "expected")
    return both.filter("run <> expected")


def require_complete(runs: DataFrame, expected: DataFrame, by: str) -> None:
    """ValueError where a group is incomplete at the end: what waits for a missing part is never skipped."""
    bad = incomplete(runs, expected, by).limit(1).collect()
    if bad:
        raise ValueError(f"{by} {bad[0][0]}: {bad[0].run} of {bad[0].expected} parts")


def sliced(scenes: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """The scenes from number `low` (0 at least) up to `high` of each source; a negative `high` counts from the source's end.

    Also `partial`: whether that is less than the whole of the source.
    """
    count = scenes.groupBy("source_id").agg(F.count("*").alias("_n"))
    begin = max(0, low)
    end = F.col("_n") if high is None else F.lit(high) if high >= 0 else F.col("_n") + high
    whole = (F.lit(begin) == 0) & (F.col("_n") == end)
    return scenes.join(count, "source_id").filter((F.col("scene") >= begin) & (F.col("scene") < end)).withColumn("partial", ~whole).drop("_n")


def require_scenes(scenes: DataFrame) -> DataFrame:
    """The scenes; ValueError for an empty range."""
    if not scenes.limit(1).count():
        raise ValueError("an empty range of scenes")
    return scenes


def _in_windows(rows: DataFrame, windows: DataFrame, part: int = PART) -> DataFrame:
    """rows (source_id, frame, ...) with the columns of each window (settled: source_id, low, high, ...) that holds them: low <= frame < high.

    Windows and rows meet on stretches of `part` frames of a source, so no join is by source alone.
    """
    spots = windows.filter("high > low").withColumn("_spot", F.explode(F.sequence(F.floor(F.col("low") / part), F.floor((F.col("high") - 1) / part))))
    met = rows.withColumn("_spot", F.floor(F.col("frame") / part)).join(near(settled(spots, "window-spots")), ["source_id", "_spot"])
    return met.filter("frame >= low AND frame < high").drop("_spot")


def windowed_candidates(frames: DataFrame, windows: DataFrame, jobs: int, halo: int = 0, width: int = 2) -> DataFrame:
    """(source_id, part, frame): candidate cuts by the frames of each window (source_id, part, begin, end) and `halo` more to either side.

    Without a halo, frames outside give no neighbours; with one of `width`, the cuts inside are those of the whole source.
    """
    spans = settled(windows.select(
        "source_id", "part", "begin", "end", (F.col("source_id") * jobs + F.col("part")).alias("_id"),
        F.greatest(F.lit(0).cast("long"), F.col("begin") - halo).alias("low"), (F.col("end") + halo).alias("high")), "spans")
    inside = _in_windows(frames.select("source_id", "frame", "score"), spans)
    own = inside.select(F.col("_id").alias("source_id"), (F.col("frame") - F.col("low")).alias("frame"), "score")
    found = candidate_cuts(own, width=width).withColumnRenamed("source_id", "_id")
    back = found.join(near(spans), "_id").withColumn("frame", F.col("frame") + F.col("low"))
    return back.filter("frame >= begin AND frame < end").select("source_id", "part", "frame")


def windowed_cuts(frames: DataFrame, windows: DataFrame, gap: int, jobs: int) -> DataFrame:
    """(source_id, part, frame): the cuts that detection finds which reads only the frames of a window.

    windows has (source_id, part, begin, end) with parts 0 to jobs - 1. A window's first frame counts as accepted, and
    frames outside give no neighbours.
    """
    spans = settled(windows.select("source_id", "part", "begin", (F.col("source_id") * jobs + F.col("part")).alias("_id")), "window-ids")
    found = windowed_candidates(frames, windows, jobs).join(near(spans), ["source_id", "part"])
    kept = min_gap(found.select(F.col("_id").alias("source_id"), (F.col("frame") - F.col("begin")).alias("frame")), gap).withColumnRenamed("source_id", "_id")
    return kept.join(near(spans), "_id").select("source_id", "part", (F.col("frame") + F.col("begin")).alias("frame"))


def boundaries(frames: DataFrame, keys: DataFrame, totals: DataFrame, jobs: int, gap: int, fps: float, before: float = 14.0, lead: float = 10.0, after: float = 30.0) -> DataFrame:
    """(source_id, part, mark, frame, is_cut): for each mark, the keyframe nearest to the first cut at or after it.

    Only a window of frames is read: from the last keyframe at least `lead` seconds before the mark (else the first
    within `before` seconds) to `after` seconds past it. is_cut: whether keyframe and cut are at most a frame apart. A mark
    without a keyframe or a cut in its window gives none.
    """
    at = marks(totals, jobs).withColumn("frame", F.col("mark"))
    low, high, ahead = round(before * fps), round(after * fps), round(lead * fps)
    near_keys = within(at, keys.select("source_id", "frame"), ["source_id"], "frame", -low, high)
    begin = F.coalesce(F.max(F.when(F.col("r_frame") <= F.col("mark") - ahead, F.col("r_frame"))), F.min("r_frame"))
    windows = near_keys.groupBy("source_id", "mark").agg(begin.alias("begin"))
    order = Window.partitionBy("source_id").orderBy("mark")
    windows = windows.withColumn("part", F.row_number().over(order) - 1).withColumn("end", F.col("mark") + high)
    near_keys, windows = settled(near_keys, "near-keys"), settled(windows, "windows")
    cuts = settled(windowed_cuts(frames, windows, gap, jobs), "window-cuts").join(near(windows.select("source_id", "part", "mark")), ["source_id", "part"])
    first = cuts.filter("frame >= mark").groupBy("source_id", "part", "mark").agg(F.min("frame").alias("cut"))
    pairs = first.join(near_keys.select("source_id", "mark", F.col("r_frame").alias("key")), ["source_id", "mark"])
    best = pairs.groupBy("source_id", "part", "mark", "cut").agg(F.min(F.struct(F.abs(F.col("key") - F.col("cut")).alias("off"), "key")).alias("x"))
    return best.select("source_id", "part", "mark", F.col("x.key").alias("frame"), (F.col("x.off") <= 1).alias("is_cut"))


def segments(found: DataFrame, totals: DataFrame, jobs: int) -> DataFrame:
    """(source_id, part, begin, end, joins): each source cut at its boundaries, with 0 and its total as outer ones.

    joins: whether the segment begins at a keyframe that is no cut, so that its first scene belongs to the one before.
    """
    outer = totals.filter("total > 0").select("source_id", F.explode(F.array(F.struct(F.lit(-1).alias("ord"), F.lit(0).cast("long").alias("frame")), F.struct(F.lit(jobs).alias("ord"), F.col("total").cast("long").alias("frame")))).alias("x"))
    every = outer.select("source_id", "x.ord", "x.frame", F.lit(True).alias("is_cut")).unionByName(found.select("source_id", F.col("part").cast("int").alias("ord"), "frame", "is_cut"))
    clean = sanitized(every, totals)
    w = Window.partitionBy("source_id").orderBy("frame")  # at most jobs + 1 rows a source
    pairs = clean.withColumn("end", F.lead("frame").over(w)).withColumn("part", F.row_number().over(w) - 1)
    return pairs.filter("end IS NOT NULL").select("source_id", "part", F.col("frame").alias("begin"), "end", (~F.col("is_cut")).alias("joins"))


def segmented(frames: DataFrame, keys: DataFrame, totals: DataFrame, jobs: int, gap: int, fps: float, least: float = 60.0, width: int = 2, **window: float) -> DataFrame:
    """(source_id, start_frame, end_frame) of the scenes that are found segment by segment: the same as in one pass over each source.

    Sources with fewer than `jobs` times the shortest span of frames, or without a boundary inside, are one segment. A
    segment is judged with the frames of a halo on either side, and the last accepted cut is handed from segment to
    segment (`min_gap` maps how each may be entered to how it is left). The scene before a boundary that is no accepted
    cut goes on behind it.
    """
    whole = settled(totals.filter("total > 0").select("source_id", "total"), "totals")
    long = whole.filter(F.col("total") >= jobs * shortest_span(gap, fps, least)) if jobs >= 2 else whole.limit(0)
    cut = segments(boundaries(frames, keys, long, jobs, gap, fps, **window), long, jobs + 1)
    rest = whole.join(long.select("source_id"), "source_id", "left_anti").select("source_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("begin"), F.col("total").alias("end"), F.lit(False).alias("joins"))
    parts = settled(cut.unionByName(rest), "segments")
    found = settled(windowed_candidates(frames, parts, jobs + 1, halo=width, width=width).select("source_id", "frame"), "segment-candidates")
    cuts = settled(min_gap(found, gap), "segment-cuts")
    edges = parts.filter("begin > 0").select("source_id", F.col("begin").alias("frame"))
    return merged(scenes(cuts.unionByName(edges), whole), edges.join(cuts, ["source_id", "frame"], "left_anti"))


def segment_lengths(parts: DataFrame) -> DataFrame:
    """(source_id, part, length) from scenes relative to their segment (source_id, part, start_frame, end_frame): the end of the last."""
    return parts.groupBy("source_id", "part").agg(F.max_by("end_frame", "start_frame").alias("length"))
