"""Frames to spans: windows, overlap-add, hysteresis, runs, gaps, top-k, spans and text lines, all as joins and windows.

Tables are keyed by `rec` (a recording). Every window partitions by rec, and by what else tells sequences apart.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The highest cluster that a grid takes, and the most clusters that a frame counts.
MOST_CLUSTER, MOST_COUNT = 1023, 64


def checked(value: Column, *faults: tuple[Column, str]) -> Column:
    """value, or an error for the first of the faults (condition, code) that holds."""
    out = F.lit(None)
    for bad, code in reversed(faults):
        out = F.when(bad, F.raise_error(F.lit(code))).otherwise(out)
    # The error is part of the value, so it can't be left out of the plan.
    return F.coalesce(out.cast("double"), value) if faults else value


def check_timing(*steps: float) -> None:
    """Durations and steps are finite and above 0."""
    if not all(math.isfinite(x) and x > 0 for x in steps):
        raise ValueError("NonPositiveDurationOrStep")


def check_gap(min_duration_off: float) -> None:
    if not (math.isfinite(min_duration_off) and min_duration_off >= 0):
        raise ValueError("MinDurationOffOutOfRange")


def check_epsilon(epsilon: float | None) -> None:
    if epsilon is not None and not (math.isfinite(epsilon) and epsilon >= 0):
        raise ValueError("SmoothingEpsilonOutOfRange")


def duration_to_samples(seconds: Column, rate: int = 16000) -> Column:
    """Whole samples of a duration, rounded down."""
    return F.floor(seconds * rate)


def plan_starts(recs: DataFrame, window: int, step: int) -> DataFrame:
    """rec, start: windows every `step` samples that fit into `total`, and one that ends with it; one at 0 if total is shorter."""
    fit = F.expr(f"CASE WHEN total >= {window} THEN sequence(0L, total - {window}, {step}L) WHEN total > 0 THEN array(0L) ELSE CAST(array() AS array<bigint>) END")
    tail = F.when(F.col("total") > 0, F.array(F.greatest(F.lit(0), F.col("total") - window).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return recs.select("rec", F.explode(F.array_union(fit, tail)).alias("start"))


def hysteresis(frames: DataFrame, onset: float, offset: float, keys: tuple[str, ...] = ("rec",), order: str = "frame", p: str = "p") -> DataFrame:
    """frames plus `on`: true from a value of onset or more until one below offset (offset <= onset)."""
    if not (0 <= onset <= 1 and 0 <= offset <= 1):
        raise ValueError("thresholds are 0 to 1")
    if offset > onset:
        raise ValueError("offset is above onset")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    switch = F.when(F.col(p) >= onset, True).when(F.col(p) < offset, False)
    return frames.withColumn("on", F.coalesce(F.last(switch, ignorenulls=True).over(w), F.lit(False)))


def runs(frames: DataFrame, keys: tuple[str, ...] = ("rec",), order: str = "frame", on: str = "on") -> DataFrame:
    """keys, first, stop: runs of neighbouring frames that are on; stop is one past the last."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return frames.filter(on).withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(order).alias("first"), (F.max(order) + 1).alias("stop")).drop("_i")


def merge_gaps(spans: DataFrame, gap: float, keys: tuple[str, ...] = ("rec",), first: str = "first", stop: str = "stop") -> DataFrame:
    """Spans that are at most `gap` apart become one."""
    w = Window.partitionBy(*keys).orderBy(first, stop)
    so_far = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(first) - so_far <= gap, 0).otherwise(1)
    out = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return out.groupBy(*keys, "_run").agg(F.min(first).alias(first), F.max(stop).alias(stop)).drop("_run")


def long_enough(spans: DataFrame, least: float, first: str = "first", stop: str = "stop") -> DataFrame:
    """Without empty spans and those shorter than `least`."""
    return spans.filter((F.col(stop) > F.col(first)) & (F.col(stop) - F.col(first) >= least))


def in_windows(frames: DataFrame, size: int, step: int, order: str = "frame") -> DataFrame:
    """frames once for each window (chunk) of `size` frames, every `step`, that holds them, with `at`: the place in it.

    The chunks of a frame follow from its number, so no join is made.
    """
    last = F.floor(F.col(order) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col(order) - size + 1) / step))
    out = frames.withColumn("chunk", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return out.withColumn("at", (F.col(order) - F.col("chunk") * step).cast("int")).filter(f"at BETWEEN 0 AND {size - 1}")


def stitched_mean(windows: DataFrame, value: str = "p", keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """keys, frame, mean: the mean over the windows that hold a frame."""
    return windows.groupBy(*keys, "frame").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("overlaps"))


def active_count(seg: DataFrame, onset: float, chunk_step: float, frame_step: float) -> DataFrame:
    """rec, t, cnt: of (rec, chunk, at, slot, activity), active slots in each chunk's frame, then their mean over chunks, rounded to even."""
    per = seg.groupBy("rec", "chunk", "at").agg(F.sum(F.when(F.col("activity") >= onset, 1).otherwise(0)).alias("active"))
    t = (F.rint(F.col("chunk") * F.lit(chunk_step) / F.lit(frame_step)) + F.col("at")).cast("int")
    return per.groupBy("rec", t.alias("t")).agg(F.least(F.lit(255), F.rint(F.avg("active"))).cast("int").alias("cnt"))


def fill_grid(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """rec, t, cnt for every t below the recording's `frames`; 0 where counts has none."""
    grid = sizes.select("rec", F.explode(F.expr("IF(frames > 0, sequence(0, CAST(frames AS int) - 1), CAST(array() AS array<int>))")).alias("t"))
    return grid.join(counts, ["rec", "t"], "left").select("rec", "t", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def hamming_add(windows: DataFrame, size: int, value: str = "p") -> DataFrame:
    """rec, frame, total: the sum over windows of the value times the window's Hamming weight; not divided by the weights."""
    weight = F.lit(1.0) if size < 2 else 0.54 - 0.46 * F.cos(2 * math.pi * F.col("at") / (size - 1))
    return windows.groupBy("rec", "frame").agg(F.sum(F.col(value) * weight).alias("total"))


def clustered(seg: DataFrame, hard: DataFrame) -> DataFrame:
    """rec, chunk, at, cluster, activity: the largest activity of the slots that have a cluster; unmatched slots (-2) go.

    Other negative clusters fail with HardClustersNegativeId, those above MOST_CLUSTER with HardClustersIdAboveMax, and
    activities that aren't finite with NonFiniteSegmentations.
    """
    of = hard.filter(checked(F.col("cluster"), ((F.col("cluster") < 0) & (F.col("cluster") != -2), "HardClustersNegativeId"), (F.col("cluster") > MOST_CLUSTER, "HardClustersIdAboveMax")) >= 0)
    bad = F.col("activity").isNull() | F.isnan("activity") | (F.abs("activity") == float("inf"))
    seg = seg.withColumn("activity", checked(F.col("activity"), (bad, "NonFiniteSegmentations")))
    return seg.join(of, ["rec", "chunk", "slot"]).groupBy("rec", "chunk", "at", "cluster").agg(F.max("activity").alias("activity"))


def overlap_sum(clusters: DataFrame, chunk_start: float, chunk_step: float, frame_start: float, frame_duration: float, frame_step: float) -> DataFrame:
    """rec, t, cluster, activation: activities of all chunks, added at the closest output frame."""
    check_timing(chunk_step, frame_duration, frame_step)
    begin = F.lit(chunk_start) + F.col("chunk") * chunk_step + frame_duration / 2
    t = (F.rint((begin - frame_start - frame_duration / 2) / frame_step) + F.col("at")).cast("int")
    return clusters.groupBy("rec", t.alias("t"), "cluster").agg(F.sum("activity").alias("activation")).filter("t >= 0")


def top_clusters(activation: DataFrame, counts: DataFrame) -> DataFrame:
    """rec, t, cluster: of each frame's clusters, as many as its count, the most active first, of equals the lowest.

    All clusters below the recording's number of clusters stand for election, those without activity too.
    """
    counts = counts.withColumn("cnt", checked(F.col("cnt"), (F.col("cnt") > MOST_COUNT, "CountAboveMax")).cast("int"))
    wanted = _with_active(activation, counts.filter("cnt > 0"), counts)
    # Of the clusters without activity only the lowest cnt can be chosen.
    low = F.sequence(F.lit(0), F.least(F.col("k"), F.col("cnt") + F.size("active")).cast("int") - 1)
    idle = F.filter(low, lambda c: ~F.exists("active", lambda x: x["cluster"] == c))
    best = F.slice(F.sort_array(F.concat("active", F.transform(idle, lambda c: F.struct(F.lit(0.0).alias("less"), c.alias("cluster"))))), F.lit(1), F.col("cnt"))
    return wanted.select("rec", "t", F.explode(best).alias("x")).select("rec", "t", "x.cluster")


def _with_active(activation: DataFrame, frames: DataFrame, counts: DataFrame) -> DataFrame:
    """frames with active, each frame's clusters as (less: the activation's negative, cluster), and k, the clusters of the recording."""
    most = activation.groupBy("rec").agg((F.max("cluster") + 1).alias("_k"))
    most = most.join(counts.groupBy("rec").agg(F.greatest(F.max("cnt"), F.lit(1)).alias("_c")), "rec").select("rec", F.greatest("_k", "_c").alias("k"))
    cell = F.struct((F.lit(0.0) - F.coalesce("activation", F.lit(0.0))).alias("less"), F.col("cluster").cast("int").alias("cluster"))
    packed = activation.groupBy("rec", "t").agg(F.collect_list(cell).alias("active"))
    none = F.array().cast("array<struct<less:double,cluster:int>>")
    return frames.join(most, "rec").join(packed, ["rec", "t"], "left").withColumn("active", F.coalesce("active", none))


def grid_to_spans(grid: DataFrame, sizes: DataFrame, start: float, duration: float, step: float, min_duration_off: float = 0.0) -> DataFrame:
    """rec, cluster, start, end in seconds of runs of the grid (rec, t, cluster); sizes has the frames of each recording.

    A span ends at the middle of the first frame that is off, or of the last frame of all; gaps of min_duration_off or less close.
    """
    check_timing(duration, step)
    check_gap(min_duration_off)
    keys = ("rec", "cluster")
    found = runs(grid, keys, "t", "cluster >= 0").join(sizes.select("rec", (F.col("frames") - 1).alias("_last")), "rec")
    mid = lambda f: F.lit(start) + f * F.lit(step) + F.lit(duration / 2)
    out = found.select(*keys, mid(F.col("first")).alias("start"), mid(F.least("stop", "_last")).alias("end")).filter("end > start")
    return merge_gaps(out, min_duration_off, keys, "start", "end") if min_duration_off > 0 else out


def rttm_lines(spans: DataFrame, uri: Column | None = None) -> DataFrame:
    """rec, start, cluster, line: text lines with speaker labels in the order of the clusters' decimal text."""
    label = F.dense_rank().over(Window.partitionBy("rec").orderBy(F.col("cluster").cast("string"))) - 1
    name = uri if uri is not None else F.col("rec").cast("string")
    seconds = lambda c: F.call_function("format_number", c, F.lit("0.000"))
    text = F.concat(F.lit("SPEAKER "), name, F.lit(" 1 "), seconds(F.col("start")), F.lit(" "), seconds(F.col("end") - F.col("start")), F.lit(" <NA> <NA> SPEAKER_"), F.lpad(label.cast("string"), F.greatest(F.lit(2), F.length(label.cast("string"))), F.lit("0")), F.lit(" <NA> <NA>"))
    return spans.select("rec", "start", "cluster", text.alias("line"))


def stretches(counts: DataFrame, block: int = 4096) -> DataFrame:
    """counts (rec, t, cnt) with stretch: one more at each frame of count 0, from 0. A recording's blocks of frames are numbered side by side."""
    rows = counts.withColumn("_b", F.floor(F.col("t") / block)).withColumn("_z", (F.col("cnt") == 0).cast("long"))
    sums = rows.groupBy("rec", "_b").agg(F.sum("_z").alias("_n"))
    before = Window.partitionBy("rec").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rec", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("rec", "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_in", F.sum("_z").over(inside)).join(sums, ["rec", "_b"]).withColumn("stretch", F.col("_in") + F.col("_before")).drop("_b", "_z", "_in", "_before")


def smoothed_top(activation: DataFrame, counts: DataFrame, epsilon: float) -> DataFrame:
    """As top_clusters, but a cluster that was chosen in the frame before gains epsilon; equals go by activation, then number.

    A frame of count 0 chooses none, so what comes after it doesn't depend on what was before: a recording falls into
    stretches, which tasks share. A task reads its stretches' frames in order and holds one frame's choice, however long a
    stretch is. counts has all frames of a recording, each once.
    """
    check_epsilon(epsilon)
    rows = _with_active(activation, stretches(counts), counts).select("rec", "stretch", "t", "cnt", "k", "active")
    rows = rows.repartition("rec", "stretch").sortWithinPartitions("rec", "stretch", "t")

    def scan(batches):
        import pandas as pd

        at, before = None, set()
        for pdf in batches:
            out = []
            for rec, stretch, t, cnt, k, active in pdf.itertuples(index=False):
                if (rec, stretch) != at:
                    at, before = (rec, stretch), set()
                raw = {x["cluster"]: -x["less"] for x in active}
                idle = [c for c in range(min(k, cnt + len(raw))) if c not in raw]
                gained = {c: raw.get(c, 0.0) + (epsilon if c in before else 0.0) for c in {*raw, *before, *idle}}
                before = set(sorted(gained, key=lambda c: (-gained[c], -raw.get(c, 0.0), c))[:cnt])  # noqa: B023
                out += [(rec, t, c) for c in sorted(before)]
            yield pd.DataFrame(out, columns=["rec", "t", "cluster"]).astype({"rec": "int64", "t": "int32", "cluster": "int32"})

    return rows.mapInPandas(scan, "rec long, t int, cluster int")
