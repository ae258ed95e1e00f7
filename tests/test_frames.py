import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlake.functions import frames as FR
from turnlake.operators import frames as O
from turnlake.operators import segmentation as G


def table(spark, values, name="p"):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], f"rec long, frame long, {name} double")


def test_hysteresis_and_runs(spark):
    # On at 0.7 and more; 0.65 and 0.31 don't end it, 0.29 does; 0.69 is too low to start again.
    got = O.hysteresis(table(spark, [0.69, 0.7, 0.31, 0.65, 0.3, 0.29, 0.69, 0.9, 0.1]), 0.7, 0.3).orderBy("frame")
    states = [r["on"] for r in got.collect()]
    assert states == [False, True, True, True, True, False, False, True, False]
    assert sorted((r["first"], r["stop"]) for r in O.runs(got).collect()) == [(1, 5), (7, 8)]
    with pytest.raises(ValueError):
        O.hysteresis(table(spark, [0.1]), 0.2, 0.9)
    with pytest.raises(ValueError):
        O.hysteresis(table(spark, [0.1]), 1.2, 0.9)


def machine(values, onset, offset):
    on, out = False, []
    for v in values:
        on = v >= offset if on else v >= onset
        out.append(on)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10), min_size=1, max_size=60), st.integers(0, 10), st.integers(0, 10))
def test_hysteresis_is_the_state_machine(spark, values, a, b):
    onset, offset = max(a, b) / 10, min(a, b) / 10
    values = [v / 10 for v in values]
    got = O.hysteresis(table(spark, values), onset, offset).orderBy("frame").collect()
    assert [r["on"] for r in got] == machine(values, onset, offset)


def test_plan_starts(spark):
    recs = spark.createDataFrame([(1, 1000), (2, 1010), (3, 300), (4, 299), (5, 0)], "rec long, total long")
    got = {}
    for r in O.plan_starts(recs, 300, 175).collect():
        got.setdefault(r["rec"], []).append(r["start"])
    # 1000: every 175 up to 700, which ends with the recording; 1010: one more, which ends there.
    assert {k: sorted(v) for k, v in got.items()} == {1: [0, 175, 350, 525, 700], 2: [0, 175, 350, 525, 700, 710], 3: [0], 4: [0]}


def test_samples_and_frames(spark):
    frames = range(0, 700, 13)
    df = spark.createDataFrame([(k,) for k in frames], "f long").select("f", FR.frame_to_sample(F.col("f")).alias("s"))
    rows = df.select("f", "s", FR.sample_to_frame(F.col("s") + 1).alias("back"), FR.total_frames(F.col("s")).alias("total"), O.duration_to_samples(F.col("f") / 100).alias("d")).collect()
    assert all(r["s"] == (r["f"] * 320000 + 589) // 1178 and r["back"] == (r["s"] + 1) * 589 // 160000 and r["total"] == -(-r["s"] * 589 // 160000) for r in rows)
    assert all(abs(r["back"] - r["f"]) <= 1 and r["d"] == int(r["f"] / 100 * 16000) for r in rows)


def test_stitched_mean_of_three_windows(spark):
    """Windows of 9, 5 and 7 frames that start at 0, 3 and 20, each of one value."""
    windows = ((0, 9, 0.25), (3, 5, 0.75), (20, 7, 0.6))
    rows = [(6, first + k, v) for first, n, v in windows for k in range(n)]
    got = {r["frame"]: (round(r["mean"], 9), r["overlaps"]) for r in O.stitched_mean(spark.createDataFrame(rows, "rec long, frame long, p double")).collect()}
    want = {f: [v for first, n, v in windows if first <= f < first + n] for f in range(30)}
    assert got == {f: (round(sum(v) / len(v), 9), len(v)) for f, v in want.items() if v}


def test_powerset(spark):
    rng = random.Random(6)
    for _ in range(5):
        raw = [rng.random() for _ in range(7)]
        p = [x / sum(raw) for x in raw]
        row = spark.createDataFrame([(p,)], "p array<double>")
        got = row.select(*FR.speaker_marginals(row["p"]), FR.voice_probability(row["p"])).first()
        pairs = {4: (0, 1), 5: (0, 2), 6: (1, 2)}
        want = [p[1 + s] + sum(p[c] for c, who in pairs.items() if s in who) for s in range(3)]
        assert all(math.isclose(a, b) for a, b in zip(got, [*want, sum(p[1:])], strict=True))
        best = p.index(max(p))
        who = pairs.get(best, (best - 1,) if best else ())
        assert list(row.select(*FR.speaker_hard(row["p"])).first()) == [float(s in who) for s in range(3)]


def test_spans_at_both_ends(spark):
    """Of 11 frames, cluster 5 has the first two and the last three, cluster 8 the last one alone, cluster 9 those before the last."""
    on = {5: [0, 1, 8, 9, 10], 8: [10], 9: [7, 8, 9]}
    sizes = spark.createDataFrame([(3, 11)], "rec long, frames long")
    grid = spark.createDataFrame([(3, t, c) for c, ts in on.items() for t in ts], "rec long, t int, cluster int")
    got = sorted((r["cluster"], round(r["start"], 6), round(r["end"], 6)) for r in O.grid_to_spans(grid, sizes, 1.0, 0.5, 0.25).collect())
    assert got == [(5, 1.25, 1.75), (5, 3.25, 3.75), (9, 3.0, 3.75)]


def test_labels_go_by_text(spark):
    """Speakers 100, 20 and 3 by text: 100 first, then 20, then 3."""
    spans = spark.createDataFrame([(8, 3, 0.25, 2.0), (8, 20, 3.0, 3.125), (8, 100, 10.5, 4321.0)], "rec long, cluster int, start double, end double")
    lines = {r["cluster"]: r["line"] for r in O.rttm_lines(spans).collect()}
    assert lines == {
        3: "SPEAKER 8 1 0.250 1.750 <NA> <NA> SPEAKER_02 <NA> <NA>",
        20: "SPEAKER 8 1 3.000 0.125 <NA> <NA> SPEAKER_01 <NA> <NA>",
        100: "SPEAKER 8 1 10.500 4310.500 <NA> <NA> SPEAKER_00 <NA> <NA>",
    }


def test_more_than_a_hundred_speakers(spark):
    spans = spark.createDataFrame([(1, c, float(c), c + 0.5) for c in range(130)], "rec long, cluster int, start double, end double")
    lines = {r["cluster"]: r["line"].split(" ")[7] for r in O.rttm_lines(spans).collect()}
    order = sorted(range(130), key=str)
    assert lines == {c: f"SPEAKER_{k:02d}" for k, c in enumerate(order)} and len(set(lines.values())) == 130


@pytest.mark.parametrize("cluster, activity, code", [(-7, 0.5, "HardClustersNegativeId"), (1024, 0.5, "HardClustersIdAboveMax"), (1, float("nan"), "NonFiniteSegmentations"), (1, float("inf"), "NonFiniteSegmentations"), (1, None, "NonFiniteSegmentations")])
def test_refused_grids(spark, cluster, activity, code):
    seg = spark.createDataFrame([(1, 0, 0, 0, activity)], "rec long, chunk int, at int, slot int, activity double")
    hard = spark.createDataFrame([(1, 0, 0, cluster)], "rec long, chunk int, slot int, cluster int")
    with pytest.raises(Exception, match=code):
        O.clustered(seg, hard).collect()


def test_refused_counts_and_times(spark):
    act = spark.createDataFrame([(1, 0, 1, 0.5)], "rec long, t int, cluster int, activation double")
    with pytest.raises(Exception, match="CountAboveMax"):
        O.top_clusters(act, spark.createDataFrame([(1, 0, 65)], "rec long, t int, cnt int")).collect()
    clusters = spark.createDataFrame([(1, 0, 0, 1, 0.5)], "rec long, chunk int, at int, cluster int, activity double")
    sizes = spark.createDataFrame([(1, 4)], "rec long, frames long")
    for step in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            O.overlap_sum(clusters, 0.0, 0.1, 0.0, 0.1, step)
        with pytest.raises(ValueError):
            O.grid_to_spans(act, sizes, 0.0, 0.1, step)
    for gap in (-0.1, float("nan")):
        with pytest.raises(ValueError):
            O.grid_to_spans(act, sizes, 0.0, 0.1, 0.1, gap)
        with pytest.raises(ValueError):
            O.smoothed_top(act, sizes, gap)


def test_padding_clusters_may_be_chosen(spark):
    act = spark.createDataFrame([(1, 0, 1, 0.5)], "rec long, t int, cluster int, activation double")
    counts = spark.createDataFrame([(1, 0, 3)], "rec long, t int, cnt int")
    assert sorted(r["cluster"] for r in O.top_clusters(act, counts).collect()) == [0, 1, 2]


def smooth_plain(raw, counts, k, eps):
    before, out = set(), []
    for t, n in enumerate(counts):
        a = raw[t]
        order = sorted(range(k), key=lambda c: (-(a[c] + (eps if c in before else 0)), -a[c], c))
        before = set(order[:n])
        out += [(t, c) for c in before]
    return sorted(out)


def test_smoothing(spark):
    rng = random.Random(1)
    raw = [[rng.randint(0, 4) / 4 for _ in range(3)] for _ in range(40)]
    counts = [rng.randint(0, 2) for _ in range(40)]
    act = spark.createDataFrame([(1, t, c, v) for t, row in enumerate(raw) for c, v in enumerate(row)], "rec long, t int, cluster int, activation double")
    cnt = spark.createDataFrame([(1, t, n) for t, n in enumerate(counts)], "rec long, t int, cnt int")
    for eps in (0.25, 0.3):
        got = sorted((r["t"], r["cluster"]) for r in O.smoothed_top(act, cnt, eps).collect())
        assert got == smooth_plain(raw, counts, 3, eps)


def test_gaps(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 6, 8), (1, 12, 13), (1, 1, 3)], "rec long, first long, stop long")
    assert sorted((r["first"], r["stop"]) for r in O.merge_gaps(spans, 1).collect()) == [(0, 8), (12, 13)]
    assert O.long_enough(spans, 3).count() == 1


def test_frames_beyond_an_int(spark):
    """Frame numbers may be ints: their products with the window's samples are longs (speaker_activities)."""
    df = spark.createDataFrame([(k,) for k in (13421, 13422, 41024)], "f int")
    got = [tuple(r) for r in df.select("f", FR.frame_to_sample(F.col("f")), FR.total_frames(F.col("f") * 1000)).collect()]
    assert got == [(f, (f * 160000 + 294) // 589, -(-f * 1000 * 589 // 160000)) for f in (13421, 13422, 41024)]


def test_voice_spans_of_late_windows(spark):
    """A window that begins at an int frame whose sample is past 2^31 / 589 (voice_spans)."""
    f = 20000
    logits = [[0.0, 9.0, 0.0, 0.0, 0.0, 0.0, 0.0]] * 9
    rows = spark.createDataFrame([(1, f, logits)], "rec long, f int, logits array<array<double>>").withColumn("start", FR.frame_to_sample(F.col("f")))
    totals = rows.select("rec", FR.frame_to_sample(F.col("f") + 9).alias("total"))
    got = G.voice_spans(G.frame_scores(G.checked(rows.select("rec", "start", "logits"), 9)), totals).collect()
    at = lambda k: (k * 160000 + 294) // 589
    first = at(f) * 589 // 160000
    assert [tuple(r) for r in got] == [(1, at(first), min(at(first + 9), at(f + 9)))]
