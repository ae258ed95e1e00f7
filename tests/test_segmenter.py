"""The streaming segmenter against the batch queries: any split of the sound, any order of the answers, and what is refused."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import frames as O
from turnlake.operators import segmentation as G
from turnlake.streaming.segmenter import EVENTS, Segment, SegmentOptions, stream_segments

WINDOW, FRAMES = 160_000, 589


def pieces(rng, total, most=70_000):
    cuts, at = [], 0
    while at < total:
        at = min(total, at + int(rng.integers(1, most)))
        cuts.append(at)
    return cuts


def scores_of(starts, seed=5):
    """Logits that stay alike for some frames, so that spans have a length."""
    rng = np.random.default_rng(seed)
    return {s: np.repeat(rng.normal(size=(FRAMES // 31 + 1, 7)) * 4, 31, axis=0)[:FRAMES] for s in starts}


def run_all(options, sound, cuts, order, logits):
    """What a segment does if the answers come in this order, each as soon as its window is open."""
    s, done, waiting, at = Segment(options), [], list(order), 0

    def answer_some():
        for start in list(waiting):
            if start in s.open:
                waiting.remove(start)
                done.extend(s.answer(0, start, logits[start]))

    for k, cut in enumerate(cuts):
        done += list(s.push(sound[at:cut]))
        at = cut
        if k % 3 == 2:
            answer_some()
    done += list(s.finish())
    answer_some()
    done += list(s.finish())
    return s, done


@pytest.mark.parametrize("total", [0, 1, 90_000, WINDOW, WINDOW + 1, 333_333, 520_000])
def test_windows_of_any_split(spark, total):
    rng, step = np.random.default_rng(total), 48_000
    sound = rng.random(total, np.float32)
    want = sorted(r["start"] for r in O.plan_starts(spark.createDataFrame([(1, total)], "rec long, total long"), WINDOW, step).collect())
    for _ in range(4):
        s, done = run_all(SegmentOptions(step=step), sound, pieces(rng, total), [], {})
        got = [x for x in done if x["kind"] == "window"]
        assert [x["start"] for x in got] == want and s.open == set(want)
        for x in got:
            part = sound[x["start"] : x["start"] + WINDOW]
            assert np.array_equal(x["samples"], np.pad(part, (0, WINDOW - len(part))))


def test_only_the_needed_sound_stays():
    s = Segment(SegmentOptions(step=WINDOW))
    for _ in range(50):
        list(s.push(np.zeros(40_000, np.float32)))
        assert len(s.buffer) <= 2 * WINDOW


@pytest.fixture(scope="module")
def batch(spark):
    """total, starts, logits, and the batch queries' spans and activities."""
    total, step = 471_234, 50_000
    starts = sorted(r["start"] for r in O.plan_starts(spark.createDataFrame([(1, total)], "rec long, total long"), WINDOW, step).collect())
    logits = scores_of(starts)
    windows = spark.createDataFrame([(1, int(s), x.tolist()) for s, x in logits.items()], "rec long, start long, logits array<array<double>>")
    totals, scores = spark.createDataFrame([(1, total)], "rec long, total long"), G.frame_scores(G.checked(windows))
    voice = sorted((r["first"], r["stop"]) for r in G.voice_spans(scores, totals, 0.8, 0.6, 4800, 8000).collect())
    active = sorted((r["start"], r["slot"], r["first"], r["stop"]) for r in G.speaker_activities(scores, totals, 0.8, 0.6, 3200).collect())
    return total, step, starts, logits, voice, active


def options(step):
    return SegmentOptions(step=step, onset=0.8, offset=0.6, least_activity=0.2, least_voice=0.5, merge_gap=0.3)


def test_answers_in_any_order_give_the_batch_spans(batch):
    total, step, starts, logits, voice, active = batch
    assert len(voice) > 3 and len(active) > 10
    for seed in range(12):
        rng = np.random.default_rng(seed)
        s, done = run_all(options(step), np.zeros(total, np.float32), pieces(rng, total), rng.permutation(starts).tolist(), logits)
        spans = [(x["first"], x["stop"]) for x in done if x["kind"] == "voice"]
        assert spans == voice, seed
        assert sorted((x["start"], x["slot"], x["first"], x["stop"]) for x in done if x["kind"] == "activity") == active
        assert not s.open and s.base == -(-total * FRAMES // WINDOW)


def test_each_frame_is_finalised_once_with_the_mean_of_its_windows(batch):
    total, step, starts, logits, _, _ = batch
    s, frames = Segment(SegmentOptions(step=step)), {}
    list(s.push(np.zeros(total, np.float32)))
    list(s.finish())
    for start in [*starts[1::2], *starts[::2]]:
        base, sums, counts = s.base, s.sums, s.counts
        s._settle = lambda: iter(())
        list(s.answer(0, start, logits[start]))
        del s._settle
        sums, counts, n = s.sums.copy(), s.counts.copy(), s.boundary - s.base
        list(s._settle())
        for k in range(max(0, n)):
            assert base + k not in frames
            frames[base + k] = sums[k] / counts[k] if k < len(sums) else 0.0
    p = {st: np.exp(x) / np.exp(x).sum(axis=1, keepdims=True) for st, x in logits.items()}
    for f, mean in frames.items():
        held = [1 - p[st][f - st * FRAMES // WINDOW, 0] for st in starts if 0 <= f - st * FRAMES // WINDOW < FRAMES]
        # A last frame can lie behind all windows, as starts are rounded down and the total is rounded up.
        assert abs(mean - (np.mean(held) if held else 0.0)) < 1e-12
    assert sorted(frames) == list(range(-(-total * FRAMES // WINDOW)))


def test_refused_answers(batch):
    _, step, _, logits, _, _ = batch
    s = Segment(SegmentOptions(step=step))
    list(s.push(np.zeros(WINDOW + step, np.float32)))
    code = lambda *a: [x.get("code", x["kind"]) for x in s.answer(*a)][0]
    odd = logits[0].copy()
    odd[7, 2] = math.nan
    assert code(0, 0, logits[0][:-1]) == code(0, 0, logits[0][:, :6]) == code(0, 0, None) == "LogitShape"
    assert code(0, 12_345, logits[0]) == "UnknownWindow"
    assert code(0, 0, odd) == "NonFiniteLogits" and 0 in s.open
    assert code(0, 12_345, odd) == "UnknownWindow"
    assert code(0, 0, logits[0]) == "scores" and s.open == {step}
    assert code(0, 0, logits[0]) == "UnknownWindow"
    list(s.events("clear", None, None, None, None))
    assert not s.open and s.generation == 1 and not len(s.buffer)
    list(s.push(np.zeros(WINDOW, np.float32)))
    assert code(0, 0, logits[0]) == "UnknownWindow"
    assert code(1, 0, logits[0]) == "scores"
    list(s.finish())
    assert [x["code"] for x in s.push(np.zeros(5, np.float32))] == ["SamplesAfterFinish"]


@pytest.mark.parametrize("odd", [{"step": 0}, {"step": WINDOW + 1}, {"onset": 1.1}, {"offset": 0.6}, {"merge_gap": -1.0}, {"least_voice": math.inf}])
def test_options_out_of_range(odd):
    with pytest.raises(ValueError):
        SegmentOptions(**odd)


def test_a_restarted_stream_goes_on(spark, tmp_path, batch):
    """Two streams, four batches, a restart before each; the second one is cleared, and answers of its first generation are refused."""
    total, step, starts, logits, voice, _ = batch
    o, rng, schema = options(step), np.random.default_rng(1), EVENTS
    early, late = [s for s in starts if s + WINDOW <= 300_000], [s for s in starts if s + WINDOW > 300_000]
    row = lambda rec, seq, kind, samples=None, generation=None, start=None, x=None: (rec, seq, kind, samples, generation, start, None if x is None else x.tolist())
    batches = [
        [row(1, 0, "samples", [0.0] * 300_000), row(2, 0, "samples", [0.5] * 170_000)],
        [row(1, k, "scores", None, 0, int(s), logits[s]) for k, s in enumerate(rng.permutation(early), 10)] + [row(2, 10, "clear"), row(2, 11, "scores", None, 0, 0, logits[0])],
        [row(1, 20, "samples", [0.0] * (total - 300_000)), row(1, 21, "finish"), row(2, 20, "samples", [0.25] * 160_000), row(2, 21, "scores", None, 0, 0, logits[0])],
        [row(1, k, "scores", None, 0, int(s), logits[s]) for k, s in enumerate(rng.permutation(late), 30)] + [row(1, 90, "finish"), row(2, 30, "scores", None, 1, 0, logits[0])],
    ]
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_segments(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in")), o)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None, k
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("n", F.size("samples")).drop("samples", "scores").collect()
    assert sorted((r["first"], r["stop"]) for r in got if r["rec"] == 1 and r["kind"] == "voice") == voice
    assert sorted(r["start"] for r in got if r["rec"] == 1 and r["kind"] == "window") == starts
    second = sorted((r["seq"], r["generation"], r["kind"], r["code"]) for r in got if r["rec"] == 2 and r["kind"] in ("error", "scores", "window"))
    assert second == [(0, 0, "window", None), (11, 0, "error", "UnknownWindow"), (20, 1, "window", None), (21, 0, "error", "UnknownWindow"), (30, 1, "scores", None)]
    last = {r["rec"]: (r["pending"], r["seq"]) for r in sorted(got, key=lambda r: r["seq"]) if r["kind"] == "counters"}
    assert last == {1: (0, 90), 2: (0, 30)}
