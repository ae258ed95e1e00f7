"""The whole plan on a small recording against a plain version, its options, and tables that don't fit each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.functions import vectors as V
from turnlake.operators.clustering import ahc
from turnlake.operators.features import Projection
from turnlake.operators.variational import refine, soft_labels
from turnlake.plans import diarize as D

FRAMES, STEP = 10, 5


def recording(seed, chunks=14, speakers=3, dim=16):
    """Chunks of one to three slots: activities of each frame, and a vector for each slot near its speaker's."""
    rng = np.random.default_rng(seed)
    centres = np.eye(dim)[:speakers] * 3
    seg, vecs, said = [], [], {}
    for c in range(chunks):
        n = int(rng.integers(1, 4))
        who = rng.permutation(speakers)[:n]
        for s in range(n):
            said[c, s] = int(who[s])
            vecs.append((c, s, (centres[who[s]] + 0.05 * rng.normal(size=dim)).tolist()))
        turn = rng.integers(0, n + 1, FRAMES)
        seg += [(c, t, s, float(round(0.6 + 0.4 * rng.random(), 3)) if turn[t] == s or turn[t] == n else 0.0) for t in range(FRAMES) for s in range(n)]
    return seg, vecs, said


def plain_hard(seg, vecs, weights, threshold, rounds):
    alone = {}
    for c in {x[0] for x in seg}:
        for t in range(FRAMES):
            on = [(s, a) for cc, tt, s, a in seg if (cc, tt) == (c, t) and a > 0]
            if len(on) == 1:
                alone[c, on[0][0]] = alone.get((c, on[0][0]), 0.0) + on[0][1]
    train = [(c, s, v) for c, s, v in vecs if alone.get((c, s), 0.0) >= 0.2 * FRAMES]
    x = np.array([v for _, _, v in train])
    gamma, pi, _, _ = refine(weights.apply(x), weights.phi, soft_labels(ahc(x, threshold)), rounds=rounds)
    centroids = {k: (gamma[:, k : k + 1] * x).sum(axis=0) / gamma[:, k].sum() for k in range(gamma.shape[1]) if pi[k] > 1e-7}
    cosine = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    return {(c, s): max(centroids, key=lambda k: cosine(v, centroids[k])) for c, s, v in vecs}


def test_the_plan_keeps_incomplete_chunks(spark):
    """Every slot of every chunk has its speaker's cluster, and the turns are those of the clusters' summed activities."""
    seg, vecs, said = recording(3)
    weights = Projection.cosines(16, 8)
    s = spark.createDataFrame([(7, c, t, k, a) for c, t, k, a in seg], "rec long, chunk int, at int, slot int, activity double")
    v = spark.createDataFrame([(7, c, k, x) for c, k, x in vecs], "rec long, chunk int, slot int, embedding array<double>")
    o = D.DiarizeOptions(threshold=0.8, rounds=4)
    got = {(r["chunk"], r["slot"]): r["cluster"] for r in D.assign_embeddings(v, s, FRAMES, weights, o).collect()}
    want = plain_hard(seg, vecs, weights, 0.8, 4)
    assert {k: c for k, c in got.items() if c != -2} == want and {k[0] for k in want} == set(range(14))
    # One cluster a speaker.
    assert len({(said[k], c) for k, c in want.items()}) == 3
    n = 13 * STEP + FRAMES
    sizes = spark.createDataFrame([(7, n)], "rec long, frames long")
    active, per, activation = {}, {}, {}
    for c, t, k, a in seg:
        per[c, t] = per.get((c, t), 0) + (a >= 0.5)
        cell = (c, t, want[c, k])
        active[cell] = max(active.get(cell, 0.0), a)
    for (c, t, k), a in active.items():
        at = (c * STEP + t, k)
        activation[at] = activation.get(at, 0.0) + a
    on = {k: set() for k in set(want.values())}
    for t in range(n):
        held = [per[c, t - c * STEP] for c in range(14) if 0 <= t - c * STEP < FRAMES]
        for k in sorted(on, key=lambda k: (-activation.get((t, k), 0.0), k))[: int(np.rint(np.mean(held)))]:
            on[k].add(t)
    spans = {(k, t) for k, ts in on.items() for t in ts if t - 1 not in ts}
    turns = D.diarize(s, v, sizes, FRAMES, STEP * 0.1, 0.1, 0.1, weights, o).collect()
    ends = lambda k, t: next(u for u in range(t, n + 1) if u not in on[k] or u == n)
    plain = sorted((k, round(t * 0.1 + 0.05, 6), round(min(ends(k, t), n - 1) * 0.1 + 0.05, 6)) for k, t in spans)
    assert sorted((r["cluster"], round(r["start"], 6), round(r["end"], 6)) for r in turns) == [x for x in plain if x[2] > x[1]]


@pytest.mark.parametrize("odd", [{"onset": 0.0}, {"onset": math.nan}, {"threshold": -1.0}, {"fa": 0.0}, {"rounds": 0}, {"rounds": 1001}, {"min_duration_off": -0.1}, {"smoothing": math.inf}, {"least_active": 1.5}])
def test_options(odd):
    with pytest.raises(ValueError):
        D.DiarizeOptions(**odd)
    with pytest.raises(ValueError):
        D.DiarizeOptions().with_(**odd)
    assert D.DiarizeOptions().with_(rounds=7) == D.DiarizeOptions(rounds=7)


def tables(spark, **changes):
    base = {"seg": [(1, 0, 0, 0, 1.0), (1, 0, 3, 2, 0.5)], "hard": [(1, 0, 0, 0), (1, 0, 2, 1)], "counts": [(1, t, 1) for t in range(4)], "sizes": [(1, 4), (2, 1)]} | changes
    base["counts"] = [*base["counts"], (2, 0, 0)]
    types = {"seg": "rec long, chunk int, at int, slot int, activity double", "hard": "rec long, chunk int, slot int, cluster int", "counts": "rec long, t int, cnt int", "sizes": "rec long, frames long"}
    return [spark.createDataFrame(base[k], t) for k, t in types.items()]


@pytest.mark.parametrize(
    "changes, code",
    [
        ({"seg": [(1, 0, 0, 3, 1.0)]}, "SlotOutOfRange"), ({"seg": [(1, 0, -1, 0, 1.0)]}, "FrameOutOfRange"), ({"seg": [(1, 0, 4, 0, 1.0)]}, "FrameOutOfRange"), ({"hard": [(1, 0, 3, 0)]}, "TrailingSlotNotUnmatched"),
        ({"counts": [(1, t, 1) for t in range(3)]}, "CountLenMismatch"), ({"counts": [(1, t, 1) for t in (0, 1, 2, 2)]}, "CountLenMismatch"), ({"sizes": [(1, 0), (2, 1)]}, "ZeroNumOutputFrames"), ({"sizes": [(1, 1 << 40), (2, 1)]}, "OutputTooLarge"),
    ],
)
def test_tables_that_do_not_fit(spark, changes, code):
    with pytest.raises(Exception, match=code):
        D.validated(*tables(spark, **changes), 4).collect()


def test_tables_that_fit(spark):
    assert sorted(map(tuple, D.validated(*tables(spark), 4).collect())) == [(1, 4), (2, 1)]
    assert sorted(map(tuple, D.validated(*tables(spark, hard=[(1, 0, 3, -2)]), 4).collect())) == [(1, 4), (2, 1)]


@pytest.mark.parametrize("v, code", [([0.0, 1e-3], "DegenerateInput"), ([float("inf"), 1.0], "NonFinite"), ([float("nan"), 1.0], "NonFinite")])
def test_checked_unit(spark, v, code):
    df = spark.createDataFrame([(v,)], "a array<double>").withColumn("n", V.norm(F.col("a")))
    with pytest.raises(Exception, match=code):
        df.select(V.checked_unit(F.col("a"), F.col("n"), 0.01)).collect()


def test_sums_at_the_limit_go_by_frames(spark):
    """Slots whose activities, added frame by frame, just reach the limit, and in the other order just don't, and the other way round."""
    rng, limit, seg, want = np.random.default_rng(1), 0.2 * 12, [], []
    chunk = 0
    while chunk < 40:
        v = rng.integers(1, 8000, 6) / 10000
        v[5] = round(2.4 - sum(v[:5]), 4)
        forth, back = np.cumsum(v)[-1], np.cumsum(v[::-1])[-1]  # not sum(), which compensates
        if 0 < v[5] < 1 and (forth >= limit) != (back >= limit):
            seg += [(1, chunk, t, 0, float(a)) for t, a in enumerate(v)]
            want += [chunk] if forth >= limit else []
            chunk += 1
    rows = spark.createDataFrame(seg, "rec long, chunk int, at int, slot int, activity double").repartition(8, "at")
    assert sorted(r["chunk"] for r in D.active_pairs(rows, 12).collect()) == want


def test_centroids_without_rows_of_vectors_and_clusters(spark, monkeypatch):
    """The plan's centroids are the weighted means of the posteriors, and no dimension of a vector is a row of its own."""
    from turnlake.operators import similarity as S
    from turnlake.operators.features import Projection, project
    from turnlake.operators.variational import posterior_centroids, posteriors

    rng, w = np.random.default_rng(6), Projection.cosines(64, 32)
    rows = [(rec, i, [float(v) for v in rng.normal(size=64)]) for rec, n in enumerate((1, 2, 30)) for i in range(n)]
    x = project(spark.createDataFrame(rows, "rec long, i int, embedding array<double>"), w)
    labels = posteriors(x, w.phi.tolist(), 1.05).withColumnRenamed("gamma", "weight")
    want = {(r["rec"], r["cluster"]): r["centroid"] for r in S.weighted_centroids(labels.join(x.select("rec", "i", "embedding"), ["rec", "i"])).collect()}
    made = posterior_centroids(x, w.phi.tolist(), 1.05)
    got = {(r["rec"], r["cluster"]): r["centroid"] for r in made.collect()}
    assert got.keys() == want.keys() and len(got) > 3
    assert all(np.abs(np.array(got[k]) - want[k]).max() < 1e-12 for k in want)
    seg = spark.createDataFrame([(1, 0, 0, 0, 1.0)], "rec long, chunk int, at int, slot int, activity double")
    vecs = spark.createDataFrame([(1, 0, s, r[2]) for s, r in enumerate(rows[:3])], "rec long, chunk int, slot int, embedding array<double>")
    plan = D.assign_embeddings(vecs, seg, 1, w)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(embedding" not in plan
