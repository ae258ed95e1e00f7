import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from turnlake.operators import clustering as C
from turnlake.operators.assignment import assign_slots
from turnlake.operators.features import Projection, clip_bank, full_bank, mel_bank
from turnlake.operators.variational import refine, soft_labels


def test_refused_scores(spark):
    for value, code in ((math.inf, "NonFinite"), (1e16, "CostTooLarge"), (math.nan, "AllNaN"), (None, "AllNaN")):
        rows = [(1, 0, s, 0, value) for s in range(3)]
        with pytest.raises(Exception, match=code):
            assign_slots(spark.createDataFrame(rows, "rec long, chunk int, slot int, cluster int, soft double")).collect()


def test_slots_of_nan(spark):
    # Slot 2 knows nothing: it counts as the least score of the recording everywhere, and the others go first.
    rows = [(4, 7, s, k, float("nan") if s == 2 else float(10 - 3 * s + k * (1 + s))) for s in range(3) for k in range(2)]
    got = assign_slots(spark.createDataFrame(rows, "rec long, chunk int, slot int, cluster int, soft double")).collect()
    assert {r["slot"]: r["cluster"] for r in got} == {0: 0, 1: 1, 2: -2}


def test_two_vectors():
    """At the threshold itself they are one cluster, by any method."""
    same, other = np.array([[0.6, 0.8], [0.6, 0.8]]), np.array([[1.0, 0.0], [0.6, 0.8]])
    for method in ("agglomerative", "spectral"):
        assert C.offline(same, method, 1.0).tolist() == [0, 0]
        assert C.offline(other, method, 0.6).tolist() == [0, 0] and C.offline(other, method, 0.61).tolist() == [0, 1]
        assert C.offline(other, method, 0.99, target=1).tolist() == [0, 0] and C.offline(same, method, target=2).tolist() == [0, 1]
    for threshold in (1.5, -1.01, math.nan):
        with pytest.raises(C.EngineError) as e:
            C.offline(same, threshold=threshold)
        assert e.value.code == "InvalidSimilarityThreshold"


def test_eigenvalues(spark):
    rng = np.random.default_rng(2)
    w = np.triu(rng.random((6, 6)), 1)
    w += w.T
    d = w.sum(axis=1)
    lap = -w / np.sqrt(d[:, None] * d[None])
    rows = [(3, i, j, float(lap[i, j])) for i in range(6) for j in range(6) if i != j]
    got = sorted(r["value"] for r in C.laplacian_eigenvalues(spark.createDataFrame(rows, "rec long, i int, j int, l double")).collect())
    assert np.allclose(got, np.linalg.eigvalsh(np.eye(6) + lap)) and abs(got[0]) < 1e-12


def plain_merges(x, threshold, of, target=None):
    """Distances between clusters from those of their members, anew at each step."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - np.maximum(0, unit @ unit.T)
    parts = [[k] for k in range(len(x))]
    while len(parts) > (target or 1):
        best, a, b = min((of([d[i, j] for i in p for j in q]), a, b) for a, p in enumerate(parts) for b, q in enumerate(parts) if a < b)
        if target is None and best >= 1 - threshold:
            break
        parts[a] += parts.pop(b)
    return [next(k for k, p in enumerate(parts) if i in p) for i in range(len(x))]


@pytest.mark.parametrize("linkage, of", [("single", min), ("complete", max), ("average", lambda v: sum(v) / len(v))])
def test_agglomerate(linkage, of):
    rng = np.random.default_rng(21)
    for n in (4, 9, 17):
        x = rng.normal(size=(n, 3))
        for threshold in (0.2, 0.55, 0.9):
            assert C.agglomerate(x, threshold, linkage).tolist() == plain_merges(x, threshold, of)
        assert C.agglomerate(x, linkage=linkage, target=4).tolist() == plain_merges(x, 0.0, of, 4)


@pytest.mark.parametrize("x, target, code", [(np.empty((0, 2)), None, "EmptyInput"), (np.zeros((2, 2)), None, "ZeroNormInput"), (np.array([[np.nan, 1.0]]), None, "NonFiniteInput"), (np.eye(2), 3, "TargetOutOfRange"), (np.ones((1001, 2)), None, "InputTooLarge")])
def test_refusals(x, target, code):
    for run in (C.offline, C.agglomerate, C.spectral):
        with pytest.raises(C.EngineError) as e:
            run(x, target=target)
        assert e.value.code == code


def plain_cut(x, t):
    """Centroid linkage with means kept as vectors."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = {k: ([k], x[k], 0.0) for k in range(len(x))}
    nxt, kids = len(x), {}
    while len(groups) > 1:
        a, b = min(itertools.combinations(sorted(groups), 2), key=lambda p: np.linalg.norm(groups[p[0]][1] - groups[p[1]][1]))
        (ma, ca, ha), (mb, cb, hb) = groups.pop(a), groups.pop(b)
        h = max(ha, hb, float(np.linalg.norm(ca - cb)))
        groups[nxt] = (ma + mb, (len(ma) * ca + len(mb) * cb) / (len(ma) + len(mb)), h)
        kids[nxt] = (a, b, h, ma + mb)
        nxt += 1
    out, stack = [], [nxt - 1]
    while stack:
        v = stack.pop()
        if v not in kids:
            out.append({v})
        elif kids[v][2] <= t:
            out.append(set(kids[v][3]))
        else:
            stack += kids[v][:2]
    return sorted(map(sorted, out))


@pytest.mark.parametrize("seed", range(6))
def test_tree_cut_with_inversions(seed):
    x = np.random.default_rng(seed).normal(size=(14, 8))
    for t in (0.6, 0.9, 1.05, 1.2):
        labels = C.ahc(x, t)
        assert sorted(sorted(np.flatnonzero(labels == k).tolist()) for k in set(labels)) == plain_cut(x, t)


def test_spectral_finds_blobs():
    rng = np.random.default_rng(3)
    x = np.concatenate([np.eye(6)[k] + 0.05 * rng.normal(size=(8, 6)) for k in range(3)])
    labels = C.spectral(x, target=3)
    assert [len(set(labels[8 * k : 8 * k + 8])) for k in range(3)] == [1, 1, 1] and len(set(labels)) == 3
    assert C.spectral(np.eye(4)).tolist() == [0, 1, 2, 3]
    assert C.spectral(np.array([[1.0, 0], [1, 0]])).tolist() == [0, 0]


def test_far_rows_make_their_own_clusters():
    u = np.array([[0.2, 0.1], [-0.1, 0.3], [0.0, -0.2], [40.0, -35.0], [0.1, 0.0]])
    for seed in range(5):
        labels = C.kmeans(u, 2, seed).tolist()
        assert labels.count(labels[3]) == 1


def test_online_order():
    """A vector joins the nearest speaker, starts one if it is long enough, and moves a centroid only if it is close."""
    at = lambda degrees: np.array([math.cos(math.radians(degrees)), math.sin(math.radians(degrees))])
    s = C.Speakers(speaker_threshold=0.5, embedding_threshold=0.1)
    # 1 - cos: 0.5 at 60 degrees, 0.1 at 25.8.
    assert [s.assign(at(d), 3.0) for d in (0, 61, 100, 40)] == [("new", 1), ("new", 2), ("existing", 2), ("existing", 2)]
    assert s.count == 2 and s.ids == [1, 2] and s.duration(2) == 9.0 and s.centroid(3) is None
    # 40 is 21 degrees from 61: its centroid is 0.9 of the mean of 61 and 40, and 0.1 of 40.
    mean = at(61) + at(40)
    want = 0.9 * mean / np.linalg.norm(mean) + 0.1 * at(40)
    assert np.allclose(s.centroid(2), want / np.linalg.norm(want)) and np.allclose(s.centroid(1), at(0))
    assert s.assign(at(200), 0.9) == ("dropped", None) and s.assign(at(200), 1.0) == ("new", 3)
    s.reset()
    assert s.count == 0 and s.assign(at(77), 1.0) == ("new", 1)
    both = C.Speakers.from_threshold(0.5)
    assert math.isclose(both.near, 0.6) and math.isclose(both.close, 0.4)
    for bad in ({"speaker_threshold": 2.5}, {"embedding_threshold": -0.1}, {"min_duration": math.nan}, {"min_duration": -1}):
        with pytest.raises(C.EngineError):
            C.Speakers(**bad)


def test_refinement_bound_rises():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=6) * 3 + rng.normal(size=(10, 6)) for _ in range(3)])
    phi = np.sort(rng.uniform(0.5, 5, 6))[::-1].copy()
    gamma, pi, bounds, stop = refine(x, phi, soft_labels(np.repeat(np.arange(5), 6)), rounds=20)
    assert np.allclose(gamma.sum(axis=1), 1, atol=1e-12) and np.isclose(pi.sum(), 1)
    assert all(b >= a - 1e-6 for a, b in zip(bounds, bounds[1:], strict=False)) and stop in ("converged", "max_iters")
    with pytest.raises(C.EngineError):
        refine(x, phi, np.ones((30, 2)))


def test_banks():
    t = np.arange(16000) / 16000
    chirp = np.sin(2 * np.pi * (200 + 1500 * t) * t).astype(np.float32)
    bank = full_bank(chirp)
    assert bank.shape == (98, 80) and np.abs(bank.mean(axis=0)).max() < 1e-3
    assert clip_bank(chirp).shape == (200, 80) and clip_bank(np.tile(chirp, 3)).shape == (200, 80)
    assert mel_bank().shape == (80, 257) and (mel_bank()[:, 256] == 0).all()
    with pytest.raises(C.EngineError):
        full_bank(np.zeros(399))


def test_projection():
    w = Projection.orthonormal(64, 32)
    x = w.apply(np.random.default_rng(0).normal(size=(5, 64)))
    assert np.allclose(np.linalg.norm(x, axis=1), np.sqrt(32))
    with pytest.raises(C.EngineError):
        w.apply(np.zeros((1, 64)))
    rng = np.random.default_rng(1)
    tr, psi = rng.normal(size=(6, 6)), rng.uniform(1, 3, 6)
    basis, values = Projection.derive(tr, psi)
    assert np.allclose(basis.T @ np.linalg.inv(tr.T @ tr) @ basis, np.eye(6)) and (np.diff(values) <= 1e-9).all()


def test_tree_cut_of_many_vectors():
    """More vectors than a table of their pairs would allow; three of them are far from all others."""
    rng = np.random.default_rng(5)
    x = np.eye(3)[rng.integers(0, 3, 8200)] + 0.02 * rng.normal(size=(8200, 3))
    x[[5, 700, 8100]] = -np.eye(3)
    labels = C.ahc(x, 0.6)
    want = np.where((x < -0.5).any(axis=1), 3 + np.abs(x).argmax(axis=1), x.argmax(axis=1))
    assert len(set(zip(labels, want, strict=True))) == len(set(labels)) == 6


def test_posteriors_of_many_vectors(spark):
    """A recording beyond the former limit of 8000 vectors."""
    from turnlake.operators.variational import posteriors

    rng = np.random.default_rng(5)
    x = np.eye(3)[np.arange(8200) % 2] + 0.02 * rng.normal(size=(8200, 3))
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(x.tolist())], "rec long, i int, embedding array<double>").withColumn("x", F.col("embedding"))
    best = posteriors(rows, [3.0, 2.0, 1.0], 0.6, rounds=3).groupBy("i").agg(F.max_by("cluster", "gamma").alias("k"), F.count("*").alias("n"))
    got = {(r["i"] % 2, r["k"], r["n"]) for r in best.collect()}
    assert len(got) == 2 and {g[2] for g in got} == {2}


def test_spectral_of_many_vectors(spark, monkeypatch):
    """Beyond 1000 vectors the labels are those of all eigenvectors of the whole Laplacian."""
    rng = np.random.default_rng(8)
    x = np.eye(6)[rng.integers(0, 3, 1100)] + 0.2 * rng.normal(size=(1100, 6))
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(x.tolist())], "rec long, i int, embedding array<double>")
    got = [r["label"] for r in C.cluster(rows, "spectral", target=3).orderBy("i").collect()]
    by_gap = C.spectral_any(x).tolist()
    monkeypatch.setitem(C.MOST_VECTORS, "offline", 2000)
    assert got == C.spectral(x, 3).tolist() and by_gap == C.spectral(x).tolist() and len(set(got)) == 3
