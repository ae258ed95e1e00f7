"""Weights from files, vectors that can't be projected, seeds by the key stream, and the state of a stream of speakers."""

import hashlib

import numpy as np
import pytest
from test_streams import run

from turnlake.operators.clustering import EngineError, Speakers, kmeans
from turnlake.operators.features import Projection, project
from turnlake.operators.seeding import Draws, key_stream, seeds
from turnlake.sources.weights import identity, projection, read_weights, shapes
from turnlake.streaming.segment import speaker_counts, stream_speakers, stream_state

DIM, OUT = 12, 5


@pytest.fixture
def blobs(tmp_path):
    rng, made = np.random.default_rng(6), {}
    for name, shape in shapes(DIM, OUT).items():
        made[name] = rng.normal(size=shape)
        (tmp_path / f"{name}.bin").write_bytes(made[name].astype("<f8").tobytes())
    (tmp_path / "notes.txt").write_text("not a table")
    (tmp_path / "other.bin").write_bytes(b"12345678")
    return tmp_path, made


def test_weights_are_read_back(spark, blobs):
    folder, made = blobs
    table = read_weights(spark, str(folder), DIM, OUT)
    got = {r["name"]: r for r in table.collect()}
    assert set(got) == set(made)
    for name, v in made.items():
        assert np.array_equal(np.array(got[name]["values"]).reshape(got[name]["shape"]), v)
        assert got[name]["sha256"] == hashlib.sha256(v.astype("<f8").tobytes()).hexdigest()
    told = identity(table).first()
    want = "\n".join(f"{n}:{hashlib.sha256(made[n].astype('<f8').tobytes()).hexdigest()}" for n in sorted(made))
    assert (told["tables"], told["bytes"]) == (8, sum(8 * v.size for v in made.values()))
    assert told["sha256"] == hashlib.sha256(want.encode()).hexdigest()
    w = projection(table)
    x = np.random.default_rng(1).normal(size=(4, DIM))
    vecs = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    mine = Projection(*(made[n] for n in ("mean1", "mean2", "lda", "mu", "eigenvectors_desc", "phi_desc"))).apply(x)
    assert np.allclose([r["x"] for r in sorted(project(vecs, w).collect())], mine)


@pytest.mark.parametrize("name, data, code", [("mu", b"\0" * 8 * (OUT - 1), "WrongSize"), ("psi", np.full(OUT, np.nan).tobytes(), "NonFinite")])
def test_odd_blobs(spark, blobs, name, data, code):
    (blobs[0] / f"{name}.bin").write_bytes(data)
    with pytest.raises(Exception, match=code):
        read_weights(spark, str(blobs[0]), DIM, OUT).collect()


def test_missing_blobs(spark, blobs):
    (blobs[0] / "lda.bin").unlink()
    with pytest.raises(EngineError, match="MissingWeights: lda"):
        projection(read_weights(spark, str(blobs[0]), DIM, OUT))


def test_one_bad_vector_stays_apart(spark):
    w = Projection.orthonormal(4, 3)
    rows = [(0, [1.0, 2.0, 3.0, 4.0]), (1, [0.0, 0.0, 0.0, 1e-3]), (2, [1.0, float("nan"), 0.0, 0.0]), (3, None), (4, [1.0, 2.0]), (5, [0.0, 1.0, 0.0, 0.0])]
    vecs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in project(vecs, w, quarantine=True).collect()}
    assert {k: r["fault"] for k, r in got.items()} == {0: None, 1: "DegenerateInput", 2: "NonFinite", 3: "WrongLength", 4: "WrongLength", 5: None}
    assert all((r["x"] is None) == (r["fault"] is not None) for r in got.values())
    assert np.allclose(got[0]["x"], w.apply(np.array([rows[0][1]]))[0])
    with pytest.raises(Exception, match="WrongLength"):
        project(vecs, w).collect()
    with pytest.raises(Exception, match="NonFinite"):
        project(vecs.filter("vec_id = 2"), w).collect()
    assert project(vecs.limit(0), w).count() == 0


#: The first longs of the key stream for three seeds.
STREAM = {
    0: (0xB585F767A79A3B6C, 0x7746A55FBAD8C037, 0xB2FB0D3281E2A6E6, 0x0F6760A48F9B887C, 0xE10D666732024679, 0x8CAE14CB947EB0BD, 0xD438539D6A2E923C, 0xEF781C7DD2D368BA),
    42: (0xAE90BFB5395D5BA1, 0xF3453FC625799188, 0x6D71B708C5B6538C, 0xA09AB2F958166752, 0x49E149D8BCB642B0, 0x2663B45BA45D829E, 0x4EDBBF0150871314, 0xCDCA9B0D2A122884),
    0xDEADBEEF: (0xFF01307F43EC8DF9, 0x946B5CC52DC1B3DB, 0x017FF25EC6284944, 0x408827C5EF521B39, 0xAD405C58500AB5CE, 0x07DEE5D6817B87FF, 0xE3F4DA5D913C5820, 0x73E790C1503561D5),
}


@pytest.mark.parametrize("seed", STREAM)
def test_key_stream(seed):
    d = Draws(seed)
    assert tuple(d.long() for _ in range(8)) == STREAM[seed]
    words = key_stream(seed, 40)
    assert [words[2 * k] | words[2 * k + 1] << 32 for k in range(8)] == list(STREAM[seed])


def plain_seeds(u, k, seed):
    d, chosen = Draws(seed), []
    chosen.append(d.below(len(u)))
    while len(chosen) < min(k, len(u)):
        far = [min(sum((a - b) ** 2 for a, b in zip(x, u[c], strict=True)) for c in chosen) for x in u]
        if sum(far) > 0:
            t, total = d.unit() * sum(far), 0.0
            for j, f in enumerate(far):
                total += f
                if total > t:
                    chosen.append(j)
                    break
        else:
            free = [j for j in range(len(u)) if j not in chosen]
            chosen.append(free[d.below(len(free))])
    return chosen


@pytest.mark.parametrize("seed", [0, 42, 7])
def test_seeds_of_all_recordings(spark, seed):
    """The fixed case (four points, two seeds from 42: the first and the far one), random ones, one point, and equal points."""
    rng = np.random.default_rng(seed)
    recs = {1: [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [10.0, 10.0]], 2: rng.integers(0, 50, (40, 3)).tolist(), 3: [[1.0, 1.0]], 4: [[2.0, 2.0]] * 5}
    rows = [(rec, i, [float(v) for v in x]) for rec, u in recs.items() for i, x in enumerate(u)]
    got = {}
    for r in seeds(spark.createDataFrame(rows, "rec long, i int, u array<double>"), 4, seed).collect():
        got.setdefault(r["rec"], {})[r["cluster"]] = r["i"]
    for rec, u in recs.items():
        assert [got[rec][c] for c in sorted(got[rec])] == plain_seeds(u, 4, seed), rec
    if seed == 42:
        assert [got[1][0], got[1][1]] == [0, 3]
        assert kmeans(np.array(recs[1]), 2, 42).tolist() == [0, 0, 0, 1]


def test_state_of_a_stream_of_speakers(spark, tmp_path):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(3, 6)) * 4
    batches = [[(r, k, (centres[k % 3] + 0.1 * rng.normal(size=6)).tolist(), 1.5, False) for r in (1, 2) for k in range(9)]]
    batches.append([(1, 9, None, None, True), (1, 10, centres[0].tolist(), 2.0, False), (2, 9, centres[1].tolist(), 2.0, None)])
    schema = "rec long, vec_id long, embedding array<double>, duration double, reset boolean"
    known = {1: Speakers(), 2: Speakers()}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        run(stream_speakers(stream), f"speakers_{n}", spark, tmp_path) if n == 0 else _again(stream_speakers(stream), tmp_path)
        for rec, _, v, d, reset in rows:
            if reset:
                known[rec].reset()
            if v is not None:
                known[rec].assign(np.array(v), d)
        state = stream_state(spark, str(tmp_path / "ck"))
        got = {(r["rec"], r["speaker"]): r for r in state.collect()}
        assert set(got) == {(rec, i) for rec, s in known.items() for i in s.ids}
        for (rec, i), r in got.items():
            assert np.allclose(r["centroid"], known[rec].centroid(i)) and r["duration"] == pytest.approx(known[rec].duration(i))
        counts = {r["rec"]: (r["n_speakers"], r["speakers"]) for r in speaker_counts(state).collect()}
        assert counts == {rec: (s.count, s.ids) for rec, s in known.items()}
    assert known[1].count == 1 and known[2].count == 3


def _again(stream, tmp_path):
    """The same query, started anew from its checkpoint."""
    q = stream.writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
