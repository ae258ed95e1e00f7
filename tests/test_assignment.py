"""Slots and clusters against brute force, with chunks of one to three slots, fewer clusters than slots, ties and odd scores."""

import itertools

import numpy as np
import pytest

from turnlake.operators.assignment import assign_slots, by_paths

SOFT = "rec long, chunk int, slot int, cluster int, soft double"


def best_total(m):
    n = min(m.shape)
    return max(sum(m[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(m.shape[0]), n) for cols in itertools.permutations(range(m.shape[1]), n))


def assigned(spark, tables):
    rows = [(rec, chunk, s, c, float(v)) for (rec, chunk), (slots, m) in tables.items() for s, row in zip(slots, m, strict=True) for c, v in enumerate(row)]
    out = {}
    for r in assign_slots(spark.createDataFrame(rows, SOFT)).collect():
        assert out.setdefault((r["rec"], r["chunk"]), {}).setdefault(r["slot"], r["cluster"]) == r["cluster"] and r["cluster"] is not None
    return out


@pytest.mark.parametrize("values", ["continuous", "tied"])
def test_every_kind_of_chunk(spark, values):
    rng, tables = np.random.default_rng(3), {}
    for rec, clusters in enumerate((1, 2, 3, 6)):
        for chunk, slots in enumerate(c for n in (1, 2, 3) for c in itertools.combinations(range(3), n)):
            for copy in range(4):
                m = rng.random((len(slots), clusters)) if values == "continuous" else rng.integers(0, 3, (len(slots), clusters)).astype(float)
                tables[rec, 10 * chunk + copy] = (slots, m)
    got = assigned(spark, tables)
    assert set(got) == set(tables)
    for key, (slots, m) in tables.items():
        found = got[key]
        assert sorted(found) == [0, 1, 2]
        assert all(found[s] == -2 for s in range(3) if s not in slots)
        taken = [c for c in found.values() if c != -2]
        assert len(taken) == len(set(taken)) == min(m.shape)
        assert sum(m[slots.index(s), c] for s, c in found.items() if c != -2) == pytest.approx(best_total(m))
        if values == "tied" and sum(sum(m[slots.index(s), c] for s, c in zip(p, q, strict=True)) == best_total(m) for p in itertools.combinations(slots, min(m.shape)) for q in itertools.permutations(range(m.shape[1]), min(m.shape))) > 1:
            assert [found[s] for s in slots] == [c if c >= 0 else -2 for c in by_paths(m)]


#: The tables with ties whose assignment the matcher's conventions determine.
FIXED = [
    ([[0.0, 0.0], [0.0, 0.0], [1.0, 1.0]], [-1, 1, 0]),
    ([[0.0, 0.0], [0.0, 0.0]], [0, 1]),
    ([[-0.2] * 7, [0.96, 0.95, 1.03, 1.25, 1.29, 1.47, 1.86], [1.24, 1.09, 1.21, 1.21, 1.18, 1.20, 1.41]], [2, 6, 0]),
    ([[0.0] * 4, [1.0, 0.5, 0.3, 0.7]], [1, 0]),
]


@pytest.mark.parametrize("table, want", FIXED)
def test_fixed_ties(spark, table, want):
    m = np.array(table)
    assert by_paths(m) == want
    slots = tuple(range(len(m)))
    found = assigned(spark, {(1, 0): (slots, m)})[1, 0]
    # A unique optimum needs no conventions, a tied one follows them.
    assert [found[s] for s in slots] == [c if c >= 0 else -2 for c in want]


@pytest.mark.parametrize("value, code", [(float("inf"), "NonFinite"), (2e15, "CostTooLarge"), (float("nan"), "AllNaN")])
def test_odd_scores(spark, value, code):
    with pytest.raises(Exception, match=code):
        assign_slots(spark.createDataFrame([(1, 0, 0, 0, value)], SOFT)).collect()


def test_empty(spark):
    assert assign_slots(spark.createDataFrame([], SOFT)).count() == 0
