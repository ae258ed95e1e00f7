"""Near copies against the Jaccard similarity of all pairs."""

import itertools
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from turnlake.llm import near_copies, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(rng):
    """Texts, and copies of them with words changed until the similarity is 0.8 to 0.95, or under 0.75."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    texts = []
    for n in (60, 120, 250, 600, 1500):
        for low, high in ((0.8, 0.82), (0.85, 0.95), (0.8, 0.95), (0.5, 0.75)):
            base = [word() for _ in range(n)]
            copy = base
            while not low <= similarity(shingles(" ".join(base)), shingles(" ".join(copy))) < high:
                copy = list(base)
                for at in rng.sample(range(n), rng.randint(1, max(2, n // 12))):
                    copy[at] = word()
            texts += [" ".join(base), " ".join(copy)]
    return texts


def survivors(texts):
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if group[a] != group[b] and similarity(sets[a], sets[b]) >= 0.8:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    return sorted(k for k, g in enumerate(group) if g == k)


def test_the_stage_finds_planted_near_copies(spark):
    texts = planted(random.Random(7)) + [None, "", "one", "One", "two words"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, "").collect())
    assert got == survivors(texts)
    assert corpus_pipeline.deduplicate(spark, docs.limit(0), "").count() == 0


def test_shuffles_give_what_broadcasts_give(spark, monkeypatch):
    """With limits of zero, marks, pairs and opened lists are joined by shuffles."""
    monkeypatch.setattr(near_copies, "BROADCAST_PAIRS", 0)
    monkeypatch.setattr(near_copies, "BROADCAST_MARKS", 0)
    texts = planted(random.Random(11))[:24] + [None, "", "one", "One"]
    rows = [(k, t) for k, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == survivors(texts)


def components_plain(pairs):
    group = {}
    for a, b in pairs:
        old, new = max(group.setdefault(a, a), group.setdefault(b, b)), min(group[a], group[b])
        group = {k: new if g == old else g for k, g in group.items()}
    return group


def test_position_sets():
    """Any four of eight positions hold a triple, any three a pair."""
    for shared in (2, 3, 4):
        sets = simhash.position_sets(shared)
        assert all(any(set(s) <= set(p) for s in sets) for p in itertools.combinations(range(8), shared))
    assert len(simhash.position_sets(4)) == 20


@pytest.mark.parametrize("block", [2000, 7])
def test_pairs_of_lists(spark, block):
    """Pairs of different parts that meet in a list and reach the count, whether a list is one block or many."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(120):
        lists = [int(x) for x in {rng.integers(0, 5), 100 + rng.integers(0, 60), 200 if k < 40 else 1000 + k}]
        part = int(k // 8 * 8) if k % 3 == 0 else k
        tally = rng.integers(0, 3, near_copies.TALLY).astype(np.uint8).tobytes()
        rows.append((k, part, k % 3 != 0, int(rng.integers(90, 130)), tally, lists))
    reps = spark.createDataFrame(rows, "mark long, part long, alone boolean, size long, tally binary, lists array<long>")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in near_copies.far_pairs(reps, 80, block).collect()}
    want = set()
    for x, y in itertools.combinations(rows, 2):
        shared = sum(p == q for p, q in zip(x[4], y[4], strict=True))
        if set(x[5]) & set(y[5]) and x[1] != y[1] and shared >= near_copies.LEAST_SHARED and 100 * min(x[3], y[3]) >= 80 * max(x[3], y[3]):
            want.add((x[0], y[0]))
    assert got == want and len(want) > 100


def test_recall_of_lists_and_tally():
    """Pairs of similarity 0.8: they meet in a list and reach the count with a chance of 0.995 at least."""
    rng = np.random.default_rng(3)
    met, n = 0, 600
    for _ in range(n):
        size = int(rng.integers(9, 300)) // 9 * 9
        h = rng.integers(0, 1 << 62, size + size // 9, dtype=np.uint64)
        x, y = (near_copies.positional_bytes(near_copies.signed_sums(v)[None]) for v in (h[:size], h[size // 9 :]))
        at = near_copies.BANDS * near_copies.ROWS
        met += bool((near_copies.list_keys(x) == near_copies.list_keys(y)).any() and (x[:, at:] == y[:, at:]).sum() >= near_copies.LEAST_SHARED)
    assert met >= 0.99 * n


def test_recall_on_documents(spark):
    """Groups of sf0.01 against the similarities of all pairs."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {k: near_copies.shingle_set(t) for k, t in texts.items()}
    where = {}
    for k, s in sets.items():
        for h in s.tolist():
            where.setdefault(h, []).append(k)
    shared = Counter(p for ks in where.values() for p in itertools.combinations(sorted(ks), 2))
    links = [p for p, n in shared.items() if 10 * n >= 8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    group = components_plain(links)
    want = {k for k in texts if group.get(k, k) == k}
    assert {r["doc_id"] for r in near_copies.keep_one(docs).collect()} == want and len(want) < len(texts)


def test_odd_rows(spark):
    rows = [(0, None, "k", 1), (1, "", "k", 1), (2, " \n", "k", 1), (3, "a b", "k", 1), (3, "a b", "k", 1), (None, "A b", "k", 1), (None, "only one", "k", 1), (9, "w " * 30000, "k", 1), (8, "W " * 40000, "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, part int")
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got.collect()) == [(False, 0), (False, 3), (False, 8), (True, None)]
    with pytest.raises(ValueError):
        near_copies.keep_one(docs, least_percent=70)


def test_nearly_similar_texts_move_no_pairs(spark, monkeypatch):
    """Of a group whose pairs are all just too far apart, no pair is left to be joined to its sets; the similar ones stay."""
    from turnlake.llm import near_copies as N

    monkeypatch.setattr(N, "MARKS", 7)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(40):
        words = list(base)
        for k in rng.choice(120, 4, replace=False):
            words[k] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    texts += [" ".join(base), " ".join([*base, "end"]), "", None]
    sets = [set(N.shingle_set(t).tolist()) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)]
    want = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(pairs, "a long, b long")
    rows = spark.createDataFrame(list(enumerate(texts)), "mark long, text string")
    some = {(r["a"], r["b"]) for r in N.possible(df, rows, N.SHINGLE, 80).collect()}
    assert want <= some and len(some) < len(pairs) // 10
    assert {(r["a"], r["b"]) for r in N.verified(df, rows, N.SHINGLE, 80).collect()} == want
    assert N.possible(df.limit(0), rows, N.SHINGLE, 80).count() == 0


def nearly_similar(n, changed, rng):
    """Sets of n copies of one text, each with words of its own at some places."""
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(n):
        words = list(base)
        for k in rng.choice(150, changed, replace=False):
            words[k] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    return texts


def test_bitmaps_rule_out_no_similar_pair():
    """The bits in which bitmaps differ bound the difference of sets of all sizes, so no pair of the similarity is lost."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (4, 5, 17, 63, 65, 128, 130, 500, 620, 3000):
        base = rng.integers(0, 1 << 62, size, dtype=np.uint64)
        sets += [base, *(np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 62, k, dtype=np.uint64)])) for k in {1, size // 12, size // 9, size // 5, size // 2})]
    m = np.zeros(len(sets), near_copies.FULL_MEMBER)
    m["mark"], m["part"], m["size"], m["bits"] = np.arange(len(sets)), np.arange(len(sets)), [len(s) for s in sets], np.array([near_copies.bitmap(s) for s in sets] + [None], object)[:-1]
    got = {(min(a, b), max(a, b)) for x in near_copies.pairs_of(m, 80) for a, b in x[:, :2].tolist()}
    want, sized = set(), 0
    for a, b in itertools.combinations(range(len(sets)), 2):
        shared, both = len(np.intersect1d(sets[a], sets[b])), len(sets[a]) + len(sets[b])
        sized += 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b]))
        if 100 * shared >= 80 * (both - shared):
            want.add((a, b))
    assert want <= got and len(want) > 10 and len(got) < sized


def test_a_group_of_nearly_similar_texts_makes_few_pairs(spark):
    """Pairs grow with the group, not with its square, where all its texts are just too far apart; links among them stay."""
    rng = np.random.default_rng(9)
    texts = nearly_similar(600, 4, rng)
    texts += [f"{t} end{k}" for k, t in enumerate(texts[:60])]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "mark long, id long, text string")
    made = near_copies.prints(rows, near_copies.SHINGLE)
    reps = made.selectExpr("mark", "mark AS part", "true AS alone", "size", "tally", "lists", "bits").cache()
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in near_copies.far_pairs(reps, 80).collect()}
    plain = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in near_copies.far_pairs(reps.drop("bits"), 80).collect()}
    sets = [shingles(t) for t in texts]
    similar = {(a, b) for a, b in plain if similarity(sets[a], sets[b]) >= 0.8}
    reps.unpersist()
    assert similar == got & similar and {(k, 600 + k) for k in range(60)} <= got
    assert len(plain) > 30_000 and len(got) < len(plain) // 4
