"""Operators against brute force, round trips and held-out rows, with nulls, empty texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnlake.llm import bpe, decontam, graph, langid, lm, near_copies, quality_classifier, quality_rules, secrets, sharding, simhash, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "x", "¿ñ é　😀 <|endoftext|>", "the the the the the the the the the the the", "a b c d e f g " * 3000]


def docs(spark, texts, **more):
    """doc_id, text, with columns whose names clash with those that operators add."""
    rows = [(k, t, "key", 7, True) for k, t in enumerate(texts)] + [(None, "no id", "key", 7, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, _row long, kept boolean")


@pytest.fixture(scope="module")
def some(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


OPERATORS = {
    "rules": lambda d: quality_rules.quality_rules(d),
    "shards": lambda d: sharding.shard_rows(d, sharding.shard_tree(8), sharding.grown(sharding.shard_tree(8), 8)),
    "near": lambda d: simhash.near_duplicates(d.select("doc_id", "text")),
    "keep_one": lambda d: near_copies.keep_one(d.select("doc_id", "text")),
    "secrets": lambda d: secrets.scan_secrets(d),
    "redact": lambda d: secrets.redact_secrets(d.select("doc_id", "text")),
    "encode": lambda d: bpe.bpe_encode(d),
    "digests": lambda d: bpe.bpe_digests(d),
    "substrings": lambda d: _substrings(d),
    "language": lambda d: langid.identify(d, langid.Filters([], [], np.empty(0), 0)),
    "classify": lambda d: quality_classifier.classify(d, quality_classifier.train(d, None)),
    "lm": lambda d: lm.score(d, *lm.train(d)),
}


def _substrings(d):
    index = substrings.FingerprintIndex(d.sparkSession)
    index.append(d)
    return substrings.remove_repeats(d, index)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    d = docs(spark, ODD + ODD)
    n = OPERATORS[name](d).count()
    assert n == d.count() if name != "keep_one" else 0 < n < d.count()
    assert OPERATORS[name](d.limit(0)).count() == 0


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "A train leaves at 5 pm and travels 120 km before John meets Mary, how far does John travel in 5 hours?"), (2, "one two three"), (3, None), (None, "x"), (1, "A train leaves at 5 pm and travels 120 km before John meets Mary, how far does John travel in 5 hours?")], "item_id long, text string")
    texts = ["so. A train leaves at 7 pm and travels 300 km before Bob meets Alice, how far does Bob travel in 7 hours? ok", "A train leaves at 7 pm and travels 300 km before Bob meets Alice, how far does Carl travel in 9 hours?", "Zero one two three four", *ODD]
    d = docs(spark, texts)
    for most in (1000, 0):
        got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.leaks(d, items, broadcast_windows=most).collect()}
        assert got == {(0, 1): "reparameterised", (2, 2): "exact"}
    assert decontam.without_leaks(d, items).count() == d.count() - 2
    assert decontam.leaks(d.limit(0), items).count() == 0 and decontam.leaks(d, items.limit(0)).count() == 0


def kinds(spark, items, texts):
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["kind"], r["n_changed"]) for r in decontam.leaks(docs(spark, texts), b).collect()}


def test_leaks_of_decimals(spark):
    item = "The tank holds 3.5 litres of water and then the farmer pours in 35 litres more, so how full is the tank of 3.5 litres?"
    other = item.replace("35", "70").replace("3.5", "4.5")
    swapped = item.replace("35", "#").replace("3.5", "35").replace("#", "3.5")
    thousands = item.replace("3.5", "1,200,000").replace("35", "1.2")
    got = kinds(spark, [item], [item, other, swapped, thousands])
    assert got == {(0, 0): ("exact", 0), (1, 0): ("reparameterised", 2), (2, 0): ("reparameterised", 2), (3, 0): ("reparameterised", 2)}


def test_leaks_of_items_that_are_mostly_numbers(spark):
    items = ["What is 17 + 25", "1 2 3 4 5 6 7 8 9 10 11 12 and 13"]
    got = kinds(spark, items, ["so, What is 17 + 25?", "what is 18 + 25", "1 2 3 4 5 6 7 8 9 10 11 12 and 13", "5 2 3 5 5 6 7 8 9 5 11 12 and 14"])
    assert got == {(0, 0): ("exact", 0), (2, 1): ("exact", 0)}


def test_a_verbatim_run_of_a_long_item_leaks(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    run = lambda n: "other text here " + " ".join(words[20 : 20 + n]) + " and more text"
    got = kinds(spark, [" ".join(words)], [run(20), run(13), run(12)])
    assert set(got) == {(0, 0), (1, 0)}


def test_one_contradiction_costs_its_windows_only(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(80)]
    words[5] = words[70] = "44"
    copy = list(words)
    copy[70] = "45"
    assert set(kinds(spark, [" ".join(words)], [" ".join(copy)])) == {(0, 0)}


def test_a_token_does_not_depend_on_the_text_before(spark):
    item = "Which of these animals has the longest neck of all"
    assert set(kinds(spark, [item], [item, "and so " + item, "we ask. " + item, item.lower(), item.upper()])) == {(k, 0) for k in range(5)}


def test_recall_on_reparameterised_copies(spark):
    rng = random.Random(4)
    names = ["Anna", "Boris", "Chen", "Dora", "Emil", "Farid", "Greta", "Hugo"]
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 7)))
    items, copies = [], []
    for _ in range(60):
        body = [word() for _ in range(40)]
        for at in rng.sample(range(40), 6):
            body[at] = rng.choice(["{a}", "{b}", "{n}"])
        values = rng.sample(range(10, 99), 4)
        who = rng.sample(names, 2)
        items.append(" ".join(body).format(a=values[0], b=values[1], n=who[0]))
        copies.append(" ".join(body).format(a=values[2], b=values[3], n=who[1]))
    got = kinds(spark, items, copies)
    assert {k for k in got if k[0] == k[1]} == {(k, k) for k in range(60)} and len(got) == 60


def test_units_names_and_number_words_change_freely(spark):
    item = "A truck with Maria inside drives 60 kilometers along the river and rests, then Maria drives 4 kilometers back, so how far is she from home?"
    copies = [
        item.replace("60 kilometers", "37 miles").replace("4 kilometers", "2 miles"),
        *(item.replace("Maria", n) for n in ("McDonald", "IBM", "Mary Ann", "Jean-Luc Picard", "O'Neil")),
        item.replace("60", "twenty").replace("4", "seven"),
        item.replace("Maria", "Mary Ann").replace("60 kilometers", "thirty furlongs").replace("4 kilometers", "two furlongs"),
        item,
    ]
    got = kinds(spark, [item], copies)
    assert {k: v[0] for k, v in got.items()} == {(k, 0): "reparameterised" if k < 8 else "exact" for k in range(9)}
    # The second unit is another one than the first: their windows contradict each other, and no other holds.
    assert kinds(spark, ["walk 60 miles then 4 miles and then 5 miles"], ["walk 60 miles then 4 feet and then 5 yards"]) == {}


def test_a_part_of_an_item_is_not_called_exact(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    got = kinds(spark, [" ".join(words)], [" ".join(words), " ".join(words[:30]), " ".join([*words[:20], "other", *words[20:]])])
    assert {k[0]: v[0] for k, v in got.items()} == {0: "exact", 1: "partial", 2: "partial"}


def test_recall_on_copies_of_every_change(spark):
    """Numbers as digits and words, units of many kinds, names of many forms, all changed at once: nine of ten are found, and nothing else."""
    rng = random.Random(12)
    names = ["Anna", "McAdam", "IBM", "Mary Ann", "DeVito", "Jo Lee Kim", "NATO", "Farid"]
    numbers = ["12", "3.5", "1,200", "seven", "forty", "nineteen", "88", "dozen"]
    units = ["miles", "kilometers", "parsecs", "loaves", "zlotys", "acres", "bushels", "pixels"]
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 7)))
    items, copies = [], []
    for _ in range(60):
        body = [word() for _ in range(44)]
        for at in rng.sample(range(0, 44, 4), 6):
            body[at] = rng.choice(["{a} {u}", "{b} {v}", "{n}", "{m}"])
        pick = lambda x: rng.sample(x, 4)
        (a, b, c, d), (u, v, w, x), (n, m, k, j) = pick(numbers), pick(units), pick(names)
        items.append(" ".join(body).format(a=a, b=b, u=u, v=v, n=n, m=m))
        copies.append(" ".join(body).format(a=c, b=d, u=w, v=x, n=k, m=j))
    got = kinds(spark, items, copies)
    assert len({k for k in got if k[0] == k[1]}) >= 54 and len({k for k in got if k[0] != k[1]}) == 0


def test_rows_of_one_id_are_judged_each(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame([(5, item, 1), (5, "clean text", 2), (None, item, 3), (None, None, 4), (5, "clean text", 2)], "doc_id long, text string, _row int")
    got = decontam.without_leaks(d, b)
    assert got.columns == d.columns and sorted(r["_row"] for r in got.collect()) == [2, 2, 4]


def test_a_word_of_any_length():
    from tokenizers import Tokenizer

    ref, b, rng = Tokenizer.from_file(bpe.default_path()), bpe.tokenizer(bpe.default_path()), random.Random(1)
    for pool in (range(0x4E00, 0x9FFF), range(ord("a"), ord("k")), [ord("a")]):
        w = "".join(chr(rng.choice(pool)) for _ in range(300_000))
        ids = np.frombuffer(b.encode(w), "<u4").tolist()
        assert ids == ref.encode(w, add_special_tokens=False).ids and b.decode(ids) == w
    for n in range(1, 300):
        w = "".join(rng.choices("aehinost", k=n)).encode()
        assert b.merge_long(w) == ref.encode(w.decode(), add_special_tokens=False).ids


def test_letters_newer_than_the_librarys_tables():
    from tokenizers import Tokenizer

    ref, b, rng = Tokenizer.from_file(bpe.default_path()), bpe.tokenizer(bpe.default_path()), random.Random(1)
    pool = [chr(int(x, 16)) for part in bpe.NEWER for x in part.split("-")] + ["'s", "'re", " ", "a", "1", "é", "!", "日", "\n"]
    for _ in range(3000):
        t = "".join(rng.choices(pool, k=rng.randint(1, 8)))
        assert np.frombuffer(b.encode(t), "<u4").tolist() == ref.encode(t, add_special_tokens=False).ids


def test_rules_keep_the_callers_columns(spark):
    d = spark.createDataFrame([(1, "a b c", 7, "x")], "doc_id long, text string, _at int, _Words string")
    got = quality_rules.quality_rules(d).first().asDict()
    assert got["_at"] == 7 and got["_Words"] == "x" and got["_m"]["n_words"] == 3


def test_growth_moves_rows_to_the_new_shard_only(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    for n in (1, 2, 3, 7, 8):
        tree = sharding.shard_tree(n)
        got = sharding.shard_rows(d, tree, sharding.grown(tree, n)).toPandas()
        assert ((got["grown_shard"] == got["shard"]) | (got["grown_shard"] == n)).all()
        assert set(got["shard"]) == set(range(n)) and got["grown_shard"].eq(n).mean() > 0.5 / (n + 1)
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
        assert (got["size"] == 3).all() and (got["text_crc32"] == zlib.crc32("é".encode())).all()


def test_a_hot_key_is_split(spark):
    d = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    tree = sharding.shard_tree(8)
    got = sharding.shard_rows(d, tree, sharding.grown(tree, 8)).toPandas()
    assert sorted(got["slot"]) == list(range(2000))


def plain_spans(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_strong_spans(spark):
    rng = random.Random(2)
    bits = ["password", "TOKEN", "apikey", "Api_Key", "secret", "=", ":", " = ", '"', "é", "😀", " ", "\n", "AKIA", "A" * 16, "B2" * 9, "abc123", "0123456789abcdef", "deadbeef" * 3, "user=", "bob", "https://h.x/", "'"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3] for r in secrets.scan_secrets(docs(spark, texts)).collect()}
    assert all(got[k] == plain_spans(t) for k, t in enumerate(texts))


def test_weak_spans_need_their_complements(spark):
    far = "x" * 600
    texts = ["login: bobby", "login: bobby at https://h.x/", "login: bobby and password = hunter22", f"login: bobby {far} password = hunter22", "see https://h.x/ with login: bobby and token=abcdef1"]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_secrets(docs(spark, texts)).collect()}
    assert [got[k] for k in range(5)] == [[], [], [3, 0], [0], [5, 3, 0]]
    red = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs(spark, texts).select("doc_id", "text")).collect()}
    assert red[2] == "<secret> and <secret>" and red[0] == texts[0]


def test_parts_in_the_middle_of_a_long_span(spark, duck):
    """A span of many scope cells meets the parts inside it, as in the SQL."""
    fill = lambda n: "-" * n
    blob, key = "Zx9" * 14, "AKIA" + "Q7" * 10
    texts = [f"https://h.x/{fill(900)}{key}{fill(400)}{blob}{fill(1000)}", f"see s3://b/{fill(2500)}.{blob}.{fill(2500)} end", f"https://h.x/{fill(3000)}", f"{blob} {fill(1000)} https://h.x/{fill(4000)}{blob}{fill(900)}"]
    d = docs(spark, texts).select("doc_id", "text")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(d).collect()}
    own = duck.cursor()
    own.execute("create temp table documents as select * from (values " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(texts)) + ") as v(doc_id, text)")
    names = [k[0] for k in secrets.KINDS]
    want = {r[0]: r[5] for r in own.execute(secrets.OP6_SQL).fetchall()}
    assert {k: ",".join(f"{names[a]}:{b}:{c}" for a, b, c in got[k]) for k in want} == want
    assert [k for k, *_ in got[0]] == [5, 1, 4] and [k for k, *_ in got[1]] == [4] and got[2] == []
    red = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(d).collect()}
    assert red[0] == "<secret>" and blob not in red[1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", "aa", "'s", "zq", "é", "ß", "😀", " ", "\n", "12", "!!", "<|endoftext|>", "　", "thndsh", "X"]), max_size=30))
def test_encoding_is_the_librarys(parts):
    from tokenizers import Tokenizer

    t, b = "".join(parts), bpe.tokenizer(bpe.default_path())
    want = Tokenizer.from_file(bpe.default_path()).encode(t, add_special_tokens=False).ids
    ids = np.frombuffer(b.encode(t), "<u4").tolist()
    assert ids == want and b.decode(ids) == t


def test_encoding_of_documents(spark, some):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.default_path())
    d = docs(spark, [*some.values(), "ab " * 700_000])
    coded = bpe.bpe_encode(d)
    rows = bpe.bpe_decode(coded, text="back").collect()
    assert all((r["text"] or "") == r["back"] for r in rows)
    assert all(list(r["token_ids"]) == ref.encode(r["text"] or "", add_special_tokens=False).ids for r in rows)
    sums = {r["doc_id"]: r for r in bpe.bpe_digests(d).collect()}
    one = sums[0]
    assert one["ids_sha256"] == hashlib.sha256(np.array(ref.encode(some[0], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


def components_plain(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            v = todo.pop()
            if v not in out:
                out[v] = start
                todo += near[v]
    return out


def test_components(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(60)] + [(500, 501 + k) for k in range(50)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_plain(edges)


@pytest.mark.parametrize("most", [30_000, 6])
def test_fingerprint_components(spark, most):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flip = lambda v, n: v ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    x = np.unique(np.array([flip(base[k % 3], int(rng.integers(1, 7))) for k in range(240)] + [*rng.integers(0, 1 << 63, 60, dtype=np.uint64), np.uint64(0)]))
    pairs = [(int(a.view(np.int64)), int(b.view(np.int64))) for i, a in enumerate(x) for b in x[i + 1 :][np.bitwise_count(a ^ x[i + 1 :]) <= 4]]
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    got = {r["node"]: r["component"] for r in graph.components(simhash.fingerprint_edges(fps, 4, most)).collect()}
    assert got == components_plain(pairs)


def test_fingerprints(some):
    import xxhash

    for t in [*list(some.values())[:60], None, "", "One", "one two THREE"]:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = WORDS.findall(w)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        assert simhash.fingerprint(t) == sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_removed(texts):
    words = [WORDS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def texts_with_repeats(rng):
    text = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(n))
    shared = [text(n) for n in (34, 35, 36, 60, 120)]
    texts = [f"{text(20)} {rng.choice(shared)} {text(15)}\n{rng.choice(shared)}" for _ in range(60)] + ["z " * 34, "z " * 35, "z " * 36, "z " * 90, *ODD]
    return texts + texts[:5]


def removed(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("flush, most", [(2_000_000, substrings.MAP_MOST), (500, substrings.MAP_MOST), (500, 0)])
def test_repeats(spark, flush, most, monkeypatch):
    """With a map of the repeated anchors, and with a join."""
    texts = texts_with_repeats(random.Random(5))
    monkeypatch.setattr(substrings, "FLUSH", flush)
    d = docs(spark, texts)
    index = substrings.FingerprintIndex(spark)
    for k in range(2):
        index.append(d.filter(F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == k))
    assert len(index.runs) == 1
    got = removed(substrings.remove_repeats(d, index, map_most=most))
    assert [got[k] for k in range(len(texts))] == plain_removed(texts)


def test_a_third_batch_is_judged_by_all_three(spark):
    texts = texts_with_repeats(random.Random(8))
    want = plain_removed(texts)
    index = substrings.FingerprintIndex(spark, keep_texts=True)
    d = docs(spark, texts).filter("doc_id IS NOT NULL").withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    part = F.substring("doc_id", 3, 9).cast("int") % 3
    for k in (0, 1):
        index.add_batch(d.filter(part == k))
    # A new index on the same folder goes on where the first one was.
    index = substrings.FingerprintIndex(spark, index.folder, keep_texts=True)
    got = removed(index.add_batch(d.filter(part == 2)))
    assert got == {f"id{k}": want[k] for k in range(2, len(texts), 3)}
    assert len(index.runs) == 1 and len(index.texts) == 3


def test_a_copy_of_history_goes(spark):
    t = " ".join(f"w{k}" for k in range(80))
    index = substrings.FingerprintIndex(spark, keep_texts=True)
    assert removed(index.add_batch(docs(spark, [t])))[0][1] == 0
    assert removed(index.add_batch(docs(spark, ["new words " + t])))[0][1:2] == (80,)


def test_words_of_equal_hashes_are_told_apart(spark, monkeypatch):
    """Anchors go by hashes of words; the windows that they lead to are compared by their words."""
    import xxhash

    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w: real(w[:1]))
    a, b = (substrings.Grams(" ".join(f"{c}{x}" for c in "abcdefghijklmnopqrstuvwxyzabcdefghijkl")) for x in "xy")
    assert (a.anchors == b.anchors).all()
    assert not set(zip(*map(np.ndarray.tolist, a.windows(np.arange(3))))) & set(zip(*map(np.ndarray.tolist, b.windows(np.arange(3)))))


def test_index_remembers_and_compacts(spark):
    t = " ".join(f"w{k}" for k in range(80))
    a, b = docs(spark, [t]), docs(spark, [t + " tail", " ".join(f"v{k}" for k in range(80))])
    index = substrings.FingerprintIndex(spark, most_runs=2)
    assert index.append(a).count() == 0
    met = index.append(b)
    assert met.count() > 0 and len(index.runs) == 2
    before = Counter()
    for path in index.runs:
        before.update({r["key"]: r["n"] for r in index._read(path).collect()})
    index.compact()
    assert len(index.runs) == 1 and {r["key"]: r["n"] for r in index._read(index.runs[0]).collect()} == before
    # What append gave can be read after the runs that it came from are gone.
    assert met.count() > 0


def test_language_of_held_out_rows(spark):
    got = registry_rows(spark, "op1_langid").merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    out = got[got["held_out"]]
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.itertuples())
    assert got["score"].between(0, 1).all()


def registry_rows(spark, name):
    from turnlake.llm import registry

    return registry.QUERIES[name](spark, SF).toPandas()


def test_language_without_letters(spark):
    train = spark.createDataFrame([("the cat sat on the mat", "en", 0.0), ("der hund und die katze", "de", 0.0), ("xyz", None, 0.0)], "text string, lang string, _u double")
    f = langid.train(train)
    got = [r["lang_pred"] for r in langid.identify(docs(spark, ["the mat", "die katze", "12 !? ½", None, "", "жж"]), f).orderBy("doc_id").collect()]
    assert got[1:6] == ["en", "de", "und", "und", "und"] and got[6] in ("en", "de")


def test_language_scores(some):
    """The bit-sliced counts are those of one set of places for each language."""
    f = langid.Filters(["a", "b"], [np.random.default_rng(0).integers(0, 4, 1 << langid.PLACES_BITS).astype(np.uint8)], np.array([0.1, 0.2]), 0)
    t = some[0]
    n, hit = f.counts(t)
    g = langid.grams(t)
    assert n == len(g)
    for bit in range(2):
        assert hit[bit] == sum(all(f.slices[0][p] >> bit & 1 for p in (langid.places(x[None], 0)[0], langid.places(x[None], 1)[0])) for x in g)


@pytest.mark.parametrize("vocabulary", [lm.VOCABULARY, 300])
def test_language_model(spark, some, vocabulary):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    held = lm.id_remainder(F.col("doc_id"), 5) == 1
    got = {r["doc_id"]: r for r in lm.score(d, *lm.train(d.filter(~held), vocabulary)).collect()}
    tokens = {k: [w.decode() for w in lm.tokens_of(t)] + [" "] for k, t in some.items()}
    c = Counter(w for k, t in tokens.items() if not out(k) for w in t)
    n, v = sum(c.values()), len(c)
    for k, t in tokens.items():
        r = got[k]
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["score"] < 0
    assert sum(got[k]["score"] for k in some if out(k)) > sum(got[k]["base_score"] for k in some if out(k))


def test_language_model_is_a_distribution(spark):
    """Over a token that follows a known text, the probabilities of all coded tokens sum to 1 at most; codes that no token has get the rest."""
    d = docs(spark, ["a b a b a c a b", "b a b a c c"])
    model, _ = lm.train(d)
    first = [b"a", b"b"]
    total = 0.0
    for w in [*model.ids, b"?"]:
        i = model.ids.get(w, len(model.counts))
        ids = np.append(model.encode(first)[:-1], i)
        bits = lm.mixed_scores(model, [ids])[0] - lm.mixed_scores(model, [ids[:-1]])[0]
        total += math.exp(bits + (model.share[i] if i < len(model.counts) else 0.0))
    assert 0.3 < total <= 1.000001


def plain_measures(t):
    t = t or ""
    w = WORDS.findall(t)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    cover = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_measures(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "b", " ", "\n", "é", "#", "😀", "ab c", "\t", "a b a b"], k=rng.randint(0, 60))) for _ in range(200)] + ODD
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        m = rows[k]["_m"]
        want = plain_measures(t)
        assert tuple(m[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert rows[k]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (rows[k]["kept"] and rows[k]["base_failed"])


def test_weak_labels():
    """Labellers of known accuracy: the estimates find them, and the posterior beats each."""
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.3
    votes = np.stack([np.where(rng.random(20000) < a, y, ~y) for a in (0.9, 0.8, 0.7, 0.85)], axis=1)
    patterns = Counter("".join("0" if v else "1" for v in row) for row in votes)
    post, table = quality_classifier.expectation_maximisation(list(patterns), list(patterns.values()))
    assert np.allclose(table[:, 0, 0], (0.9, 0.8, 0.7, 0.85), atol=0.05)
    guess = np.array([post["".join("0" if v else "1" for v in row)] > 0.5 for row in votes])
    assert (guess == y).mean() > 0.91


def test_classifier_on_known_labels(spark):
    got = registry_rows(spark, "op10_quality_classifier").drop(columns="quality")
    known = spark.read.parquet(f"{SF}/labels.parquet").toPandas().rename(columns={"toxic": "known_toxic"})
    both = got.merge(known, on="doc_id")
    assert both[(both["quality"] == 1) & (both["known_toxic"] == 0)]["kept"].mean() > 0.95
    assert both[both["quality"] == 0]["kept"].mean() < 0.2


def test_classifier_on_labels_that_did_not_vote(spark):
    """Half of the labels vote; the other half tells how many junk, toxic and clean documents are found."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    vote = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality_classifier.classify(d, quality_classifier.train(d, labels.filter(vote))).drop("quality", "toxic", "junk")
    both = got.join(labels.filter(~vote), "doc_id").toPandas()
    rate = lambda x: 1 - x["kept"].mean()
    junk, toxic, clean = rate(both[both["quality"] == 0]), rate(both[both["toxic"] == 1]), rate(both[(both["quality"] == 1) & (both["toxic"] == 0)])
    print(f"held out: junk {junk:.3f}, toxic {toxic:.3f}, clean {clean:.3f} rejected")
    assert junk > 0.9 and toxic > 0.8 and clean < 0.05


def test_a_fit_does_not_depend_on_repeats(spark):
    """Ids that rows share, repeated rows and null ids: the scorer is the same each time."""
    rng = random.Random(0)
    rows = [(k % 7 if k % 5 else None, " ".join(rng.choices(["good", "fine", "idiot", "###", "word", "the"], k=30))) for k in range(80)]
    d = spark.createDataFrame(rows + rows[:20], "doc_id long, text string")
    one, two = (quality_classifier.train(x, None) for x in (d, d.repartition(3)))
    assert (one.weights == two.weights).all() and one.weights.any()


def test_one_of_each_group_stays(spark):
    base = " ".join(f"word{k}" for k in range(200))
    d = docs(spark, [base, base, base + " x", "quite another text about other things entirely", base])
    twice = d.unionByName(d.filter("doc_id = 1"))
    got = near_copies.keep_one(twice.select("doc_id", "text")).collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got) == [-1, 0, 3]


@pytest.fixture
def shifting(spark, tmp_path):
    """Reads a table whose rows get other places each time that something is written: its files are dealt to tasks anew."""
    key = "spark.sql.files.maxPartitionBytes"
    before, old = spark.conf.get(key), (near_copies.written, decontam.written)

    def wrapped(df, name):
        out = old[0](df, name)
        spark.conf.set(key, "16384b" if spark.conf.get(key) != "16384b" else before)
        return out

    def read(rows):
        for k, row in enumerate(rows):
            spark.createDataFrame([row], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
        near_copies.written = decontam.written = wrapped
        return spark.read.parquet(str(tmp_path / "docs"))

    yield read
    near_copies.written, decontam.written = old
    spark.conf.set(key, before)


def test_copies_of_a_table_whose_splits_change(spark, shifting):
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(k, base if k % 2 else " ".join(f"v{k}x{i}" for i in range(20 + 30 * k))) for k in range(8)]
    got = sorted(r["doc_id"] for r in near_copies.keep_one(shifting(rows)).collect())
    assert got == [0, 1, 2, 4, 6]


def test_leaks_of_a_table_whose_splits_change(spark, shifting):
    items = spark.createDataFrame([(1, "A train leaves at 5 pm and travels 120 km before John meets Mary, how far does John travel in 5 hours?")], "item_id long, text string")
    text = "so. A train leaves at 7 pm and travels 300 km before Bob meets Alice, how far does Bob travel in 7 hours? ok"
    rows = [(k, text if k % 2 else "other words 1 2 3 " * (5 + 40 * k)) for k in range(8)]
    got = sorted((r["doc_id"], r["kind"], r["n_slots"] > 0) for r in decontam.leaks(shifting(rows), items).collect())
    assert got == [(k, "reparameterised", True) for k in (1, 3, 5, 7)]


def test_no_run_is_shuffled_again(spark):
    """Neither by the merge join of a batch nor by compaction."""
    texts = texts_with_repeats(random.Random(2))
    index = substrings.FingerprintIndex(spark, most_runs=3)
    for k in range(3):
        index.append(docs(spark, texts[k::3]))
    for rows, joins in ((index.met(index.runs[-1]), 2), (index.two(*index.runs[:2]), 1)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == joins and "Exchange" not in plan


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_any_number_of_batches_gives_the_same_rows(spark, tmp_path, batches):
    texts = texts_with_repeats(random.Random(13)) + [None, ""]
    docs(spark, texts).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = removed(substrings.op2_substrings(spark, str(tmp_path), batches))
    assert [got[k] for k in range(len(texts))] == plain_removed(texts)


def test_a_changed_weight_moves_rows_of_its_subtree_only(spark):
    """One shard of region 1 gets three times its weight: rows come into its path at each level, and between others none moves."""
    from dataclasses import replace

    tree = sharding.shard_tree(8)
    region = tree.children[1]
    rack = region.children[0]
    heavy = replace(rack.children[0], own_weight=3.0)
    rack2 = replace(rack, children=(heavy, *rack.children[1:]))
    region2 = replace(region, children=(rack2, *region.children[1:]))
    tree2 = replace(tree, children=(tree.children[0], region2))
    keys = spark.range(6000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(sharding.place(F.col("k"), tree).alias("a"), sharding.place(F.col("k"), tree2).alias("b")).collect()
    moved = {(r["a"], r["b"]) for r in rows if r["a"] != r["b"]}
    inside, its_rack, new = {c.shard for r in region.children for c in r.children}, {c.shard for c in rack.children}, heavy.shard
    assert sum(r["b"] == new for r in rows) > 2 * sum(r["a"] == new for r in rows)
    # Into the region from outside, into the rack from its region, into the shard from its rack; never the other way.
    assert all(b in inside and (a not in inside or b in its_rack) and (a not in its_rack or b == new) for a, b in moved)


def test_hot_keys_are_joined_as_the_others(spark, monkeypatch):
    from turnlake.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 20)
    rows = spark.createDataFrame([(k % 7 if k < 700 else k, k) for k in range(1000)], "key long, v long")
    of = rows.filter("key <> 3 AND key <> 800").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    assert of.filter("n > 20").count() == 6
    for how in ("inner", "left"):
        got = sorted(map(tuple, common.join_hot(rows, of, "key", "n", 1000, how).select("key", "v", "m").na.fill(-1).collect()))
        assert got == sorted(map(tuple, rows.join(of, "key", how).select("key", "v", "m").na.fill(-1).collect()))
        assert len(got) == (1000 if how == "left" else 899)
