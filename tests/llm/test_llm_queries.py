"""The queries against DuckDB on the smallest tables, and the pipeline against its own stages."""

import itertools
import random
import re
from collections import Counter

import pytest
from conftest import SF

from turnlake.llm import bpe, quality_classifier, registry, secrets


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, same, name):
    same(registry.QUERIES[name](spark, SF), registry.SQL[name], duck)


def shingles(text):
    w = text.translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(texts):
    """The least id of each id's group, by the similarity of all pairs."""
    sets, where = {k: shingles(t) for k, t in texts.items()}, {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    shared = Counter(p for ks in where.values() for p in itertools.combinations(sorted(ks), 2))
    group = {k: k for k in texts}
    for (a, b), n in shared.items():
        if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    return group


def plain_redacted(text):
    """Every span of each kind by its own search, weak ones if what they need is near, then the text between them."""
    spans = []
    for name, pattern, _, role, strong in secrets.KINDS:
        for m in re.finditer(pattern.replace("\\x20", " "), text, re.A):
            ok = len(m[2]) >= secrets.ASSIGN_LEAST if name == "assign" else re.search("[0-9]", m[0]) and re.search("[G-Zg-z+/]", m[0]) if name == "blob" else True
            if ok:
                spans.append((m.start(), m.end(), role, strong))
    kept = []
    for s, e, role, strong in spans:
        near = {r for a, b, r, _ in spans if r != role and a - e <= secrets.SCOPE and s - b <= secrets.SCOPE}
        if strong or ("secret" in near if role == "identifier" else near if role == "secret" else len(near) == 2):
            kept.append((s, e))
    out, at, open_to = [], 0, None
    for s, e in sorted(kept):
        if open_to is None or s > open_to:
            if open_to is not None:
                at = open_to
            out += [text[at:s], "<secret>"]
            open_to = e
        open_to = max(open_to, e)
    return "".join(out) + text[open_to or 0 :]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.run(spark, SF).toPandas().sort_values("doc_id")
    assert got["round_trip"].all() and 0 < len(got) < docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer = quality_classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {k: t for k, t in text.items() if t is not None and 1 - scorer.bad(t).max() >= 0.5}
    group = near_groups(kept)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {k for k in kept if group[k] == k and not any(t in text[k] for t in items)}
    assert set(got["doc_id"]) == left
    b = bpe.tokenizer(bpe.default_path())
    for r in got.itertuples():
        want = plain_redacted(text[r.doc_id])
        assert b.decode(list(r.token_ids)) == want and r.n_chars == len(want)


def test_redaction(spark):
    """The stage against the plain search, on texts made of parts of secrets."""
    import corpus_pipeline as P

    rng = random.Random(11)
    bits = ["password", "token", "api_key", "=", ": ", '"', " ", "\n", "AKIA" + "Q7" * 9, "hunter22xyz", "deadbeef" * 4, "user=", "bobby", "https://h.x/", "?", "host: db.example", "Zx9" * 12, "word " * 30, "-" * 300, "é😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(300)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in P.redact(spark, docs, SF).collect()}
    want = [plain_redacted(t) for t in texts]
    assert [got[k]["text"] for k in range(300)] == want and [got[k]["n_chars"] for k in range(300)] == list(map(len, want))
    assert sum(w != t for w, t in zip(want, texts, strict=True)) > 100


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with clashing names; and no rows at all."""
    import corpus_pipeline as P

    prose = "the quick study of the river and its people is a long one that was told in the town "
    rows = [(k, prose * 2 + f"of part {k} " * 3, "en", "s", 100) for k in range(4)] + [(9, None, None, None, None), (10, "", "en", "s", 0), (None, prose + "by no one", "en", None, 50)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, source string, n_chars long")
    more = docs.selectExpr("*", "1 AS mark", "2 AS _row", "'x' AS token_ids", "true AS kept", "0 AS part")
    for name, d in (("some", more), ("none", more.limit(0))):
        folder = str(tmp_path / name)
        d.write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            x = spark.read.parquet(f"{SF}/{table}.parquet")
            (x if name == "some" else x.limit(0)).write.parquet(f"{folder}/{table}.parquet")
        ids = [r["doc_id"] for r in P.run(spark, folder).collect()]
        assert len(ids) == len(set(ids)) and 9 not in ids and (name == "some" or not ids)
