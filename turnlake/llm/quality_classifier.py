"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of all documents'
vote patterns estimates how accurate each labeller is, and the posterior of each pattern is the label that a hashed linear
scorer is trained on. There are two targets, junk and toxic; a document is rejected if either is likely. Known labels, where
there are any, vote as one more labeller.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, forget, written
from .quality_rules import measures

#: Insults that a toxicity labeller knows.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "disgusting", "clown", "loser", "pathetic", "worthless")
#: English words; the labellers of insults know English only, and say nothing of texts with few of these.
ENGLISH = ("the", "and", "of", "that", "is")
#: Labelled documents, and others, that the scorer is fitted on, about; EM counts all documents.
TRAIN_LABELLED, TRAIN_DOCS = 8000, 8000
#: The first bytes of a longer word are a feature too, so that words of one stem are known by each other.
STEM = 7
#: Share of the good training documents that a target's threshold leaves alone.
LEFT_ALONE = 0.997
HASH_BITS = 18
#: A hashed feature has a weight if so many training documents have it.
LEAST_DOCS = 5
TARGETS = ("junk", "toxic")
GOOD, BAD, NONE = 1, 0, 2

#: target, labeller, SQL over the measures that votes bad, and SQL that votes good.
LABELLERS = (
    ("junk", "symbols", "10 * n_symbols > n_words", "n_symbols = 0"),
    ("junk", "capitals", "100 * n_capitals > 40 * word_chars", "100 * n_capitals < 15 * word_chars"),
    ("junk", "repeats", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("junk", "stop_words", "n_words >= 30 AND 100 * n_stop_words < 3 * n_words", "n_words >= 30 AND 100 * n_stop_words >= 8 * n_words"),
    ("junk", "lines", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    ("junk", "known", "quality = 0", "quality = 1"),
    ("toxic", "insult", "n_insults > 0", "n_insults = 0 AND 100 * n_english > 3 * n_words"),
    ("toxic", "insults", "n_insults > 2", "n_insults = 0 AND 100 * n_english > 3 * n_words AND n_words > 20"),
    ("toxic", "known", "toxic = 1", "toxic = 0"),
)


def votes(docs: DataFrame, labels: DataFrame | None, *more: str) -> DataFrame:
    """doc_id, the columns `more` and, for each target, the votes of its labellers as a string of digits.

    labels (doc_id, quality, toxic) may be none. Of an id with several labels the lowest quality and the highest toxicity
    vote, and they vote on all rows of that id; a null id has no label. A null text votes as an empty one.
    """
    told = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\b(?:" + "|".join((*INSULTS, *ENGLISH)) + r")\b"), F.lit(0))
    m = measures(docs.select("doc_id", "text", told.alias("_told"))).select("doc_id", *more, "_m.*", F.size(F.filter("_told", lambda w: w.isin(*INSULTS))).alias("n_insults"), F.size("_told").alias("_told"))
    m = m.withColumn("n_english", F.col("_told") - F.col("n_insults"))
    if labels is None:
        m = m.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    else:
        known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        m = m.join(known, "doc_id", "left")

    def digits(target: str):
        return F.concat(*(F.expr(f"CASE WHEN {bad} THEN '{BAD}' WHEN {good} THEN '{GOOD}' ELSE '{NONE}' END") for t, _, bad, good in LABELLERS if t == target))

    return m.select("doc_id", *more, *(digits(t).alias(t) for t in TARGETS))


def expectation_maximisation(patterns: list[str], counts: list[int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """The posterior of bad for each pattern of votes, and each labeller's P(vote | class, it votes) as [labeller, class, vote].

    A labeller that doesn't vote tells nothing: else the classes would be those of texts that labellers know how to judge.
    There are at most 3 to the number of labellers patterns, however many documents.
    """
    v = np.array([[int(c) for c in p] for p in patterns])
    n = np.array(counts, float)
    bad, good = (v == BAD).sum(axis=1), (v == GOOD).sum(axis=1)
    q = (bad + 0.5) / (bad + good + 1.0)
    q = np.where(bad > good, np.maximum(q, 0.7), np.minimum(q, 0.5))
    table = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        by_class = np.stack([n * q, n * (1 - q)])
        prior = np.clip(by_class.sum(axis=1) / n.sum(), 1e-6, 1)
        for k in range(v.shape[1]):
            for x in (BAD, GOOD):
                table[k, :, x] = by_class[:, v[:, k] == x].sum(axis=1) + 1.0
            table[k, :, :2] /= table[k, :, :2].sum(axis=1, keepdims=True)
            table[k, :, NONE] = 1.0
        like = np.log(prior)[:, None] + sum(np.log(table[k][:, v[:, k]]) for k in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(like[1] - like[0], -500, 500)))
        done = np.abs(new - q).max() < 1e-9
        q = new
        if done:
            break
    return dict(zip(patterns, q.tolist(), strict=True)), table


def features(text: str | None) -> np.ndarray:
    """The hashed features of a text: its words in lower case, their stems, and bins of its ratios; each once."""
    import xxhash

    raw = (text or "").encode()
    words, n = raw.split(), max(1, len(raw))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = {w.strip(b".,;:!?\"'()*#$%&|<>") for w in (text or "").lower().encode().split()}
    bins = (
        b"\x00length%d" % len(words).bit_length(),
        b"\x00symbols%d" % min(8, symbols * 40 // max(1, len(words))),
        b"\x00capitals%d" % min(8, capitals * 20 // n),
        b"\x00variety%d" % (len(set(words)) * 10 // max(1, len(words))),
    )
    stems = {w[:STEM] for w in lower if len(w) > STEM}
    h = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((h(w) >> (32 - HASH_BITS) for w in (*lower, *(b"\x01" + w for w in stems), *bins)), np.uint32))


@dataclass
class Scorer:
    """Logistic weights of hashed features for each target, with a bias at the end."""

    weights: np.ndarray
    labellers: dict[str, np.ndarray]

    def bad(self, text: str | None) -> np.ndarray:
        f = features(text)
        x = self.weights[:, f].sum(axis=1) + self.weights[:, -1]
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: list[np.ndarray], target: np.ndarray, epochs: int = 16, rate: float = 0.3, decay: float = 3e-3) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad over small batches.

    Where the bad are few, 0.5 is too high a bar for them: the bias is raised until LEFT_ALONE of the good rows are under it.
    """
    size = 1 << HASH_BITS
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-2)
    if not rows:
        return w
    seen = np.bincount(np.concatenate(rows), minlength=size)
    rows = [np.append(r[seen[r] >= min(LEAST_DOCS, len(rows))], size) for r in rows]
    order, rng = np.arange(len(rows)), np.random.default_rng(0)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            flat = np.concatenate([rows[k] for k in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[k]) for k in batch])
            x = np.bincount(owner, w[flat], len(batch))
            err = 1 / (1 + np.exp(-np.clip(x, -60, 60))) - target[batch]
            hit, where = np.unique(flat, return_inverse=True)
            grad = np.bincount(where, err[owner]) / len(batch) * 8 + decay * w[hit]
            g2[hit] += grad**2
            w[hit] -= rate * grad / np.sqrt(g2[hit])
    good = [w[r].sum() for r, t in zip(rows, target.tolist(), strict=True) if t < 0.1]
    if good:
        w[size] -= min(0.0, float(np.quantile(good, LEFT_ALONE)))
    return w


def _sample(docs: DataFrame, labels: DataFrame | None, total: int, train_labelled: int, train_docs: int) -> DataFrame:
    """Different rows (doc_id, text), written: about train_docs of all, and about train_labelled of those with a label."""
    chosen = F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, train_docs / total) * (1 << 30))
    out = docs.filter(chosen).select("doc_id", "text")
    if labels is None:
        return written(out.distinct(), "sample")
    ids = labels.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    share = min(1.0, train_labelled / max(1, ids.count()))
    ids = ids.filter(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About train_labelled ids, however many labels there are.
    known = written(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").distinct(), "labelled")
    n = known.count()
    if n > 2 * train_labelled:  # An id that many different texts share.
        known = known.filter(F.pmod(F.xxhash64("text", F.lit("labelled")), F.lit(1 << 30)) < int(train_labelled / n * (1 << 30)))
    return written(out.unionByName(known).distinct(), "sample")


def train(docs: DataFrame, labels: DataFrame | None, train_docs: int = TRAIN_DOCS, train_labelled: int = TRAIN_LABELLED) -> Scorer:
    """Counts the votes of all documents, and fits the scorer on about train_docs rows and train_labelled rows with a label.

    Rows are chosen by a hash of id and text, and equal rows count once in the fit, so what reaches the driver is bounded
    however often a row or an id is repeated, and a second run chooses the same. Null ids and null texts take part. Without
    documents all weights are 0.
    """
    cast = written(votes(docs, labels).select(*TARGETS), "votes")
    posterior, tables, total = {}, {}, 0
    for t in TARGETS:
        found = cast.groupBy(t).agg(F.count(F.lit(1)).alias("n")).orderBy(t).collect()
        total = sum(r["n"] for r in found)
        posterior[t], tables[t] = expectation_maximisation([r[t] for r in found], [r["n"] for r in found]) if found else ({}, np.empty(0))
    forget(cast)
    if not total:
        return Scorer(np.zeros((len(TARGETS), (1 << HASH_BITS) + 1)), tables)
    sample = votes(_sample(docs, labels, total, train_labelled, train_docs), labels, "text")
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            f = [features(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(t) for t in TARGETS] + [pa.array(f, pa.binary())], names=[*TARGETS, "f"])

    got = sample.select(*TARGETS, "text").mapInArrow(run, "junk string, toxic string, f binary").toPandas().sort_values(["f", *TARGETS])
    rows = [np.frombuffer(b, "<u4") for b in got["f"]]
    weights = []
    for t in TARGETS:
        # A document on which no labeller voted has no label to learn from.
        told = [k for k, p in enumerate(got[t]) if set(p) != {str(NONE)}]
        weights.append(fit([rows[k] for k in told], np.array([posterior[t][got[t].iloc[k]] for k in told])))
    weights = np.stack(weights)
    return Scorer(weights, tables)


def classify(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs plus junk and toxic (probabilities), quality (1 less the larger) and kept (quality is 0.5 or more).

    A null text is scored as an empty one, and is not kept. Repeated rows are judged alike; a text may be of any length;
    an empty table gives an empty result; columns of these names are replaced.
    """
    names = (*TARGETS, "quality", "kept")
    docs = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = np.array([sent.value.bad(t) for t in texts]).reshape(-1, 2)
            quality = 1 - p.max(axis=1)
            kept = (quality >= 0.5) & np.array([t is not None for t in texts], bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.array(quality), pa.array(kept)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names[:3]), T.StructField("kept", T.BooleanType())]))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """A verdict for each document, trained on a bounded sample. Null texts are rejected, repeated rows judged alike, texts may be of any length, empty tables give an empty result."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("text")
