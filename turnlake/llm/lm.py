"""Language-model scores by online logistic context mixing.

A token is coded as the 8 bits of its class and its share of the class. Each bit has several predictors: one for the bit's
place in the code, and two that also know the last one or two tokens, kept in hashed tables of counts. Their logits are
summed with weights that a gate picks by how often the longest context was seen; an adaptive map then refines the sum.
Weights and map start anew in each text and learn from it, CHUNK tokens at a time, so a text's score depends on no other
text that is scored with it. Tokens outside the vocabulary go by an escape class, and by counts that are joined to them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, id_remainder, written

#: Most tokens that the coded vocabulary has; the others are joined with their counts.
VOCABULARY = 200_000
TABLE_BITS, CONTEXTS = 20, 2
BLOCK = 1 << 15
CLASSES = 256
ESCAPE = CLASSES - 1
CHUNK, LOCKSTEP = 64, 1500
#: Distinct tokens, and tokens, that a task holds before it sends its sums on.
COUNTER, TOKENS = 500_000, 150_000
END = " "
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Weights that the mixing starts with, by gate: of the order-0, order-1 and order-2 logits.
START = np.array([(0.4, 0.6, 0.0), (0.25, 0.55, 0.35), (0.1, 0.35, 0.65), (0.0, 0.2, 0.85)], np.float32)
GATES = np.array([0, 1, 3, 10])
RATE, REFINE_RATE = 0.5, 0.5
LEVELS = 17
_codes = np.arange(CLASSES)[:, None]
#: The nodes of the code tree that a class passes, and the bits taken there.
NODES = ((1 << np.arange(8)) | (_codes >> (8 - np.arange(8)))).astype(np.uint64)
TAKEN = (_codes >> (7 - np.arange(8)) & 1).astype(np.uint8)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n: the tokens of all texts, with one END for each text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([t.decode() for t in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(tokens_of(text))
                seen[END.encode()] += 1
                if len(seen) > COUNTER:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """What each task needs to score: its size is bounded by VOCABULARY and TABLE_BITS."""

    ids: dict[bytes, int]
    counts: np.ndarray
    code: np.ndarray
    share: np.ndarray
    order0: np.ndarray
    logits: np.ndarray
    gates: np.ndarray
    tokens: int
    types: int
    rare_tokens: int
    rare_types: int

    def encode(self, words: list[bytes]) -> np.ndarray:
        get, n = self.ids.get, len(self.counts)
        return np.array([get(w, n) for w in words] + [get(END.encode(), n)], np.int64)


def _slots(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The context hash of each token for each table; first marks the tokens that begin a text."""
    k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    u = ids.astype(np.uint64) + np.uint64(1)
    last = np.concatenate([np.zeros(1, np.uint64), u[:-1]])
    last[first] = 0
    before = np.concatenate([np.zeros(1, np.uint64), last[:-1]])
    before[first] = 0
    one = (last + np.uint64(7)) * k1
    return [one, (one ^ (one >> np.uint64(29))) + (before + np.uint64(11)) * k2]


def _at(context: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The places of a table that belong to the 8 bits of each token."""
    h = (context[:, None] + NODES[codes] * np.uint64(0xFF51AFD7ED558CCD)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _context_blocks(docs: DataFrame, base: Model) -> DataFrame:
    """block, ones and alls (packed 32-bit counts) of the context tables: summed in each task, then over tasks."""
    import zstandard

    sent = docs.sparkSession.sparkContext.broadcast(base)
    size = 1 << TABLE_BITS

    def count(batches):
        model, ids, firsts, held = sent.value, [], [], 0
        total = np.zeros((CONTEXTS, 2, size), np.int64)

        def add():
            if not ids:
                return
            flat = np.concatenate(ids)
            first = np.zeros(len(flat), bool)
            first[np.cumsum([0, *map(len, ids[:-1])])] = True
            codes = model.code[flat]
            one = TAKEN[codes].ravel() == 1
            for k, context in enumerate(_slots(flat, first)):
                at = _at(context, codes).ravel()
                total[k, 0] += np.bincount(at[one], minlength=size)
                total[k, 1] += np.bincount(at, minlength=size)
            ids.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                ids.append(model.encode(tokens_of(text)))
                held += len(ids[-1])
                if held > TOKENS:
                    add()
                    held = 0
        add()
        pack = zstandard.ZstdCompressor(level=1)
        for k in range(CONTEXTS):
            for b in range(0, size, BLOCK):
                part = total[k, :, b : b + BLOCK]
                if part.any():
                    planes = np.ascontiguousarray(part.astype("<u8").view(np.uint8).reshape(-1, 8).T)
                    yield pa.RecordBatch.from_arrays([pa.array([k * size + b], pa.int64()), pa.array([pack.compress(planes.tobytes())], pa.binary())], names=["block", "counts"])

    def summed(batches):
        unpack, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.ascontiguousarray(np.frombuffer(unpack.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().reshape(2, -1)
                sums[block] = sums[block] + part if block in sums else part
        for block, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part[0].astype("<f4").tobytes()]), pa.array([part[1].astype("<f4").tobytes()])], names=["block", "ones", "alls"])

    bounded_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(count, "block long, counts binary").repartition(CONTEXTS * (1 << TABLE_BITS) // BLOCK, "block").mapInArrow(summed, "block long, ones binary, alls binary")


def train(docs: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Model, DataFrame]:
    """The model, and the counts of all tokens (token, n), of all texts of docs."""
    counts = written(token_counts(docs), "tokens")
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted(((r["level"], r["k"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()), reverse=True)
    tokens, types = sum(x[2] for x in levels), sum(x[1] for x in levels)
    least, held = None, 0
    for at, k, _ in levels:
        if held + k > vocabulary:
            break
        least, held = at, held + k
    top = counts.filter(level >= least).toPandas().sort_values(["n", "token"], ascending=[False, True]) if least is not None else None
    names = [] if top is None else [t.encode() for t in top["token"]]
    n = np.zeros(0) if top is None else top["n"].to_numpy(np.float64)
    rare_tokens, rare_types = tokens - int(n.sum()), types - len(names)
    # Classes of about equal mass, the commonest tokens first; the last class is the escape.
    code = np.minimum(ESCAPE - 1, np.floor((np.cumsum(n) - n) * ESCAPE / max(1.0, n.sum()))).astype(np.int64)
    mass = np.bincount(code, n + 0.5, CLASSES)
    share = np.log((n + 0.5) / mass[code]) if len(n) else n
    ids = {t: k for k, t in enumerate(names)}
    node1, node = np.zeros(CLASSES), np.zeros(CLASSES)
    by_class = np.bincount(code, n, CLASSES)
    by_class[ESCAPE] += rare_tokens
    np.add.at(node, NODES.astype(np.int64), by_class[:, None] * np.ones(8))
    np.add.at(node1, NODES.astype(np.int64), by_class[:, None] * TAKEN)
    order0 = np.log((node1 + 0.5) / (node - node1 + 0.5)).astype(np.float32)
    model = Model(ids, n, np.append(code, ESCAPE), share, order0, np.empty(0), np.empty(0), tokens, types, rare_tokens, rare_types)
    ones = np.zeros(CONTEXTS << TABLE_BITS, np.float32)
    alls = np.zeros_like(ones)
    for r in _context_blocks(docs, model).toLocalIterator():
        ones[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["ones"], "<f4")
        alls[r["block"] : r["block"] + BLOCK] = np.frombuffer(r["alls"], "<f4")
    model.logits = np.log((ones + 0.4) / (alls - ones + 0.4)).reshape(CONTEXTS, -1)
    model.gates = (np.searchsorted(GATES, alls.reshape(CONTEXTS, -1)[-1], side="right") - 1).astype(np.uint8)
    return model, counts


def mixed_scores(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The natural log probability of the class bits of each text (token ids)."""
    out = np.zeros(len(texts))
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), LOCKSTEP):
        some = order[at : at + LOCKSTEP]
        size = lengths[some]
        flat = np.concatenate([texts[k] for k in some])
        begin = np.cumsum(size) - size
        first = np.zeros(len(flat), bool)
        first[begin] = True
        contexts = _slots(flat, first)
        weights = np.repeat(START[None], len(some), axis=0)
        shift = np.zeros((len(some), LEVELS), np.float32)
        total = np.zeros(len(some))
        for step in range(0, int(size[0]), CHUNK):
            active = int(np.searchsorted(-size, -step, side="left"))
            n = np.minimum(size[:active] - step, CHUNK)
            doc = np.repeat(np.arange(active), n)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[:active] + step, n)
            codes = model.code[flat[pos]]
            taken = TAKEN[codes].ravel()
            spots = [_at(c[pos], codes).ravel() for c in contexts]
            inputs = [model.order0[NODES[codes].astype(np.int64)].ravel(), *(model.logits[k][s] for k, s in enumerate(spots))]
            gate = model.gates[spots[-1]].astype(np.int64) + np.repeat(doc, 8) * len(START)
            w = weights.reshape(-1, 3)[gate]
            x = np.clip(w[:, 0] * inputs[0] + w[:, 1] * inputs[1] + w[:, 2] * inputs[2], -16, 16)
            cell = np.rint(np.clip(x, -8, 8)).astype(np.int64) + LEVELS // 2 + np.repeat(doc, 8) * LEVELS
            z = x + shift.ravel()[cell]
            e = np.exp(-z)
            p = 1 / (1 + e)
            total[:active] -= np.bincount(np.repeat(doc, 8), np.log1p(np.where(taken, e, 1 / e)), active)
            error = taken - p
            held = np.bincount(gate, minlength=active * len(START)) + 200.0
            for k in range(3):
                weights.reshape(-1, 3)[: active * len(START), k] += RATE * np.bincount(gate, error * inputs[k], active * len(START)) / held
            shift.ravel()[: active * LEVELS] += REFINE_RATE * np.bincount(cell, error, active * LEVELS) / (np.bincount(cell, minlength=active * LEVELS) + 100.0)
        out[some] = total
    return out


SCORED = "kind int, row long, doc_id long, n_tokens long, n_known long, n_rare long, base double, model double, n_bytes long, token string, n long"
_NAMES = [x.split(" ")[0] for x in SCORED.split(", ")]


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each row of docs.

    A null text is scored as an empty one: its END alone. Repeated rows are scored alike; a text may be of any length; an
    empty table gives an empty result; other columns are ignored. Tokens outside the coded vocabulary are joined with the
    counts of all tokens, each once for a text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    smooth = float(np.log(model.tokens + 0.5 * (model.types + 1)))
    rare_smooth = float(np.log(model.rare_tokens + 0.5 * (model.rare_types + 1)))

    def run(batches):
        m = sent.value
        n_ids = len(m.counts)
        base_of = np.append(np.log(m.counts + 0.5), 0.0)
        share_of = np.append(m.share, 0.0)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 4 * LOCKSTEP):
                ids, rare, rows = [], ([], [], []), batch.column("row").to_pylist()[at : at + 4 * LOCKSTEP]
                n_bytes = []
                for row, t in zip(rows, texts[at : at + 4 * LOCKSTEP], strict=True):
                    words = tokens_of(t)
                    x = m.encode(words)
                    ids.append(x)
                    n_bytes.append(len((t or "").encode()))
                    for w, k in Counter((words[j] if j < len(words) else END.encode()) for j in np.flatnonzero(x == n_ids).tolist()).items():
                        rare[0].append(row)
                        rare[1].append(w.decode())
                        rare[2].append(k)
                known = [int((x < n_ids).sum()) for x in ids]
                made = {
                    "kind": np.zeros(len(ids), np.int32), "row": rows, "doc_id": batch.column("doc_id").slice(at, len(ids)), "n_tokens": [len(x) for x in ids], "n_known": known, "n_rare": [len(x) - k for x, k in zip(ids, known, strict=True)],
                    "base": [float(base_of[x].sum()) for x in ids], "model": mixed_scores(m, ids) + [float(share_of[x].sum()) for x in ids], "n_bytes": n_bytes,
                }
                yield _batch(len(ids), made)
                yield _batch(len(rare[0]), {"kind": np.ones(len(rare[0]), np.int32), "row": rare[0], "token": rare[1], "n": rare[2]})

    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED), "scores")
    rare = rows.filter("kind = 1").select("row", "token", F.col("n").alias("k")).join(counts, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("k") * F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"))
    out = rows.filter("kind = 0").join(rare, "row", "left")
    rare_sum, ten = F.coalesce("rare", F.lit(0.0)), F.lit(float(np.log(10)))
    ln_score = F.col("model") + rare_sum - F.col("n_rare") * F.lit(rare_smooth)
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        ((F.col("base") + rare_sum - F.col("n_tokens") * F.lit(smooth)) / ten).alias("base_score"), (ln_score / ten).alias("score"), (-ln_score / F.lit(float(np.log(2))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _batch(n: int, made: dict) -> pa.RecordBatch:
    kinds = {x.split(" ")[0]: _TYPES[x.split(" ")[1]] for x in SCORED.split(", ")}
    return pa.RecordBatch.from_arrays([(made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], t)) if c in made else pa.nulls(n, t) for c, t in kinds.items()], names=_NAMES)


def op7_lm(spark, sf_dir: str) -> DataFrame:
    """A score for each document, from the documents that are not held out. A null or empty text is its end alone, repeated rows are scored alike and count as often in training, an empty table gives an empty result; ids are long or null."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = id_remainder(F.col("doc_id"), 5) == 1
    model, counts = train(docs.filter(~held_out))
    out = score(docs, model, counts)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
