"""Language identification by language-bitmask n-gram filters.

Each learned language has a Bloom filter of its byte n-grams. The filters are stored bit-sliced: one integer per place, with
one bit for each language, so that the AND of an n-gram's places gives the set of all languages that contain it. Counts of
each language's bit over a text, corrected for the filters' false positives, decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, id_remainder

#: Texts per language that the filters are learned from, about; the only bound on what training reads.
TRAIN_PER_LANG = 3000
#: An n-gram belongs to a language that has it this often, if no other has it so many times more often.
LEAST_SHARE, LEAST_RATIO = 4e-6, 0.12
NGRAM = 4
PLACES_BITS, HASHES = 21, 2
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
CHUNK = 1 << 20


def grams(text: str) -> np.ndarray:
    """The 4-byte grams of a text in lower case, as 32-bit integers."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(b) < NGRAM:
        return np.empty(0, np.uint32)
    return b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16)) | (b[3:] << np.uint32(24))


def places(g: np.ndarray, k: int) -> np.ndarray:
    """The k-th place of each gram: the high bits of a product with an odd constant."""
    odd = np.uint32((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)[k])
    return (g * odd) >> np.uint32(32 - PLACES_BITS)


@dataclass
class Filters:
    langs: list[str]
    #: One array for each 8 languages.
    slices: list[np.ndarray]
    false_rate: np.ndarray
    common: int

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """The n-grams of a text, and for each language the n-grams that its filter holds."""
        g, hit = grams(text), np.zeros(len(self.langs))
        for at in range(0, len(g), CHUNK):
            part = g[at : at + CHUNK]
            where = [places(part, k) for k in range(HASHES)]
            for s, table in enumerate(self.slices):
                mask = table[where[0]]
                for w in where[1:]:
                    mask = mask & table[w]
                seen = np.bincount(mask, minlength=256)
                for bit in range(min(8, len(self.langs) - 8 * s)):
                    hit[8 * s + bit] += seen[MASKS_WITH[bit]].sum()
        return len(g), hit

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not LETTER.search(text) or not self.langs:
            return UNKNOWN, 0.0
        n, hit = self.counts(text)
        true = np.clip((hit - n * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(true.argmax()) if true.any() else self.common
        return self.langs[best], float(min(1.0, true[best] / max(1, n)))


MASKS_WITH = [np.array([m for m in range(256) if m >> bit & 1]) for bit in range(8)]


def train(labelled: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Filters:
    """Learns filters from the columns text, lang and _u (a number in [0, 1), evenly spread).

    Rows without a language are ignored, and null texts teach nothing; empty texts are of no harm, long ones are read whole,
    and repeated rows are learned from together. No rows give filters that answer 'und'. Of each language about per_lang rows are read: those of least _u. The n-grams that
    reach the driver are at most 1 / LEAST_SHARE for each language, as their shares sum to 1.
    """
    labelled = labelled.filter(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], [], np.empty(0), 0)
    cut = F.lit(0.0)
    for x in langs:
        cut = F.when(F.col("lang") == x, F.lit(per_lang / sizes[x])).otherwise(cut)
    sample = labelled.filter((F.col("_u") < cut) & F.col("text").isNotNull()).select("lang", "text")
    bounded_batches(labelled.sparkSession)

    def count(batches):
        found: dict[str, list[np.ndarray]] = {}

        def flush():
            for lang, gs in found.items():
                g, n = np.unique(np.concatenate(gs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            found.clear()

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found.setdefault(lang, []).append(grams(text))
                held += len(text)
                if held > 16 * CHUNK:
                    yield from flush()
                    held = 0
        yield from flush()

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counted.join(F.broadcast(per), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).filter(F.col("share") >= LEAST_SHARE)
    top = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("all"))
    kept = top.select("gram", F.explode("all").alias("x"), "top").filter(F.col("x.share") >= LEAST_RATIO * F.col("top")).select("gram", F.col("x.lang").alias("lang")).toPandas()
    slices = [np.zeros(1 << PLACES_BITS, np.uint8) for _ in range(math.ceil(len(langs) / 8))]
    for k, lang in enumerate(langs):
        g = kept.loc[kept["lang"] == lang, "gram"].to_numpy().astype(np.uint32)
        for h in range(HASHES):
            np.bitwise_or.at(slices[k // 8], places(g, h), np.uint8(1 << k % 8))
    fill = np.array([(slices[k // 8] >> (k % 8) & 1).mean() for k in range(len(langs))])
    return Filters(langs, slices, fill**HASHES, max(range(len(langs)), key=lambda k: sizes[langs[k]]))


PREDICTION = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs plus lang_pred and score, which replace columns of those names; only text is read for the prediction.

    A null text and a text without a letter get 'und' and score 0; a text that hits no filter gets the commonest language
    and score 0; equal counts go to the first language by name. Repeated rows are judged alike; a text may be of any length.
    """
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *PREDICTION]))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    """A language for each document. A null text and one without letters is `und` with score 0, repeated rows are judged alike, texts may be of any length, an empty table gives an empty result."""
    docs = documents(spark, sf_dir)
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    unit = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    filters = train(docs.filter(~held_out).select("text", "lang", unit.alias("_u")))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), filters).drop("text")
