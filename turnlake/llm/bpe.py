"""Byte-pair encoding and decoding by speculation.

Greedy longest match proposes the tokens of each new word. A sequence of tokens is the encoding exactly if each adjacent
pair encodes to itself, so all pairs of a batch of words are tested at once against a table of known pairs, and only words
with a failing pair are merged step by step. Pieces already encoded come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, documents, released

#: The split pattern of the byte-level vocabularies (a fixed value of that format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and digits that Unicode got after its version 16, whose tables the public tokenizers go by.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
).split()
_newer = "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in NEWER)
#: The same pattern where a text has such letters: they are neither letters nor digits.
OLD_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{_newer}])").replace(r"?\p{L}+", rf"?(?:(?![{_newer}])\p{{L}})+").replace(r"?\p{N}+", rf"?(?:(?![{_newer}])\p{{N}})+")
#: Words that the cache holds, and their bytes.
CACHE_WORDS, CACHE_BYTES = 300_000, 64 << 20
#: Longer words (in bytes) are merged with a heap.
LONG_WORD = 96
CACHE_PAIRS = 2_000_000
PIECES_AT_ONCE = 200_000
RUN_CHARS = 1_000_000
#: Rows that are encoded before they are sent on.
SLICE = 1000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.id_of = vocab
        self.size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
        self.bytes_of = [b""] * self.size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for s, i in self.added.items():
            self.bytes_of[i] = s.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[vocab[a], vocab[b]] = k
            self.made.append(vocab[a + b])
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.longest: dict[bytes, int] = {}
        for b in vocab:
            self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 1))
        # A token that its own bytes don't encode to never occurs.
        self.never = np.zeros(self.size, bool)
        for b, i in vocab.items():
            self.never[i] = self.merge(b) != [i]
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.pair_keys, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)
        self.split_new, self.split_old, self.newer = regex.compile(PATTERN), regex.compile(OLD_PATTERN), regex.compile(f"[{_newer}]")
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of least rank first, the leftmost of equals."""
        if len(word) > LONG_WORD:
            return self.merge_long(word)
        ids, rank, none = [self.single[b] for b in word], self.rank, len(self.made)
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k] = self.made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank.get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank.get((ids[k], ids[k + 1]), none)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same for a word of any length, in n log n steps: pairs wait in a heap, and tokens are linked to their neighbours."""
        ids, rank, made = [self.single[b] for b in word], self.rank, self.made
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, k) for k, p in enumerate(zip(ids, ids[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            # A token that is gone is -1, which no pair has; a pair that has changed waits under its new rank.
            if j < 0 or rank.get((ids[k], ids[j])) != r:
                continue
            ids[k], ids[j], n = made[r], -1, after[j]
            after[k] = n
            if n >= 0:
                before[n] = k
                if (r := rank.get((ids[k], ids[n]))) is not None:
                    heapq.heappush(heap, (r, k))
            if (p := before[k]) >= 0 and (r := rank.get((ids[p], ids[k]))) is not None:
                heapq.heappush(heap, (r, p))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, id_of, longest = [], 0, len(word), self.id_of, self.longest
        while at < n:
            end = min(n, at + longest.get(word[at : at + 2], 1))
            while (i := id_of.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens encodes to itself; pairs that aren't known yet are merged once."""
        keys, back = np.unique(left.astype(np.int64) * self.size + right, return_inverse=True)
        at = np.searchsorted(self.pair_keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.pair_keys):
            known = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == keys
        ok = np.zeros(len(keys), bool)
        ok[known] = self.pair_ok[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            b = self.bytes_of
            for k in new.tolist():
                x, y = divmod(int(keys[k]), self.size)
                ok[k] = self.merge(b[x] + b[y]) == [x, y]
            if len(self.pair_keys) + len(new) > CACHE_PAIRS:
                self.pair_keys, self.pair_ok = keys[new], ok[new]
            else:
                all_keys = np.concatenate([self.pair_keys, keys[new]])
                order = np.argsort(all_keys, kind="stable")
                self.pair_keys, self.pair_ok = all_keys[order], np.concatenate([self.pair_ok, ok[new]])[order]
        return ok[back]

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces into the cache."""
        words = [p.encode() for p in pieces]
        proposed = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(itertools.chain.from_iterable(proposed), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        bad = np.zeros(len(words), bool)
        bad[owner[self.never[flat]]] = True
        inside = owner[:-1] == owner[1:]
        if inside.any():
            bad[owner[:-1][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])]] = True
        packed, ends = flat.astype("<u4").tobytes(), np.cumsum(lengths) * 4
        for p, w, wrong, end, n in zip(pieces, words, bad.tolist(), ends.tolist(), lengths.tolist(), strict=True):
            self.words[p] = out = np.array(self.merge(w), "<u4").tobytes() if wrong else packed[end - 4 * n : end]
            self.held += len(w) + len(out) + 150

    def known(self, pieces: list[str]) -> None:
        """Sees to it that the cache has all these pieces."""
        new = [p for p in set(pieces) if p not in self.words]
        if new:
            if len(self.words) + len(new) > CACHE_WORDS or self.held > CACHE_BYTES:
                self.words.clear()
                self.held = 0
                new = list(set(pieces))
            self.learn(new)

    def split(self, text: str):
        """The pieces of a text without special tokens, as an iterator of matches."""
        return (self.split_old if self.newer.search(text) else self.split_new).finditer(text)

    def encode_run(self, texts: list[str]) -> list[bytes]:
        """The packed ids of some texts of RUN_CHARS characters at most together."""
        parts = [self.split_added.split(t) if self.split_added else [t] for t in texts]
        pieces = [[(self.split_old if self.newer.search(x) else self.split_new).findall(x) if k % 2 == 0 else x for k, x in enumerate(p)] for p in parts]
        self.known([w for p in pieces for x in p[::2] for w in x])
        words = self.words
        packed = lambda x: np.array([self.added[x]], "<u4").tobytes() if isinstance(x, str) else b"".join([words[w] for w in x])
        return [b"".join(map(packed, p)) for p in pieces]

    def encode_long(self, text: str) -> bytes:
        """The packed ids of a text of any length, a bounded number of pieces at a time."""
        out = []
        for k, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if k % 2:
                out.append(np.array([self.added[part]], "<u4").tobytes())
                continue
            found = (m[0] for m in self.split(part))
            while some := list(itertools.islice(found, PIECES_AT_ONCE)):
                self.known(some)
                out.append(b"".join([self.words[w] for w in some]))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; none for a null text."""
        return next(encode_all(self, [text]))

    def decode(self, ids) -> str:
        b = self.bytes_of
        return b"".join([b[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_all(bpe: ByteBpe, texts: list[str | None]):
    """The packed ids of each text, in order; texts go in runs, so that each pair test has many words."""
    run, n = [], 0
    for t in texts:
        t = t or ""
        if run and n + len(t) > RUN_CHARS:
            yield from bpe.encode_run(run)
            run, n = [], 0
        if len(t) > RUN_CHARS:
            yield bpe.encode_long(t)
        else:
            run.append(t)
            n += len(t)
    yield from bpe.encode_run(run)


def bpe_encode(docs: DataFrame, path: str | None = None, ids: str = "token_ids", round_trip: str | None = None) -> DataFrame:
    """docs plus a column of token ids (array<int>), which replaces a column of that name. Null and empty texts have no ids.

    Repeated rows are encoded alike, a text or a word may be of any length, an empty table gives an empty result, and docs
    may have any other columns. With round_trip, a boolean column of that name tells whether the ids decode to the text, in the same pass.
    """
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    more = [round_trip] if round_trip else []
    docs = docs.drop(ids, *more)

    def run(batches):
        bpe = tokenizer(path)
        for whole in batches:
            for batch in (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE)):
                texts = batch.column("text").to_pylist()
                packed = list(encode_all(bpe, texts))
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                same = [pa.array([bpe.decode(np.frombuffer(p, "<u4").tolist()) == (t or "") for p, t in zip(packed, texts, strict=True)])] if more else []
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, *same], names=[*batch.schema.names, ids, *more])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *(T.StructField(n, T.BooleanType()) for n in more)]))


def bpe_decode(df: DataFrame, path: str | None = None, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """df with its column of token ids turned into text. Null ids give a null text, ids outside the vocabulary an error.

    Empty ids give an empty text; repeated rows are decoded alike; an empty table gives an empty result; a column named as
    text is replaced.
    """
    path = path or default_path()
    bounded_batches(df.sparkSession)
    df = df.drop(text) if text != ids else df

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            out = [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 sums of each text's ids and of the text decoded from them.

    Null and empty texts have no tokens. Repeated rows give repeated rows, an empty table an empty result; columns other
    than doc_id and text are ignored.
    """
    path = path or default_path()
    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            rows = []
            for packed in encode_all(bpe, batch.column("text").to_pylist()):
                text = bpe.decode(np.frombuffer(packed, "<u4").tolist())
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=DIGESTS.names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """All whole texts of documents, encoded and decoded. Null and empty texts have no tokens, a word may be of any length, repeated rows give repeated rows, an empty table an empty result; ids are long or null."""
    return bpe_digests(documents(spark, sf_dir))
