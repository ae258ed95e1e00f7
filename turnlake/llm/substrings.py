"""Substring dedup with a log-structured fingerprint index.

A window of WINDOW words is known by its anchor: the least hash of the GRAM-word sequences inside it. Equal windows have
equal anchors, so a window whose anchor occurs once in all is unique. The index keeps anchors and their counts in sorted
immutable runs, one for each batch of documents, bucketed by anchor, so that no run is ever shuffled again: a new run is
merge-joined with the older ones bucket by bucket, which gives the anchors that repeat, and runs are compacted in the same
way. Windows whose anchors repeat are then verified: 96 bits of a hash of their words, as they stand, are merged, and those
that start in two places are the repeated ones. Histories of texts can be kept too, so that a batch is deduplicated against
all batches before it.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, drop_folder, forget, join_hot, new_folder, written

WINDOW, GRAM = 35, 12
#: Repeated anchors that are sent to all tasks as a map of MAP_SHARE bits each (64 MB at most); more of them are joined to their texts by a shuffle.
MAP_MOST, MAP_SHARE, MAP_SHIFT = 1 << 23, 32, 24
#: Hashes that a task holds before it sums them up and sends them on.
FLUSH = 350_000
#: Windows of one text that are hashed at a time.
HASHED_AT_ONCE = 50_000
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD and its inverse to the powers 0 to n - 1, modulo 2 to the 64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((ODD, ODD_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    up, down = powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mixed((sums[k:] - sums[:-k]) * down[: len(words) - k + 1])


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of each `width` values in a row."""
    have, out = 1, x
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return out if have == width else best(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])


class Grams:
    """The word, anchor and window hashes of one text."""

    def __init__(self, text: str | None, window: int = WINDOW, gram: int = GRAM):
        import xxhash

        self.window, self.span = window, window - gram + 1
        self.words = (text or "").encode().split()
        self.anchors = np.empty(0, np.uint64)
        if len(self.words) >= window:
            h = xxhash.xxh64_intdigest
            self.hashes = np.fromiter(map(h, self.words), np.uint64, len(self.words))
            self.grams = rolling(self.hashes, gram)
            self.anchors = sliding(self.grams, self.span, np.minimum)

    def chosen(self) -> np.ndarray:
        """The hash at each place that is an anchor, once for each place."""
        pad = np.zeros(self.span - 1, np.uint64)
        return self.grams[self.grams == sliding(np.concatenate([pad, self.anchors, pad]), self.span, np.maximum)]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of a hash of the words, joined by spaces, of the windows that start at these places."""
        import xxhash

        joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        begins = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
        h = xxhash.xxh3_128_digest
        key, check = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32)
        for k in range(0, len(at), HASHED_AT_ONCE):
            some = slice(k, k + HASHED_AT_ONCE)
            found = np.frombuffer(b"".join([h(joined[i:j]) for i, j in zip(begins[at[some]].tolist(), ends[at[some] + self.window - 1].tolist(), strict=True)]), ">u8").reshape(-1, 2)
            key[some], check[some] = found[:, 0], found[:, 1] >> np.uint64(32)
        return key, check


def anchor_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """key, n: anchors of docs and the places where they are one; an anchor may come in several parts."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        held, size = [], 0

        def flush():
            key, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                g = Grams(text, window, gram)
                if len(g.anchors):
                    held.append(g.chosen())
                    size += len(held[-1])
                if size > FLUSH:
                    yield flush()
                    size = 0
        yield flush()

    return docs.select("text").mapInArrow(run, "key long, n long")


class FingerprintIndex:
    """Sorted immutable runs of anchors (key, n) in a shared folder, and the texts of the batches if keep_texts.

    An index opened on the folder of another one has its runs and texts. If a compaction was cut short, both the old runs
    and the new one may be there: then more windows are verified than need be, and the results are the same.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, keep_texts: bool = False, most_runs: int = 1):
        self.spark, self.window, self.gram, self.keep_texts, self.most_runs = spark, window, gram, keep_texts, most_runs
        self.folder = folder or new_folder(spark, "index")
        names = self._names()
        self.runs = [f"{self.folder}/{n}" for n in names if n.startswith("run-")]
        self.texts = [f"{self.folder}/{n}" for n in names if n.startswith("texts-")]
        self._made = max([int(n.split("-")[1]) for n in names], default=0)
        # All runs of an index have the buckets of its first one, which a run's name tells.
        self.buckets = int(self.runs[0].rsplit("-of-", 1)[1]) if self.runs else int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _names(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # Only what was written to its end counts.
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))) if fs.exists(at) else []

    @staticmethod
    def _table_name(path: str) -> str:
        return f"turnlake_run_{hashlib.md5(path.encode()).hexdigest()}"

    def _read(self, path: str) -> DataFrame:
        """A run as a bucketed table; one that another session made is named again for this one."""
        name = self._table_name(path)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (key BIGINT, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write(self, rows: DataFrame) -> str:
        """rows (key, n), partitioned by key into the buckets, as a run."""
        self._made += 1
        path = f"{self.folder}/run-{self._made}-of-{self.buckets}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", path).saveAsTable(self._table_name(path))
        return path

    def _drop(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(path)}")
        drop_folder(self.spark, path)

    def met(self, new: str) -> DataFrame:
        """key, n of a run's anchors, with those of all older runs. Buckets meet buckets, so nothing is shuffled."""
        out = self._read(new)
        for old in self.runs:
            if old != new:
                out = self._joined(out, old, "left")
        return out

    def _joined(self, rows: DataFrame, run: str, how: str) -> DataFrame:
        other = self._read(run).withColumnRenamed("n", "_n")
        return rows.hint("merge").join(other, "key", how).select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))

    def two(self, a: str, b: str) -> DataFrame:
        """key, n of two runs together, nothing shuffled."""
        return self._joined(self._read(a), b, "full_outer")

    def drop(self) -> None:
        """Deletes the runs and texts of the index."""
        for p in self.runs:
            self._drop(p)
        drop_folder(self.spark, self.folder)
        self.runs, self.texts = [], []

    def append(self, docs: DataFrame) -> DataFrame:
        """Adds a batch: its anchors as a run of their own, merge-joined with the older runs, which are compacted if there are too many.

        Returns the anchors of the batch that repeat (key, n): in the batch itself, or as an older run has them. Null, empty
        and short texts have none; repeated rows repeat; an empty batch gives an empty run. With keep_texts the texts are
        kept as well.
        """
        each = anchor_counts(docs, self.window, self.gram).repartition(self.buckets, "key")
        new = self._write(each.groupBy("key").agg(F.sum("n").alias("n")))
        repeats = written(self.met(new).filter("n > 1"), "repeats")
        if self.keep_texts:
            self._made += 1
            path = f"{self.folder}/texts-{self._made}"
            docs.select("text").write.option("compression", "zstd").parquet(path)
            self.texts.append(path)
        self.runs.append(new)
        if len(self.runs) > self.most_runs:
            self.compact()
        return repeats

    def compact(self) -> None:
        """Merges all runs into one, two at a time."""
        while len(self.runs) > 1:
            a, b, *rest = self.runs
            whole = self._write(self.two(a, b))
            self._drop(a)
            self._drop(b)
            self.runs = [whole, *rest]

    def repeated(self) -> DataFrame:
        """The anchors that occur twice or more in all batches (key, n), written."""
        every = self._read(self.runs[0]) if self.runs else self.spark.createDataFrame([], "key long, n long")
        for run in self.runs[1:]:
            every = self._joined(every, run, "full_outer")
        return written(every.filter("n > 1"), "repeated")

    def add_batch(self, docs: DataFrame) -> DataFrame:
        """Appends a batch and gives the rows of remove_repeats for it, judged against itself and all batches before it.

        Needs keep_texts. A batch's rows are those that one pass over all batches up to it would give.
        """
        if not self.keep_texts:
            raise ValueError("the index keeps no texts")
        history = list(self.texts)
        repeats = self.append(docs)
        return remove_repeats(docs, self, repeats, self.spark.read.schema("text string").parquet(*history) if history else None)


def map_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a map of 2 ** bits bits that belong to each key. (Anchors are least hashes, so their high bits are much alike.)"""
    low = np.uint64((1 << bits) - 1)
    return keys & low, (keys >> np.uint64(MAP_SHIFT)) & low


def repeated_map(keys: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, of which each key sets two."""
    low = F.lit((1 << bits) - 1)
    place = F.explode(F.array(F.col("key").bitwiseAND(low), F.shiftrightunsigned("key", MAP_SHIFT).bitwiseAND(low)))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS int)))").alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out.view(np.uint64)


#: Candidate windows of a bucket of hashes, about; a task holds one bucket at a time.
BUCKET = 500_000
#: kind 0: packed candidate windows of a bucket; 1: windows a to b of a row repeat; 2: a text with candidates, compressed; 3: a text without.
CANDIDATES = "kind int, bucket int, windows binary, row long, a int, b int, doc_id string, text binary, n_words long, sha string"
_NAMES = [x.split(" ")[0] for x in CANDIDATES.split(", ")]


def _batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "bucket": pa.int32(), "windows": pa.binary(), "row": pa.int64(), "a": pa.int32(), "b": pa.int32(), "doc_id": pa.string(), "text": pa.binary(), "n_words": pa.int64(), "sha": pa.string()}
    made = {"kind": pa.array(np.full(n, kind, np.int32))} | {k: pa.array(v, types[k]) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([made[k] if k in made else pa.nulls(n, types[k]) for k in _NAMES], names=_NAMES)


def _digest(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _spans(rows: np.ndarray, at: np.ndarray):
    """Runs of neighbouring places of a row, as (row, first, last)."""
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (at[1:] != at[:-1] + 1)])) if len(rows) else np.empty(0, np.int64)
    last = np.append(first[1:], len(rows)) - 1 if len(rows) else first
    return rows[first], at[first], at[last]


def packed(key: np.ndarray, check: np.ndarray, row: np.ndarray, at: np.ndarray) -> bytes:
    """Windows sorted by key, in about 15 bytes each: differences of keys, and rows as places in a short list."""
    import zstandard

    rows, local = np.unique(row, return_inverse=True)
    parts = [np.diff(key, prepend=np.uint64(0)), check, local.astype(np.uint32), at.astype(np.uint32)]
    head = np.array([len(key), len(rows)], np.int64).tobytes() + rows.astype(np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(len(key), -1).T).tobytes() for p in parts))


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    rows = np.frombuffer(raw, np.int64, m, 16)
    at, out = 16 + 8 * m, []
    for t in (np.uint64, np.uint32, np.uint32, np.uint32):
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).ravel())
        at += n * size
    return np.cumsum(out[0], dtype=np.uint64), out[1], rows[out[2]], out[3].astype(np.int64)


def _with_keys(rows: DataFrame, keys: DataFrame, window: int, gram: int) -> DataFrame:
    """rows (row, doc_id, text) with keys: the repeated anchors of each, by a shuffle; rows that have none have null."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            row, key = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for r, text in zip(batch.column("_place").to_pylist(), batch.column("text").to_pylist(), strict=True):
                g = Grams(text, window, gram)
                if len(g.anchors):
                    key.append(np.unique(g.chosen()).view(np.int64))
                    row.append(np.full(len(key[-1]), r))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(row)), pa.array(np.concatenate(key))], names=["_place", "key"])

    placed = written(rows.withColumn("_place", F.monotonically_increasing_id()), "placed")
    total = keys.agg(F.sum("n")).first()[0] or 0
    met = join_hot(placed.select("_place", "text").mapInArrow(run, "_place long, key long"), keys, "key", "n", total)
    return placed.join(met.groupBy("_place").agg(F.collect_list("key").alias("keys")), "_place", "left").drop("_place")


def repeated_windows(docs: DataFrame, keys: DataFrame, window: int, gram: int, map_most: int = MAP_MOST) -> DataFrame:
    """The table CANDIDATES of docs (row, doc_id, text), written: what repeats within a task is settled there and goes on as one window a hash.

    keys (key, n) are the anchors whose windows are verified. Rows below 0 only bear witness: they get no result.
    """
    spark = docs.sparkSession
    n_keys, places = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    mapped = n_keys <= map_most
    bits = max(12, (MAP_SHARE * n_keys).bit_length())
    sent = spark.sparkContext.broadcast(repeated_map(keys, bits)) if mapped else None
    docs = docs.select("row", "doc_id", "text") if mapped else _with_keys(docs.select("row", "doc_id", "text"), keys, window, gram)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places * (window - gram + 1) // BUCKET))
    bounded_batches(spark)

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        keys, checks, rows, places, size = [], [], [], [], 0

        def flush():
            key, check, row, at = (np.concatenate([np.empty(0, t), *x]) for t, x in ((np.uint64, keys), (np.uint32, checks), (np.int64, rows), (np.int64, places)))
            for x in (keys, checks, rows, places):
                x.clear()
            if not len(key):
                return
            order = np.lexsort((check, key))
            key, check, row, at = key[order], check[order], row[order], at[order]
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
            starts = np.flatnonzero(first)
            n = np.diff(np.append(starts, len(key)))
            many = np.repeat(n > 1, n) & (row >= 0)
            r, a, b = _spans(row[many], at[many])
            yield _batch(1, len(r), row=r, a=a, b=b)
            # A hash seen twice here goes on once, without a place, for the tasks that saw it once.
            key, check, row, at = key[starts], check[starts], np.where(n > 1, -1, row[starts]), at[starts]
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(key)).tolist()
            yield _batch(0, len(cut), bucket=bucket[cut], windows=[packed(key[i:j], check[i:j], row[i:j], at[i:j]) for i, j in zip(cut.tolist(), ends, strict=True)])

        for batch in batches:
            some, none = [], []
            told = [None] * batch.num_rows if mapped else batch.column("keys").to_pylist()
            for row, doc_id, text, own in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), told, strict=True):
                g = Grams(text, window, gram)
                at = np.empty(0, np.int64)
                if len(g.anchors) and mapped:
                    one, two = (sent.value[p >> np.uint64(6)] >> (p & np.uint64(63)) for p in map_places(g.anchors, bits))
                    at = np.flatnonzero(one & two & np.uint64(1))
                elif own:
                    at = np.flatnonzero(np.isin(g.anchors, np.array(own, np.int64).view(np.uint64)))
                if not len(at):
                    if row >= 0:
                        none.append((row, doc_id, len(g.words), _digest(g.words)))
                    continue
                if row >= 0:
                    some.append((row, doc_id, pack.compress(text.encode())))
                key, check = g.windows(at)
                keys.append(key)
                checks.append(check)
                rows.append(np.full(len(at), row, np.int64))
                places.append(at)
                size += len(at)
                if size > FLUSH:
                    yield from flush()
                    size = 0
            if none:
                row, doc_id, n, sha = zip(*none, strict=True)
                yield _batch(3, len(none), row=row, doc_id=doc_id, n_words=n, sha=sha)
            if some:
                row, doc_id, text = zip(*some, strict=True)
                yield _batch(2, len(some), row=row, doc_id=doc_id, text=text)
        yield from flush()

    return written(docs.mapInArrow(run, CANDIDATES), "windows")


def settled(candidates: DataFrame) -> DataFrame:
    """row, a, b: the repeated windows of kind 0, found by merging the sorted windows of each bucket."""
    by_bucket = candidates.filter("kind = 0").select("bucket", "windows").repartition("bucket").sortWithinPartitions("bucket")

    def merged(blobs):
        key, check, row, at = map(np.concatenate, zip(*map(unpacked, blobs), strict=True))
        order = np.lexsort((check, key))
        key, check, row, at = key[order], check[order], row[order], at[order]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (check[1:] == check[:-1]), [False]])
        # A row below 0 is a witness, or stands for two or more whose places are settled.
        keep = (same[1:] | same[:-1]) & (row >= 0)
        r, a, b = _spans(row[keep], at[keep])
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["row", "a", "b"])

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield merged(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield merged(blobs)

    return by_bucket.mapInArrow(run, "row long, a int, b int")


def remove_repeats(docs: DataFrame, index: FingerprintIndex, keys: DataFrame | None = None, history: DataFrame | None = None, map_most: int = MAP_MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of each row of docs: without the words covered by a window that also starts elsewhere.

    Elsewhere is in docs, or in the texts of history (text). kept_text is null where nothing was removed. index must hold
    docs and history; keys (its repeated anchors, if not given) are those that are looked at. Ids may be of any type that a
    string can be cast back to, and be null or repeated. Null, empty and short texts have no window; repeated rows cover each
    other; a text may be of any length; an empty table gives an empty result; other columns are ignored.
    """
    window, id_type = index.window, docs.schema["doc_id"].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    if history is not None:
        rows = rows.unionByName(history.select(F.lit(-2).cast("long").alias("row"), F.lit(None).cast("string").alias("doc_id"), "text"))
    every = repeated_windows(rows, index.repeated() if keys is None else keys, window, index.gram, map_most)
    spans = every.filter("kind = 1").select("row", "a", "b").unionByName(settled(every)).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = every.filter("kind = 2").select("row", "doc_id", "text").join(spans, "row", "left")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = unpack.decompress(text).split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():
                    edge[s["a"]] += 1
                    edge[s["b"] + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), int(gone.sum()), _digest(kept), b" ".join(kept).decode() if gone.any() else None))
            n, removed, sha, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = texts.mapInArrow(run, "doc_id string, n_words long, n_removed long, kept_sha256 string, kept_text string")
    whole = every.filter("kind = 3").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return whole.unionByName(done).withColumn("doc_id", F.col("doc_id").cast(id_type))


def op2_substrings(spark, sf_dir: str, batches: int = 2) -> DataFrame:
    """All documents in batches: an anchor that repeats does so in the batch of its second place, so the merge joins together tell all that do.

    Null texts have no words, repeated rows cover each other, an empty table gives an empty result; see remove_repeats.
    """
    docs, found = documents(spark, sf_dir), []
    index = FingerprintIndex(spark)
    for k in range(batches):
        found.append(index.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k)))
    keys = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.max("n").alias("n"))
    out = remove_repeats(docs, index, keys).select("doc_id", "n_words", "n_removed", "kept_sha256")
    # The repeated windows are written by now.
    forget(*found)
    index.drop()
    return out


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT r, unnest(range(1, len(ws) - {WINDOW - 2})) AS i, ws FROM d WHERE len(ws) >= {WINDOW}),
h AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ')) AS win FROM g),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY win) AS c FROM h) WHERE c > 1),
cov AS (SELECT DISTINCT r, i + k AS i FROM twice, (SELECT unnest(range(0, {WINDOW})) AS k)),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS t, count(*) AS n FROM w LEFT JOIN cov ON w.r = cov.r AND w.i = cov.i WHERE cov.r IS NULL GROUP BY w.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r
"""
