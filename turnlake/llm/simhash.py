"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two that differ in at most 4 bits differ in at most 4 bytes, so at least 4 of their
positional bytes are shared: the guaranteed count. Posting lists of single positional bytes would hold 1/256 of all rows
each, and their pairs would grow with the square of the input, so a list is keyed by three positional bytes, and the lists are
so chosen that any four of the eight positions hold a list's three: 20 lists a fingerprint. Within a list the shared
positional bytes of pairs are tallied, those of four and more are retained (about 2 % of pairs that meet by chance), and
these are verified by the bits that differ. Only distinct fingerprints are indexed, and a list yields the edges that join its
fingerprints (at most one less than they are), not its pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, forget, join_hot, written
from .graph import components

SHINGLE, SEED, BITS, MOST_BITS = 4, 42, 64, 4
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: Row k has the bits of byte k, the highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: A list with more fingerprints is joined by midpoints instead of scans.
SCAN_MOST = 30_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]]).tolist()
    last = (ends - 1).tolist()[shingle - 1 :] or [len(joined)]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(begins, last, strict=False)), np.uint64, len(last))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), CHUNK):
        rows = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(rows) < 600:
            ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64).reshape(8, 8)
        else:
            ones += np.stack([np.bincount(rows[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), axis=1).tobytes(), "big") if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with their columns but text, plus fp: the fingerprint as a signed long."""
    others = [c for c in docs.columns if c not in ("text", "fp")]
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(fp)], names=[*others, "fp"])

    rest = docs.select(*(f"`{c}`" for c in others), "text")
    return rest.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in rest.dtypes if n != "text"), "fp long"]))


def scan_edges(fps: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked among distinct fingerprints: each is compared once with those not yet reached."""
    a, b = [], []
    left = fps
    while len(left) > 1:
        todo, left = [left[:1]], left[1:]
        while todo and len(left):
            for x in todo.pop():
                apart = x ^ left
                shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                # The tally retains few pairs; only those are verified.
                near = shared >= 8 - most_bits
                near[near] = np.bitwise_count(apart[near]) <= most_bits
                if near.any():
                    found, left = left[near], left[~near]
                    a.append(np.full(len(found), x, np.uint64))
                    b.append(found)
                    todo.append(found)
                if not len(left):
                    break
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def flips(most: int) -> np.ndarray:
    """The 64-bit values with at most so many bits set."""
    one = lambda b: np.uint64(1) << np.uint64(b)
    return np.array([np.bitwise_or.reduce([np.uint64(0), *map(one, bits)]) for n in range(most + 1) for bits in itertools.combinations(range(BITS), n)], np.uint64)


def position_sets(shared: int, positions: int = 8) -> list[tuple[int, ...]]:
    """Sets of positions, one smaller than `shared`, such that any `shared` of the positions hold one of them.

    For shared = 4 these are triples: three classes of positions, and all triples inside a class or with two of one class
    and one of the next. Four positions always hold one of those. For other counts all sets are taken.
    """
    if shared != 4:
        return list(itertools.combinations(range(positions), max(1, shared - 1)))
    home = [p * 3 // positions for p in range(positions)]

    def taken(t: tuple[int, ...]) -> bool:
        n = [sum(home[p] == c for p in t) for c in range(3)]
        return 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3))

    return list(filter(taken, itertools.combinations(range(positions), 3)))


def runs_of_keys(batches, read, most: int):
    """From batches sorted by key: (keys, values, hot) of whole runs, where read gives a batch's values.

    The run that a batch ends with is held back; one of over `most` rows is passed on in pieces that are marked hot, so that
    no run is held whole, however long it is.
    """
    keys, values, hot = np.empty(0, np.int64), None, None
    for batch in batches:
        key, value = batch.column("key").to_numpy(), read(batch)
        if not len(key):
            continue
        if values is not None and len(keys):
            key, value = np.concatenate([keys, key]), np.concatenate([values, value])
        if hot is not None and key[0] == hot:
            more = int(np.searchsorted(key, hot, "right"))
            yield key[:more], value[:more], True
            key, value = key[more:], value[more:]
            if not len(key):
                keys, values = key, value
                continue
        hot = None
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield key[:cut], value[:cut], False
        keys, values = key[cut:], value[cut:]
        if len(keys) > most:
            yield keys, values, True
            hot, keys, values = keys[0], keys[:0], values[:0]
    if len(keys):
        yield keys, values, False


def starts_of(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _edge_batch(a, b, hot) -> pa.RecordBatch:
    if len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        lo, hi = np.unique(np.stack([lo, hi], axis=1), axis=0).T
        a, b = lo.copy(), hi.copy()
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a).view(np.int64)), pa.array(np.asarray(b).view(np.int64)), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])


def fingerprint_edges(fps: DataFrame, most_bits: int = MOST_BITS, scan_most: int = SCAN_MOST) -> DataFrame:
    """From distinct fingerprints (fp): edges (a, b) that connect all those linked by steps of most_bits bits at most (an even number, 6 at most).

    Lists come sorted to their tasks. One of up to scan_most fingerprints is scanned in place; a longer one is never held,
    and its fingerprints go to a second exact join: two that differ in 2k bits at most share a value within k bits of both,
    and all that share such a value are linked, so each of these values yields a star, however many share it. No
    fingerprints give no edges.
    """
    sets = position_sets(8 - most_bits)
    masks = [sum(255 << 8 * k for k in ks) for ks in sets]
    key = lambda k, m: F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)))
    lists = fps.select("fp", F.explode(F.array(*(key(k, m) for k, m in enumerate(masks)))).alias("key"))
    read = lambda batch: batch.column("fp").to_numpy().view(np.uint64)

    def scan(batches):
        for keys, values, hot in runs_of_keys(batches, read, scan_most):
            if hot:
                yield _edge_batch(values, values, True)
                continue
            starts = starts_of(keys)
            sizes = np.diff(np.append(starts, len(values)))
            two = starts[sizes == 2]
            apart = values[two] ^ values[two + 1]
            retained = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - most_bits
            near = two[retained][np.bitwise_count(apart[retained]) <= most_bits]
            a, b = [values[near]], [values[near + 1]]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if n > scan_most:
                    yield _edge_batch(values[s : s + n], values[s : s + n], True)
                else:
                    x, y = scan_edges(values[s : s + n], most_bits)
                    a.append(x)
                    b.append(y)
            yield _edge_batch(np.concatenate(a), np.concatenate(b), False)

    def midpoints(batches):
        near = flips(most_bits // 2)
        for batch in batches:
            for fp in batch.column("fp").to_numpy().view(np.uint64):
                yield pa.RecordBatch.from_arrays([pa.array((fp ^ near).view(np.int64)), pa.array(np.full(len(near), fp).view(np.int64))], names=["key", "fp"])

    def stars(batches):
        hub_key, hub = None, np.uint64(0)
        for keys, values, _ in runs_of_keys(batches, read, scan_most):
            starts = starts_of(keys)
            first = values[starts]
            if keys[0] == hub_key:
                first[0] = hub
            hub_key, hub = keys[-1], first[-1]
            first = np.repeat(first, np.diff(np.append(starts, len(values))))
            yield _edge_batch(first[first != values], values[first != values], False)

    by_key = lambda df: df.repartition("key").sortWithinPartitions("key")
    found = written(by_key(lists).mapInArrow(scan, "a long, b long, hot boolean"), "simhash")
    hot = found.filter("hot").select(F.col("a").alias("fp")).distinct()
    more = by_key(hot.mapInArrow(midpoints, "key long, fp long")).mapInArrow(stars, "a long, b long, hot boolean")
    return found.filter("NOT hot").select("a", "b").unionByName(more.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """The columns of docs but text, plus fp and component_id: the least doc_id that can be reached by links, itself included.

    Fingerprints link at most_bits differing bits or fewer. Null texts and texts without words have fingerprint 0 and link
    like any other. Repeated rows and equal texts have one fingerprint, which is indexed once. Null ids are passed over for
    component_id, which is null only if all ids of a component are. An empty table gives an empty result; columns named fp
    or component_id are replaced.
    """
    docs = written(fingerprints(docs.drop("component_id"), shingle), "fingerprints")
    reps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("_rows")), "representatives")
    edges = fingerprint_edges(reps.select("fp"), most_bits)
    parts = components(edges)
    placed = written(reps.join(parts, reps["fp"] == parts["node"], "left").select("fp", "first_id", "_rows", F.coalesce("component", "fp").alias("component")), "placed")
    sums = placed.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_nodes"))
    distinct, total = placed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    of = written(join_hot(placed.drop("first_id"), sums, "component", "_nodes", distinct).select("fp", "_rows", "component_id"), "components")
    forget(reps, placed)
    return join_hot(docs, of, "fp", "_rows", total)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document. Null and blank texts have the fingerprint zero, repeated rows are linked, texts may be of any length, an empty table gives an empty result."""
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
