"""One document of each group of near copies: SimHash bytes at many positions, tallied, and verified by Jaccard similarity.

A text is the set of its SHINGLE-word sequences; equal sets are one from the start. At a similarity of 0.8 two 64-bit
fingerprints differ in about 10 bits, so in nearly all of 8 bytes, and no count of shared bytes is guaranteed. Hence the
fingerprint is wide here: the set's signed sums (SUMS counters) are turned by random matrices, one for each position, and
the position's byte names the strongest sum and its sign. Sets of similarity 0.8 share such a byte with a chance of 0.42,
strangers with 1/256. Lists are keyed by ROWS positional bytes; the shared ones among TALLY more are counted for each pair
that meets, pairs that reach LEAST_SHARED are retained, and verified exactly. At a similarity of 0.8 exactly, BANDS lists
and the tally miss about one pair in a thousand, and fewer above.

Copies are contracted first: neighbours in a few lists are verified and joined into groups. Then only pairs of different
groups are looked for in all lists, so a group of many copies never makes all its pairs. In lists with copies, and in long
ones, members bring a bitmap of their set: the bits in which two bitmaps differ are at most the shingles in which the sets
do, so pairs that are too far apart for sure are left out where they meet, and a group of texts that are only nearly
similar doesn't make its pairs either.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, join_hot, released, written
from .graph import components
from .simhash import runs_of_keys, shingle_hashes, starts_of

SHINGLE, LEAST_PERCENT = 5, 80
SUMS = 128
BANDS, ROWS, TALLY, LEAST_SHARED = 96, 3, 20, 2
POSITIONS = BANDS * ROWS + TALLY
#: Lists in which neighbours are verified to find copies first.
LINK_BANDS = 4
#: A smaller set has no partner but its equals: 3 of 4 is under 0.8.
LEAST_SET = 4
#: Members of a list that one task holds at a time; the members of a longer one are dealt into blocks of pairs of parts.
BLOCK = 2000
#: Members of a list that are compared without their bitmaps, at most.
SHORT_LIST = 8
#: Bits of a bitmap for each shingle, at least; the number of bits is a power of two.
BITS_EACH, LEAST_BITS = 4, 64
#: Bytes of bitmaps that are compared at a time.
BITMAPS_AT_ONCE = 16 << 20
#: The marks of so many pairs are broadcast at most (16 bytes each); those of more pairs are joined to the texts by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: The marks of so many dropped rows are broadcast at most (8 bytes each); beyond, the rows are joined to the kept marks by a shuffle.
BROADCAST_MARKS = 2_000_000
#: Shares into which the pairs of two parts are dealt; the best of each is verified before the others.
PARTS_OF_PAIRS = 64
#: Marks of a block, two of which meet in a task to rule out pairs.
MARKS = 1024
#: Pairs that are sent on at a time.
PAIRS_AT_ONCE = 20_000
#: Texts, and positions, that are multiplied at a time.
TEXTS_AT_ONCE, POSITIONS_AT_ONCE = 256, 44


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, shingle))


@lru_cache(maxsize=1)
def turns() -> np.ndarray:
    return np.random.default_rng(42).standard_normal((SUMS, POSITIONS * SUMS), np.float32)


def signed_sums(hashes: np.ndarray) -> np.ndarray:
    counts = np.bincount((hashes & np.uint64(2 * SUMS - 1)).astype(np.int64), minlength=2 * SUMS)
    return (counts[:SUMS] - counts[SUMS:]).astype(np.float32)


def bitmap(hashes: np.ndarray) -> bytes:
    """For each place, whether an odd number of a set's hashes falls on it: two bitmaps differ in no more bits than their sets in elements."""
    bits = max(LEAST_BITS, 1 << (BITS_EACH * len(hashes) - 1).bit_length()) if len(hashes) else LEAST_BITS
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: bytes, length: int) -> bytes:
    """The bitmap of the same set with fewer places."""
    if len(bits) == length:
        return bits
    x = np.frombuffer(bits, np.uint8).reshape(-1, length)
    return np.bitwise_xor.reduce(x, axis=0).tobytes()


def positional_bytes(sums: np.ndarray) -> np.ndarray:
    """From rows of signed sums: a byte for each row and position, the strongest of the turned sums and its sign."""
    out = np.empty((len(sums), POSITIONS), np.uint8)
    for at in range(0, len(sums), TEXTS_AT_ONCE):
        some = sums[at : at + TEXTS_AT_ONCE]
        for p in range(0, POSITIONS, POSITIONS_AT_ONCE):
            x = (some @ turns()[:, p * SUMS : (p + POSITIONS_AT_ONCE) * SUMS]).reshape(len(some), -1, SUMS)
            best = np.abs(x).argmax(axis=2)
            out[at : at + len(some), p : p + x.shape[1]] = 2 * best + (np.take_along_axis(x, best[:, :, None], 2)[:, :, 0] > 0)
    return out


def list_keys(bytes_: np.ndarray) -> np.ndarray:
    """The number of the list and its positional bytes, as one integer below 2 ** 31."""
    b = bytes_[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.int32)
    return ((np.arange(BANDS, dtype=np.int32) * 256 + b[:, :, 0]) * 256 + b[:, :, 1]) * 256 + b[:, :, 2]


def prints(rows: DataFrame, shingle: int) -> DataFrame:
    """mark, id, same (equal for equal sets), size, tally (bytes), lists and bits (a bitmap; null with the lists of small sets) of each row (mark, id, text)."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            same, sizes, sums, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, shingle)
                same.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                sizes.append(len(hashes))
                sums.append(signed_sums(hashes))
                bits.append(bitmap(hashes) if len(hashes) >= LEAST_SET else None)
            made = positional_bytes(np.array(sums, np.float32).reshape(-1, SUMS))
            listed = np.array(sizes, np.int64) >= LEAST_SET
            ends = np.concatenate([[0], np.cumsum(listed * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(list_keys(made[listed]).ravel()))
            tally = [t.tobytes() for t in made[:, BANDS * ROWS :]]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("id"), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tally, pa.binary()), lists, pa.array(bits, pa.binary())], names=["mark", "id", "same", "size", "tally", "lists", "bits"])

    return rows.select("mark", "id", "text").mapInArrow(released(run), f"mark long, id {dict(rows.dtypes)['id']}, same binary, size long, tally binary, lists array<int>, bits binary")


MEMBER = np.dtype([("mark", "<i8"), ("part", "<i8"), ("size", "<i8"), ("chunk", "<i8"), ("tally", "u1", TALLY)])
#: With its bitmap, or None.
FULL_MEMBER = np.dtype([*MEMBER.descr, ("bits", "O")])
MEMBERS = "mark long, part long, size long, chunk long, tally binary"


def _members(batch: pa.RecordBatch) -> np.ndarray:
    full = "bits" in batch.schema.names
    out = np.zeros(batch.num_rows, FULL_MEMBER if full else MEMBER)
    if full:
        bits = np.empty(batch.num_rows, object)
        bits[:] = batch.column("bits").to_pylist()
        out["bits"] = bits
    for name in ("mark", "part", "size", "chunk"):
        out[name] = batch.column(name).to_numpy()
    if batch.num_rows:
        out["tally"] = np.frombuffer(b"".join(batch.column("tally").to_pylist()), np.uint8).reshape(-1, TALLY)
    return out


def retained(x: np.ndarray, y: np.ndarray, least_percent: int) -> np.ndarray:
    """Which pairs of members, of different parts, share enough positional bytes and have sizes that allow the similarity."""
    low, high = np.minimum(x["size"], y["size"]), np.maximum(x["size"], y["size"])
    ok = (x["part"] != y["part"]) & (100 * low >= least_percent * high)
    return ok & ((x["tally"] == y["tally"]).sum(axis=-1) >= LEAST_SHARED)


def _pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Marks, parts and shared bytes of pairs of members, the lesser part first."""
    out = np.stack([x["mark"], y["mark"], x["part"], y["part"], (x["tally"] == y["tally"]).sum(axis=-1)], axis=1)
    swap = out[:, 2] > out[:, 3]
    out[swap] = out[swap][:, [1, 0, 3, 2, 4]]
    return out


def not_apart(m: np.ndarray, k: int, others: np.ndarray, least_percent: int) -> np.ndarray:
    """Which of the members at `others` the bitmaps leave as possible partners of member k: those whose sets may differ in few enough elements."""
    own, bits = m["bits"][k], m["bits"][others]
    length = np.minimum(len(own), np.array([len(x) for x in bits], np.int64))
    both, ok = m["size"][k] + m["size"][others], np.zeros(len(others), bool)
    for n in np.unique(length).tolist():
        some, mine = np.flatnonzero(length == n), np.frombuffer(folded(own, n), np.uint64)
        for at in range(0, len(some), max(1, BITMAPS_AT_ONCE // n)):
            part = some[at : at + max(1, BITMAPS_AT_ONCE // n)]
            theirs = np.frombuffer(b"".join([folded(bits[i], n) for i in part]), np.uint64).reshape(len(part), -1)
            apart = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
            # They share (both - apart) / 2 at most, and have (both + apart) / 2 at least in all.
            ok[part] = 100 * (both[part] - apart) >= least_percent * (both[part] + apart)
    return ok


def pairs_of(m: np.ndarray, least_percent: int) -> list[np.ndarray]:
    """Retained pairs of one list, without those that bitmaps rule out if members have them; where members have chunks of two numbers, only pairs of both."""
    found, crossed = [], len(m) > 0 and m["chunk"].min() != m["chunk"].max()
    full = "bits" in m.dtype.names
    for k in range(len(m) - 1):
        rest = m[k + 1 :]
        ok = retained(m[k : k + 1], rest, least_percent)
        if crossed:
            ok &= rest["chunk"] != m["chunk"][k]
        if full and ok.any():
            some = np.flatnonzero(ok)
            ok[some] = not_apart(m, k, k + 1 + some, least_percent)
        if ok.any():
            found.append(_pairs(np.repeat(m[k : k + 1], int(ok.sum())), rest[ok]))
    return found


PAIR = "a long, b long, pa long, pb long, shared long"


def _pair_batch(pairs: list[np.ndarray]) -> dict:
    return dict(zip(("a", "b", "pa", "pb", "shared"), np.concatenate([np.empty((0, 5), np.int64), *pairs]).T, strict=True))


def _pair_rows(pairs: list[np.ndarray]):
    got = _pair_batch(pairs)
    for at in range(0, max(1, len(got["a"])), PAIRS_AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v[at : at + PAIRS_AT_ONCE])) for v in got.values()], names=list(got))


def neighbour_pairs(reps: DataFrame, least_percent: int) -> DataFrame:
    """a, b: members that stand side by side in one of the first lists, sorted by a hash; a long list is split over tasks."""
    listed = reps.select(F.explode(F.slice("lists", 1, LINK_BANDS).cast("array<long>")).alias("key"), "mark", F.col("mark").alias("part"), "size", F.lit(0).cast("long").alias("chunk"), "tally", F.xxhash64("mark").alias("_order"))

    def run(batches):
        last_key, last = None, None
        for batch in batches:
            key, m = batch.column("key").to_numpy(), _members(batch)
            if last is not None:
                key, m = np.append(last_key, key), np.append(last, m)
            if not len(m):
                continue
            ok = (key[1:] == key[:-1]) & retained(m[1:], m[:-1], least_percent)
            yield from _pair_rows([_pairs(m[1:][ok], m[:-1][ok])])
            last_key, last = key[-1:], m[-1:]

    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartitionByRange(n, "key", "_order").sortWithinPartitions("key", "_order").drop("_order").mapInArrow(released(run), PAIR).select("a", "b").distinct()


OUT = "kind int, key long, " + PAIR + ", " + MEMBERS
_TYPES = {"kind": pa.int32(), "tally": pa.binary()}
_OUT = [x.split(" ")[0] for x in OUT.split(", ")]


def _out(kind: int, n: int, **columns) -> pa.RecordBatch:
    made = {"kind": np.full(n, kind, np.int32)} | columns
    return pa.RecordBatch.from_arrays([pa.array(made[c], _TYPES.get(c, pa.int64())) if c in made else pa.nulls(n, _TYPES.get(c, pa.int64())) for c in _OUT], names=_OUT)


def far_pairs(reps: DataFrame, least_percent: int, block: int = BLOCK) -> DataFrame:
    """a, b, their parts pa < pb, and the shared bytes of retained pairs of different parts that meet in any list; reps has mark, part, alone, size, tally and lists, and bits or not.

    Members that are alone in their part come with all their lists; of the others each list gets one row a part. Where such
    a part meets another one, or a list is long, the list is opened: all its members are dealt into blocks of pairs of parts
    that one task can hold, and compared there, by their bitmaps too if reps has bits. So lists that aren't opened give a
    member no more than SHORT_LIST pairs each, and the others only pairs that may well be similar.
    """
    listed = reps.select(F.explode(F.col("lists").cast("array<long>")).alias("key"), "mark", "part", "size", F.lit(0).cast("long").alias("chunk"), "tally", "alone")
    grouped = listed.filter("NOT alone").drop("alone")
    one_each = grouped.groupBy("key", "part").agg(F.lit(-1).cast("long").alias("mark"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("chunk"), F.lit(bytes(TALLY)).alias("tally"))
    names = ["key", "mark", "part", "size", "chunk", "tally"]
    every = listed.filter("alone").select(names).unionByName(one_each.select(names))

    def opened(key, m):
        m = m[m["mark"] >= 0]
        yield _out(2, 1, key=key[:1])
        yield _out(1, len(m), key=key[: len(m)], mark=m["mark"], part=m["part"], size=m["size"], chunk=m["chunk"], tally=[t.tobytes() for t in m["tally"]])

    def run(batches):
        for key, m, hot in runs_of_keys(batches, _members, block):
            if hot:
                yield from opened(key, m)
                continue
            starts = starts_of(key)
            sizes = np.diff(np.append(starts, len(key)))
            two = starts[sizes == 2]
            some = (m["mark"][two] >= 0) & (m["mark"][two + 1] >= 0)
            pairs = two[some][retained(m[two[some]], m[two[some] + 1], least_percent)]
            found = [_pairs(m[pairs], m[pairs + 1])]
            rest = [(s, 2) for s in two[~some].tolist()] + list(zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True))
            for s, n in rest:
                x = m[s : s + n]
                if (x["mark"] < 0).any() or n > min(block, SHORT_LIST):
                    if (x["part"] != x["part"][0]).any():
                        yield from opened(key[s : s + n], x)
                else:
                    found += pairs_of(x, least_percent)
            got = _pair_batch(found)
            for at in range(0, len(got["a"]), PAIRS_AT_ONCE):
                some = {c: np.ascontiguousarray(v[at : at + PAIRS_AT_ONCE]) for c, v in got.items()}
                yield _out(0, len(some["a"]), **some)

    met = written(every.repartition("key").sortWithinPartitions("key").mapInArrow(released(run), OUT), "lists")
    columns = ["a", "b", "pa", "pb", "shared"]
    near = met.filter("kind = 0").select(columns)
    opens = written(met.filter("kind = 2").select("key").distinct(), "opens")
    n_open = opens.count()
    if n_open == 0:
        return near.distinct()
    # So that a list's members are not shuffled only to find the few that are opened.
    opens = F.broadcast(opens) if n_open <= BROADCAST_PAIRS else opens
    members = written(met.filter("kind = 1").select(names).unionByName(grouped.join(opens, "key", "left_semi").select(names)), "open")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    each = join_hot(members, sizes, "key", "n", members.count()).withColumn("chunk", F.pmod(F.xxhash64("mark"), F.col("parts")))
    if "bits" in reps.columns:
        asked = members.select("mark").distinct()
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_PAIRS else asked
        each, names = each.join(reps.select("mark", "bits").join(asked, "mark", "left_semi"), "mark"), [*names, "bits"]
    each = each.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    each = each.withColumn("key", F.col("key") * (1 << 32) + F.least("chunk", "other") * 65536 + F.greatest("chunk", "other"))

    def blocks(batches):
        for key, m, _ in runs_of_keys(batches, _members, 1 << 40):
            ends = np.append(starts_of(key), len(key)).tolist()
            for s, e in zip(ends, ends[1:], strict=False):
                x = m[s:e]
                # The block of a part with itself has that part alone.
                yield from _pair_rows(pairs_of(x, least_percent))

    more = each.select(names).repartition("key").sortWithinPartitions("key").mapInArrow(released(blocks), PAIR)
    return near.unionByName(more).distinct()


def possible(pairs: DataFrame, texts: DataFrame, shingle: int, least_percent: int) -> DataFrame:
    """The pairs (a, b; written) without those that 16 bits of each shingle's hash rule out: sets share at most what they share there.

    Marks are dealt into blocks. A set goes to each pair of blocks in which it has a pair, once, and not along with each
    pair, so a group of texts that are nearly similar moves its sets a few times however many pairs it has. A task holds
    two blocks of short hashes.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("mark")).agg(F.approx_count_distinct("mark")).first()[0]
    blocks = max(1, -(-asked // MARKS))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    unit = F.least(block("a"), block("b")) * blocks + F.greatest(block("a"), block("b"))
    dealt = pairs.select("a", "b", unit.alias("unit"))
    # No more units than blocks for a mark.
    needed = dealt.select(F.explode(F.array("a", "b")).alias("mark"), "unit").groupBy("mark").agg(F.collect_set("unit").alias("units"))
    needed = F.broadcast(needed) if pairs.count() <= BROADCAST_PAIRS else needed

    def short(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            made = [np.sort(x.astype(np.uint16)).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), batch.column("units"), pa.array(made, pa.binary())], names=["mark", "units", "hashes"])

    of = texts.select("mark", "text").join(needed, "mark").mapInArrow(released(short), "mark long, units array<long>, hashes binary")
    rows = of.select(F.explode("units").alias("unit"), F.col("mark").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")
    rows = rows.unionByName(dealt.withColumn("hashes", F.lit(None).cast("binary")))

    def check(batches):
        now, sets = None, {}
        for batch in batches:
            found = []
            for unit, a, b, hashes in zip(*(batch.column(c).to_pylist() for c in ("unit", "a", "b", "hashes")), strict=True):
                if unit != now:
                    now, sets = unit, {}
                if b is None:
                    sets[a] = np.frombuffer(hashes, np.uint16)
                    continue
                x, y = sets[a], sets[b]
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                if 100 * shared >= least_percent * (len(x) + len(y) - shared):
                    found.append((a, b))
            got = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(2)], names=["a", "b"])

    # Sets come before the pairs of their unit.
    return rows.repartition("unit").sortWithinPartitions("unit", F.col("b").asc_nulls_first()).select("unit", "a", "b", "hashes").mapInArrow(released(check), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, least_percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, written; texts has mark and text."""
    every = written(pairs, "pairs")
    pairs = written(possible(every, texts, shingle, least_percent), "possible")
    forget(every)

    def sets(batches):
        for batch in batches:
            made = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(made, pa.binary())], names=["mark", "hashes"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    asked = F.broadcast(asked) if pairs.count() <= BROADCAST_PAIRS else asked
    of = written(texts.select("mark", "text").join(asked, "mark", "left_semi").mapInArrow(released(sets), "mark long, hashes binary"), "sets")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * shared >= least_percent * (len(x) + len(y) - shared))
            some = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(some), batch.column("b").filter(some)], names=["a", "b"])

    both = pairs.join(of.select(F.col("mark").alias("b"), F.col("hashes").alias("y")), "b").join(of.select(F.col("mark").alias("a"), F.col("hashes").alias("x")), "a")
    out = written(both.select("a", "b", "x", "y").mapInArrow(released(check), "a long, b long"), "links")
    forget(pairs, of)
    return out


def similar_parts(reps: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """node, component of the marks that links join; reps (mark, size, tally, lists, bits) has one mark of each set."""
    near = verified(neighbour_pairs(reps, least_percent), texts, shingle, least_percent)
    parts = components(near)
    placed = reps.join(parts, reps["mark"] == parts["node"], "left")
    placed = placed.select("mark", F.coalesce("component", "mark").alias("part"), F.isnull("component").alias("alone"), "size", "tally", "lists", "bits")
    placed = written(placed, "placed")
    far = written(far_pairs(placed, least_percent), "far")
    forget(placed)
    # One link joins two parts, so of each two parts the pair that shares most is verified first, then the best of each
    # PARTS_OF_PAIRS shares of their pairs, and all others only if the parts are still apart after that.
    best = F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("x")
    first = far.groupBy("pa", "pb").agg(best).select("pa", "pb", "x.*")
    some = far.groupBy("pa", "pb", F.pmod(F.xxhash64("a", "b"), F.lit(PARTS_OF_PAIRS)).alias("_part")).agg(best).select("pa", "pb", "x.*")
    links = [near, verified(first.select("a", "b"), texts, shingle, least_percent)]
    now, done = components(reduce(DataFrame.unionByName, links)), first
    for step in (some, far):
        apart = step.select("pa", "pb").distinct()
        for side in ("pa", "pb"):
            apart = apart.join(now.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left")
        apart = written(apart.filter("coalesce(_pa, pa) <> coalesce(_pb, pb)").select("pa", "pb"), "apart")
        if apart.isEmpty():
            forget(apart)
            break
        rest = step.join(apart, ["pa", "pb"], "left_semi").join(done.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
        links.append(verified(rest, texts, shingle, least_percent))
        forget(apart)
        now, done = components(reduce(DataFrame.unionByName, links)), some
    forget(far, *links)
    return now


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """docs with one row of each group of rows that links of similarity least_percent (80 or more) join: that of least doc_id, of equals the first.

    Rows without an id come after those with one. Null texts and texts without words are alike, and like no other; repeated
    rows are one group; a text may be of any length; an empty table gives an empty result; docs may have any other columns,
    none of which is read or changed. The rows are written once with their marks, so docs is read once. Which rows stay is
    decided among the distinct sets, so no group's rows are ever gathered.
    """
    if least_percent < 80:
        raise ValueError("the lists are made for similarities of 80 percent and more")
    rows = written(docs.select(F.monotonically_increasing_id().alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "rows")
    texts = rows.select("mark", F.col("doc.doc_id").alias("id"), F.col("doc.text").alias("text"))
    made = written(prints(texts, shingle), "prints")
    sames = written(made.groupBy("same").agg(F.min("mark").alias("first"), F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("best")), "sets")
    reps = written(made.join(sames, made["mark"] == sames["first"], "left_semi").drop("id", "same"), "reps")
    forget(made)
    parts = similar_parts(reps, texts, shingle, least_percent)
    placed = sames.join(parts, sames["first"] == parts["node"], "left").groupBy(F.coalesce("component", "first").alias("part"))
    kept = written(placed.agg(F.min("best")["mark"].alias("mark")), "kept")
    forget(reps)
    dropped = written(rows.select("mark").join(kept, "mark", "left_anti"), "dropped")
    if dropped.count() <= BROADCAST_MARKS:
        return rows.join(F.broadcast(dropped), "mark", "left_anti").select("doc.*")
    return rows.join(kept, "mark", "left_semi").select("doc.*")
