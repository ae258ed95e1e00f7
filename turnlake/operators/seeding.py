"""Seeds for k-means by a specified key stream: the ChaCha generator with 8 rounds, its key spread from a number by PCG.

Both are published algorithms, and their constants are fixed values. The stream depends on the seed only, so its words are
literals of the plan; which of them a recording uses follows from its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import Rounds

M32, M64 = (1 << 32) - 1, (1 << 64) - 1
#: The multiplier and increment that spread a seed, ChaCha's first row, and its quarters of columns and diagonals.
SPREAD, STEP = 6364136223846793005, 11634580027462260723
FIRST_ROW = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)
QUARTERS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
TURNS = (16, 12, 8, 7)


def key_of(seed: int) -> list[int]:
    """Eight words from a seed of 64 bits: permuted outputs of a congruential generator."""
    out, state = [], seed & M64
    for _ in range(8):
        state = (state * SPREAD + STEP) & M64
        x, by = (((state >> 18) ^ state) >> 27) & M32, state >> 59
        out.append((x >> by | x << (32 - by)) & M32 if by else x)
    return out


def block(key: list[int], counter: int) -> list[int]:
    start = [*FIRST_ROW, *key, counter & M32, counter >> 32 & M32, 0, 0]
    x = list(start)
    for _ in range(4):
        for a, b, c, d in QUARTERS:
            for add, to, at, by in ((b, a, d, TURNS[0]), (d, c, b, TURNS[1]), (b, a, d, TURNS[2]), (d, c, b, TURNS[3])):
                x[to] = (x[to] + x[add]) & M32
                v = x[at] ^ x[to]
                x[at] = (v << by | v >> (32 - by)) & M32
    return [(p + q) & M32 for p, q in zip(x, start, strict=True)]


def key_stream(seed: int, words: int) -> list[int]:
    key = key_of(seed)
    return [w for n in range(-(-words // 16)) for w in block(key, n)][:words]


class Draws:
    """Numbers of a key stream, in order."""

    def __init__(self, seed: int):
        self.key, self.words, self.at = key_of(seed), [], 0

    def word(self) -> int:
        if self.at == len(self.words):
            self.words += block(self.key, len(self.words) // 16)
        self.at += 1
        return self.words[self.at - 1]

    def long(self) -> int:
        low = self.word()
        return self.word() << 32 | low

    def unit(self) -> float:
        """0 or more and less than 1, from the highest 53 bits."""
        return (self.long() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        """0 to n - 1, each with the same chance: the few words that would favour some are passed over."""
        while True:
            p = self.word() * n
            if p & M32 >= ((1 << 32) - n) % n:
                return p >> 32


def seeds(vecs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """rec, cluster, i: the vectors (rec, i from 0, u: array<double>) that k-means starts from, for all recordings at once.

    The first is drawn evenly, each other one by its squared distance to the nearest of those before: running sums of the
    distances in the order of i, and the first that exceeds the drawn share of their total. Where all distances are 0, one
    of the vectors that aren't chosen yet is drawn evenly. A recording of n vectors gets at most n seeds.
    """
    words = key_stream(seed, 8 * k + 64)
    stream = F.array(*(F.lit(w) for w in words))
    rounds = Rounds(vecs.sparkSession, "seeds")
    one = Window.partitionBy("rec")

    def evenly(n: Column, at: Column) -> Column:
        """place and next position of a draw below n."""
        fair = F.filter(F.sequence(at, F.lit(len(words) - 1)), lambda p: F.pmod(F.get(stream, p) * n, F.lit(1 << 32)) >= F.pmod(F.lit(1 << 32) - n, n))
        p = F.element_at(fair, 1)
        return F.struct(F.shiftright(F.get(stream, p) * n, 32).alias("place"), (p + 1).alias("at"))

    rows = vecs.select("rec", "i", "u").withColumn("_n", F.count(F.lit(1)).over(one))
    rows = rows.withColumn("_draw", evenly(F.col("_n"), F.lit(0)))
    rank = F.row_number().over(one.orderBy("i")) - 1
    rows = rows.withColumn("_rank", rank).withColumn("cluster", F.when(F.col("_rank") == F.col("_draw.place"), 0)).withColumn("_at", F.col("_draw.at")).withColumn("_far", F.lit(float("inf"))).drop("_draw")
    state = rounds.write(rows)
    for c in range(1, k):
        newest = state.filter(F.col("cluster") == c - 1).select("rec", F.col("u").alias("_c"))
        near = state.join(newest, "rec", "left").withColumn("_far", F.when(F.col("_c").isNull(), F.col("_far")).otherwise(F.least("_far", F.aggregate(F.zip_with("u", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))))
        near = near.drop("_c").withColumn("_total", F.sum("_far").over(one)).withColumn("_left", F.sum(F.col("cluster").isNull().cast("long")).over(one))
        low, high = F.get(stream, F.col("_at")), F.get(stream, F.col("_at") + 1)
        share = (F.shiftright(low, 11) + high * (1 << 21)).cast("double") * 2.0**-53
        run = one.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        near = near.withColumn("_sum", F.sum("_far").over(run)).withColumn("_free", F.sum(F.col("cluster").isNull().cast("long")).over(run))
        passed = F.min(F.when(F.col("_sum") > share * F.col("_total"), F.col("_rank"))).over(one)
        near = near.withColumn("_even", F.when((F.col("_total") == 0) & (F.col("_left") > 0), evenly(F.col("_left"), F.col("_at"))))
        free = F.min(F.when(F.col("cluster").isNull() & (F.col("_free") == F.col("_even.place") + 1), F.col("_rank"))).over(one)
        pick = F.when(F.col("_total") > 0, F.coalesce(passed, F.col("_n") - 1)).when(F.col("_left") > 0, free)
        at = F.when(F.col("_total") > 0, F.col("_at") + 2).otherwise(F.coalesce("_even.at", "_at"))
        chosen = near.withColumn("_pick", pick).withColumn("cluster", F.when(F.col("cluster").isNull() & (F.col("_rank") == F.col("_pick")), c).otherwise(F.col("cluster"))).withColumn("_at", at)
        after = rounds.write(chosen.select("rec", "i", "u", "_n", "_rank", "cluster", "_at", "_far"))
        rounds.drop(state)
        state = after
    return state.filter("cluster IS NOT NULL").select("rec", "cluster", "i")
