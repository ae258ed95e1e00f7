"""Sharding by a hierarchical weighted hash tree.

A row descends from the root to a shard. At each level every child draws -ln(u) / weight, with u a hash of the row's key
and the child's name, and the least draw wins; so a child gets rows in proportion to its weight. A child's draw depends on
its own weight only, hence a changed weight moves rows into or out of that child's subtree and nowhere else. A new shard
joins as a region of its own: no other weight changes, so all rows that move go to the new shard.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written


@dataclass(frozen=True)
class Node:
    """A region, a rack or, if it has a shard number, a shard."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def shard_tree(shards: int, regions: int = 2, racks: int = 2) -> Node:
    """Shards 0 to shards - 1, dealt over the racks of each region."""
    if shards < 1 or regions < 1 or racks < 1:
        raise ValueError("shards, regions and racks are 1 or more")
    homes: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        g = s * regions // shards
        first = -(-g * shards // regions)
        last = -(-(g + 1) * shards // regions)
        homes.setdefault(g, {}).setdefault((s - first) * racks // max(1, last - first), []).append(Node(f"shard{s}", shard=s))
    return Node("root", tuple(Node(f"region{g}", tuple(Node(f"region{g}/rack{k}", tuple(v)) for k, v in r.items())) for g, r in homes.items()))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """tree with one more shard, in a region of its own."""
    leaf = Node(f"shard{shard}", shard=shard, own_weight=weight)
    name = f"region-of-shard{shard}"
    return Node(tree.name, (*tree.children, Node(name, (Node(f"{name}/rack0", (leaf,)),))))


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight, with u in (0, 1) from the first 52 bits of an MD5 sum."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{node.name}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(2**52))) / F.lit(float(node.weight))


def place(key: Column, tree: Node) -> Column:
    """The shard of a key: a column of nested choices, one level below the other."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    kids = [c for c in tree.children if c.weight > 0]
    if not kids:
        raise ValueError(f"{tree.name} has no weight")
    if len(kids) == 1:
        return place(key, kids[0])
    draws = [_draw(key, c) for c in kids]
    best = F.least(*draws)
    return reduce(lambda rest, x: F.when(x[0] == best, place(key, x[1])).otherwise(rest), reversed(list(zip(draws[:-1], kids[:-1], strict=True))), place(key, kids[-1]))


def shard_rows(docs: DataFrame, tree: Node, more: Node) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row; grown_shard is its shard in the tree `more`.

    A null id counts as the text 'null', a null text as an empty one. Repeated rows stay, and get slots of their own.
    An empty table gives an empty result; other columns are ignored. Slots count each shard's rows from 0 by doc_id, and
    equal ids by text_crc32 and size. They come from one range-partitioned sort: a row's slot is its place in its
    partition plus the rows of its shard in the partitions before, so no shard is ever gathered in one task, and a key that
    many rows share is split by the rows' places in the input.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), place(key, tree).alias("shard"), place(key, more).alias("grown_shard"), F.monotonically_increasing_id().alias("_row"))
    order = ["shard", "doc_id", "text_crc32", "size", "_row"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_row")
    # The place of a row in its sorted partition is read more than once, so it is written first.
    spread = written(spread.withColumn("_at", F.monotonically_increasing_id()), "sharding")
    part = F.shiftright("_at", 33).cast("int")
    parts = spread.groupBy(part.alias("_part"), "shard").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition and shard that meet: at most partitions + shards, as the partitions are ranges.
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = spread.withColumn("_part", part).join(F.broadcast(parts), ["_part", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_at") - F.col("_first") + F.col("_before")).alias("slot"), "grown_shard")


SHARDS = 8


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards, and in nine. Null ids and texts, repeated rows and empty tables: see shard_rows."""
    tree = shard_tree(SHARDS)
    return shard_rows(documents(spark, sf_dir), tree, grown(tree, SHARDS))


def _sql_place(tree: Node) -> str:
    if tree.shard is not None:
        return str(tree.shard)
    if len(tree.children) == 1:
        return _sql_place(tree.children[0])
    draws = [f"(-ln((CAST('0x' || substr(md5(k || ':{c.name}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / {c.weight}::DOUBLE)" for c in tree.children]
    cases = " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {_sql_place(c)}" for d, c in zip(draws[:-1], tree.children[:-1], strict=True))
    return f"CASE {cases} ELSE {_sql_place(tree.children[-1])} END"


_TREE = shard_tree(SHARDS)
OP3_SQL = f"""
WITH RECURSIVE steps AS (SELECT n, n AS c, 0 AS k FROM range(256) AS r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, k, octet_length(b) + 1 AS size, regexp_extract_all(hex(b), '..') AS x FROM d),
c AS (SELECT doc_id, k, size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(x, lambda e: CAST('0x' || e AS BIGINT))),
  lambda a, e: xor(tab.t[(xor(a, e) & 255) + 1], a >> 8))) AS BIGINT) AS text_crc32 FROM h, tab),
p AS (SELECT *, {_sql_place(_TREE)} AS shard, {_sql_place(grown(_TREE, SHARDS))} AS grown_shard FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM p
"""
