"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with u a
hash of key and child, and the smallest draw wins. A child's draw depends on nothing but the key, the
child's name and its weight, so changing weights inside a subtree moves keys only within it, or
between it and its siblings when its total changes; no other pair of siblings exchanges keys.

A shard added beyond the base tree becomes a region of its own: its draw can only win keys for
itself, and no key moves between old shards.

Defined results: null key is hashed as text "null"; null text has size 1 and CRC 0; rows with equal
keys go to one shard; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots are counted within this many hash buckets of each shard: no task numbers a whole shard.
BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0  # used for shards; inner nodes weigh what their children weigh
    shard: int = -1
    children: tuple[Node, ...] = field(default=())

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(n_shards: int, base: int = 8, regions: int = 2, racks: int = 2) -> Node:
    """The tree of ``n_shards`` shards: ``base`` of them in a fixed hierarchy, each later one a region."""
    fixed = min(n_shards, base)
    groups: dict[tuple[int, int], list[Node]] = {}
    for s in range(fixed):
        groups.setdefault((s % regions, s // regions % racks), []).append(Node(f"s{s}", 1.0, s))
    top = []
    for r in range(regions):
        held = tuple(Node(f"r{r}/k{k}", children=tuple(leaves)) for (g, k), leaves in sorted(groups.items()) if g == r)
        if held:
            top.append(Node(f"r{r}", children=held))
    top += [Node(f"x{s}", children=(Node(f"x{s}/k", children=(Node(f"s{s}", 1.0, s),)),)) for s in range(fixed, n_shards)]
    return Node("root", children=tuple(top))


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1] from 52 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 12)
    return -F.log((bits.cast("double") + 1.0) / F.lit(float(1 << 52))) / F.lit(node.total)


def place(key: Column, node: Node) -> Column:
    """The shard of a key: the expression follows the tree, drawing only along the way taken."""
    if not node.children:
        return F.lit(node.shard)
    live = [c for c in node.children if c.total > 0]
    if len(live) == 1:
        return place(key, live[0])
    best = F.array_min(F.array(*[F.struct(_draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)])).getField("i")
    out = place(key, live[-1])
    for i in reversed(range(len(live) - 1)):
        out = F.when(best == i, place(key, live[i])).otherwise(out)
    return out


def assign(df: DataFrame, key: str, layout: Node, column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle."""
    return df.withColumn(column, place(F.coalesce(F.col(key).cast("string"), F.lit("null")), layout))


def number(df: DataFrame, shard: str, key: str, column: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard.

    Rows are ordered within (shard, bucket), and buckets start after the counts of those before;
    the counts are at most shards x BUCKETS rows, so that table is broadcast.
    """
    from pyspark.sql import Window as W

    df = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), F.lit("bucket")), F.lit(BUCKETS)).cast("int"))
    counts = df.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
    starts = starts.select(shard, "_bucket", F.coalesce("_start", F.lit(0)).alias("_start"))
    at = F.row_number().over(W.partitionBy(shard, "_bucket").orderBy(key, *[c for c in df.columns if c not in (shard, key, "_bucket")]))
    ranked = df.withColumn("_at", at)
    out = ranked.join(F.broadcast(starts), [shard, "_bucket"])
    return out.withColumn(column, (F.col("_start") + F.col("_at") - 1).cast("long")).drop("_bucket", "_start", "_at")


def shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: where it lies, its slot there, and where one more shard would put it."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(assign(sized, "doc_id", tree(n_shards)), "doc_id", tree(n_shards + 1), "grown_shard")
    return number(placed, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
