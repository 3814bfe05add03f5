"""Sharding by a hierarchical weighted hash tree, with DataFrame functions.

A row descends from the root through regions and racks to a shard. At each step every child draws -ln(u)/weight, where u
comes from a hash of the child's name and the row's key, and the smallest draw wins (weighted rendezvous hashing). A
node's weight is the sum of its shards' weights. When a weight changes, only draws of nodes on its path change: rows
move into the subtree that grew or out of the one that shrank, and all others stay. A new shard comes as a rack and a
region of its own, so that it takes rows from all others, and only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import cut, power_of_two

BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree; weights are relative, and a shard of weight 0 takes nothing."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, first: int = 16, regions: int = 2, racks: int = 2) -> list[Shard]:
    """The tree for a number of shards: the first ones spread evenly over regions and racks, each further one a region of its own."""
    out = []
    for s in range(shards):
        if s < first:
            place = s * regions * racks // first
            out.append(Shard(place // racks, place % racks, s))
        else:
            out.append(Shard(regions + s - first, 0, s))
    return out


def _draw(name: str, key: Column, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}|"), key)), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**13))
    return -F.log(u) / F.lit(float(weight))


def _choice(named: list[tuple[int, str, float]], key: Column) -> Column:
    """The number of the child with the smallest draw; named: number, name and weight of each."""
    some = [x for x in named if x[2] > 0]
    if len(some) == 1:
        return F.lit(some[0][0])
    return F.array_min(F.array(*(F.struct(_draw(name, key, w).alias("draw"), F.lit(i).alias("i")) for i, name, w in some)))["i"]


def descend(rows: DataFrame, shards: list[Shard], key: Column, prefix: str = "") -> DataFrame:
    """rows with columns {prefix}region, {prefix}rack and {prefix}shard."""
    weight: dict[tuple[int, ...], float] = {}
    for s in shards:
        for path in ((s.region,), (s.region, s.rack), (s.region, s.rack, s.shard)):
            weight[path] = weight.get(path, 0.0) + s.weight

    def children(above: tuple[int, ...]) -> list[tuple[int, str, float]]:
        return [(p[-1], "/".join(map(str, p)), w) for p, w in sorted(weight.items()) if len(p) == len(above) + 1 and p[: len(above)] == above]

    names = [f"{prefix}{x}" for x in ("region", "rack", "shard")]
    for level, name in enumerate(names):
        chosen = None
        for above in sorted(p for p, w in {(): 1.0, **weight}.items() if len(p) == level and w > 0):
            here = F.lit(True)
            for column, value in zip(names, above, strict=False):
                here = here & (F.col(column) == value)
            one = _choice(children(above), key)
            chosen = F.when(here, one) if chosen is None else chosen.when(here, one)
        rows = rows.withColumn(name, chosen.cast("int"))
    return rows


def slots(rows: DataFrame, group: str, order_key: str, ties: list[str]) -> DataFrame:
    """rows with slot, gapless from 0 in each group, in the order of order_key (an md5 in hex) and ties.

    Two levels, so that no group is in one task: row numbers within buckets of the hash, and the buckets' counts summed up.
    """
    buckets = power_of_two(rows.count() / BUCKET_ROWS)
    placed = rows.withColumn("bucket", F.floor(F.conv(F.substring(order_key, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(group, "bucket").count().select(group, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(group, "bucket").orderBy(order_key, *ties)
    return placed.join(offsets, [group, "bucket"]).withColumn("slot", F.col("offset") + F.row_number().over(inside) - 1).drop("bucket", "offset")


def shard(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, region, rack, shard, slot, grown_shard): one row per row of docs.

    The key is the id in text form, a null id's is empty. size: UTF-8 bytes of the text plus 1 (a null text has none).
    slot: the row's place in its shard, in an order shuffled by id; rows that repeat an id follow one another.
    grown_shard: the shard in the tree ``grown``, null without one. An empty table gives an empty result. Other columns are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = descend(rows, shards, key)
    if grown is None:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        rows = descend(rows, grown, key, "grown_").drop("grown_region", "grown_rack")
    rows = cut(rows.withColumn("order_key", F.md5(F.concat(F.lit("slot|"), key))))
    return slots(rows, "shard", "order_key", ["doc_id", "text_crc32", "size"]).drop("order_key")
