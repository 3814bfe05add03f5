"""A dataset's manifest as Merkle trees with nested-interval labels: one tree per part, and one over the parts' roots.

Every node carries the interval of leaf ranks that it covers. Nodes are built in bands of BAND levels: 2 ** BAND nodes
under one node of the band's top meet in one row, so no group grows with the data, and each band has a 2 ** BAND-th of the
rows of the band below.
Proofs are found by joins on the intervals, in buckets by level: the nodes at a band's foot meet, at each level of the
band, the parent whose interval contains theirs; that parent's interval without the part's own leaves the siblings. A band's
steps are put before those of the node above it, so a hot part is met in blocks of 2 ** BAND rows and never as one key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import cut, ranked

#: Levels of a band.
BAND = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<level:int,before:binary,after:binary>>"


def digest(value: Column) -> Column:
    """SHA-256 as lowercase hex text."""
    return F.sha2(value, 256)


def hex_of(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def field(value: Column) -> Column:
    """A null as "-", all else as its length in UTF-8 bytes, a colon and itself, so that no two rows of fields look alike."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The leaf of a row: the digest of its fields in this order."""
    return digest(F.concat(*(field(v) for v in values)))


def height(n: Column) -> Column:
    """Levels above the leaves: as often as n can be halved, rounding up, until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _pairs(nodes: Column) -> Column:
    """The digests of every two neighbours; a last one alone is digested too."""
    return F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(nodes) / 2).cast("int") - 1),
        lambda i: F.unhex(digest(F.concat(hex_of(F.get(nodes, i * 2)), F.coalesce(hex_of(F.get(nodes, i * 2 + 1)), F.lit(""))))),
    )


def nodes_of(leaves: DataFrame) -> DataFrame:
    """All nodes over leaves (part, rank, n, digest): (part, n, level, lo, hi, digest), where lo to hi are the ranks of the leaves below."""
    level_of = height(F.col("n"))
    most = leaves.agg(F.max(level_of)).first()[0] or 0
    base = leaves.select("part", "n", F.col("rank").alias("pos"), "digest")
    out = leaves.select("part", "n", F.lit(0).alias("level"), F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    for first in range(0, most, BAND):
        run = F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        grouped = base.where(level_of > first).groupBy("part", "n", F.shiftright("pos", BAND).alias("block")).agg(run.alias("run"))
        levels = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(BAND), level_of - first)), F.array("run"), lambda done, _: F.concat(done, F.array(_pairs(F.element_at(done, -1)))))
        made = grouped.select("part", "n", "block", F.posexplode(levels).alias("l", "row")).where("l > 0").select("part", "n", "block", "l", F.posexplode("row").alias("i", "digest"))
        level, start = (F.col("l") + first).cast("int"), F.expr(f"shiftleft(shiftleft(block, {BAND} - l) + i, l + {first})")
        end = F.least(start + F.expr(f"shiftleft(1L, l + {first})"), F.col("n")) - 1
        made = cut(made.select("part", "n", level.alias("level"), start.alias("lo"), end.alias("hi"), "digest"))
        out = out.unionByName(made)
        base = made.where(F.col("level") == first + BAND).select("part", "n", F.expr(f"shiftright(lo, {first + BAND})").alias("pos"), "digest")
    return out


def _steps(nodes: DataFrame, first: int) -> DataFrame:
    """(part, n, pos, path): for the nodes at level ``first`` below a root, the siblings on the way up through the band's levels."""
    below = nodes.where((F.col("level") >= first) & (F.col("level") < F.least(F.lit(first + BAND), height(F.col("n")))))
    # children in the bucket of their parent; its interval is theirs together
    family = below.groupBy("part", "level", F.expr("shiftright(lo, level + 1)").alias("bucket")).agg(F.min("lo").alias("from"), F.max("hi").alias("to"), F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
    own = below.where(F.col("level") == first).select("part", "n", F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"))
    climbing = own.withColumn("level", F.explode(F.sequence(F.lit(first), F.least(F.lit(first + BAND), height(F.col("n"))) - 1))).withColumn("bucket", F.expr("shiftright(own_lo, level + 1)"))
    met = climbing.join(family, ["part", "level", "bucket"]).where("own_lo >= `from` and own_hi <= `to`")
    # what the parent's interval holds beside the child that covers these leaves
    apart = lambda side: F.aggregate(F.filter("children", side), F.lit(b""), lambda a, s: F.concat(a, s["digest"]))
    step = F.struct(F.col("level").cast("int").alias("level"), apart(lambda s: s["hi"] < F.col("own_lo")).alias("before"), apart(lambda s: s["lo"] > F.col("own_hi")).alias("after"))
    return met.groupBy("part", "n", F.expr(f"shiftright(own_lo, {first})").alias("pos")).agg(F.sort_array(F.collect_list(step)).alias("path"))


def paths_of(leaves: DataFrame, nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """leaves with the steps to the root (path) and the columns of above.

    above: what follows from a part's root on: (part, above_path and any other columns), one row per part; without it,
    paths end at the part's root.
    """
    level_of = height(F.col("n"))
    parts = leaves.where("rank = 0").select("part", "n")
    if above is None:
        tops = parts.withColumn("above_path", F.array().cast(STEP))
    else:
        tops = parts.join(above, "part")
    extra = [c for c in tops.columns if c not in ("part", "n", "above_path")]
    most = leaves.agg(F.max(level_of)).first()[0] or 0
    reached = tops.where(level_of > most).select("part", F.lit(0).cast("long").alias("block"), "above_path", *extra)
    for first in range((most - 1) // BAND * BAND if most else 0, -1, -BAND):
        # roots that lie in this band, beside the nodes of the band above
        ends = tops.where((level_of <= first + BAND) & ((level_of > first) | F.lit(first == 0))).select("part", F.lit(0).cast("long").alias("block"), "above_path", *extra)
        reached = reached.unionByName(ends)
        steps = _steps(nodes, first)
        if first == 0:
            climbed = leaves.withColumnRenamed("rank", "pos").join(steps.select("part", "pos", "path"), ["part", "pos"], "left").withColumn("path", F.coalesce("path", F.array().cast(STEP)))
        else:
            climbed = steps.drop("n")
        joined = climbed.withColumn("block", F.shiftright("pos", BAND)).join(reached, ["part", "block"]).withColumn("path", F.concat("path", "above_path")).drop("block", "above_path")
        if first == 0:
            return joined.withColumnRenamed("pos", "rank")
        reached = joined.select("part", F.col("pos").alias("block"), F.col("path").alias("above_path"), *extra)


def fold(leaf_text: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_text, lambda a, s: digest(F.concat(hex_of(s["before"]), a, hex_of(s["after"]))))


def proof_text(path: Column) -> Column:
    """The siblings' digests, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(hex_of(s["before"]), hex_of(s["after"]))), "")


@dataclass
class Manifest:
    """leaves: (part, rank, n, digest, lang and what was asked to be carried); nodes of the parts' trees; parts: the leaves of the tree over them; top: its nodes."""

    leaves: DataFrame
    nodes: DataFrame
    parts: DataFrame
    top: DataFrame

    def root(self) -> str | None:
        """The digest of all; None for an empty table."""
        got = self.top.where("lo = 0 and hi = n - 1").select(hex_of(F.col("digest"))).first()
        return got[0] if got else None


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", part_col: str = "lang", carry: dict[str, Column] | None = None) -> Manifest:
    """The trees over docs. carry: columns over docs to keep with the leaves, by name (not part, rank, n, digest, id).

    A null part is one of its own and comes first, parts are in the order of their UTF-8 bytes. In a part, leaves ascend by
    identifier (null ones first) and, where it repeats, by their digests; rows that are the same in all columns may
    change places, which changes no digest. Empty texts are values as others. An empty table has no nodes and no root.
    Other columns are not read.
    """
    part = F.when(F.col(part_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(part_col).cast("string")))
    rows = docs.select(part.alias("part"), F.col(id_col).alias("id"), F.unhex(leaf([F.col(c) for c in columns])).alias("digest"), *(v.alias(k) for k, v in (carry or {}).items()))
    # rows alike in part, id and digest would all be in one task of the sort
    leaves = ranked(rows.withColumn("__row", F.monotonically_increasing_id()), "part", ["id", "digest", "__row"]).drop("__row")
    nodes = nodes_of(leaves)
    roots = nodes.where("lo = 0 and hi = n - 1").select(F.lit("").alias("part"), F.col("part").alias("of"), "digest")
    parts = ranked(roots, "part", ["of"])
    return Manifest(leaves, nodes, parts, nodes_of(parts))


def prove(m: Manifest) -> DataFrame:
    """The leaves with path, subroot and root (hex)."""
    root = m.top.where("lo = 0 and hi = n - 1").select("part", hex_of(F.col("digest")).alias("root"), F.array().cast(STEP).alias("above_path"))
    tops = paths_of(m.parts, m.top, root)
    above = tops.select(F.col("of").alias("part"), F.col("path").alias("above_path"), hex_of(F.col("digest")).alias("subroot"), "root")
    return paths_of(m.leaves, m.nodes, above)
