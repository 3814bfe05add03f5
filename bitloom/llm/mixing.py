"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source is a queue of its documents in a seeded shuffle, gone through ``most`` times at most. A document's virtual
finish time is its source's cumulative words divided by the source's target. All queues are merged by that time and cut
at the total budget. Cumulative sums are in two levels (sums of hash buckets, then a running sum inside a bucket), so a
source with most of the rows is spread over all tasks; the cut is found in a histogram of finish times, and only the
histogram's one bucket that holds the cut is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import cut, power_of_two

#: Rows that a bucket of the running sums is meant to hold.
BUCKET_ROWS = 1_000
#: Bins of a histogram of finish times, and rows of a bin that are put in order.
BINS, FEW_ROWS = 1024, 4_000
SEED = "mix"
KEY = ["no_source", "source_key"]


def words(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    return docs.select(
        docs[id_col].alias("doc_id"),
        docs[source_col].isNull().alias("no_source"),
        F.coalesce(docs[source_col], F.lit("")).alias("source_key"),
        words(F.coalesce(docs[text_col], F.lit(""))).alias("size"),
        key.alias("shuffle_key"),
        *more,
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sources (no_source, source_key, source_size) with weight and target.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size and the excess goes to the others by weight: of all levels at which the first k
    sources by size per weight are full, the first that overfills no other is the right one.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy("no_source", "source_key"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    ratio = F.lit(most) * F.col("source_size") / F.col("weight")
    ordered = everything.orderBy("ratio", "no_source", "source_key")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        sources.withColumn("weight", weight.cast("long"))
        .withColumn("ratio", ratio)
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no_source", "source_key", "level"))).over(everything)["level"])
        .withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.col("level") * F.col("weight")))
        .select(*KEY, "source_size", "weight", "budget", "target")
    )


def _bucket(buckets: int) -> Column:
    return F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int")


def _queued(rows: DataFrame, offsets: DataFrame, buckets: int) -> DataFrame:
    """rows with the cumulative words of their source up to and with the row, in the shuffled order."""
    inside = Window.partitionBy(*KEY, "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("bucket", _bucket(buckets)).join(offsets, [*KEY, "bucket"])
    return placed.withColumn("reach", F.col("offset") + F.sum("size").over(inside)).drop("offset")


def _finish(turn: Column | int) -> Column:
    """Virtual finish time of the row in its source's so-many-th turn, from 0; null where the target is 0."""
    return (F.col("source_size") * turn + F.col("reach")) / F.nullif(F.col("target"), F.lit(0.0))


def _cut_off(queued: DataFrame, budget: int, most: int) -> tuple | None:
    """The last row, as an order key, that the budget still holds; None if it holds none.

    A histogram of finish times, BINS wide, tells in which bin the budget ends; that bin is divided anew until it has few rows,
    and only those are put in order. Rows of one finish time cannot be divided further: as words only add up within a source,
    there is one such row a source, so even they are few.
    """
    turns = queued.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", _finish(F.col("turn"))).where("finish is not null")
    order = ["finish", *KEY, "shuffle_key", "doc_id", "size"]
    last_of = lambda df: df.select(*order).orderBy(*(F.col(c).desc() for c in order)).first()
    ends = turns.agg(F.min("finish"), F.max("finish"), F.sum("size")).first()
    if ends[0] is None:
        return None
    low, high, below = ends[0], ends[1], 0
    if ends[2] <= budget:
        return tuple(last_of(turns))
    while True:
        inside = turns.where(F.col("finish").between(low, high))
        width = (high - low) / BINS
        number = F.lit(0).cast("long") if width <= 0 else F.least(F.floor((F.col("finish") - low) / width), F.lit(BINS - 1))
        found = inside.groupBy(number.alias("bin")).agg(F.sum("size").alias("words"), F.min("finish").alias("low"), F.max("finish").alias("high"), F.count("*").alias("rows")).collect()  # BINS rows at most
        for one in sorted(found, key=lambda r: r["bin"]):
            if below + one["words"] > budget:
                break
            below += one["words"]
        same = (one["low"], one["high"]) == (low, high) or one["low"] == one["high"]
        low, high = one["low"], one["high"]
        if one["rows"] <= FEW_ROWS or same:
            break
    run = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = turns.where(F.col("finish").between(low, high)).withColumn("upto", F.sum("size").over(run) + below).where(F.col("upto") <= budget)
    row = last_of(held) or last_of(turns.where(F.col("finish") < low))
    return tuple(row) if row else None


def _copies(last: tuple | None, most: int) -> Column:
    """How many of the row's turns come no later than the last row held."""
    if last is None:
        return F.lit(0)
    finish, *rest = last
    names = [*KEY, "shuffle_key", "doc_id", "size"]
    tie = F.struct(*(F.col(c).alias(c) for c in names)) <= F.struct(*(F.lit(v).cast(k).alias(c) for c, v, k in zip(names, rest, ("boolean", "string", "string", "long", "long"), strict=True)))
    held = lambda t: F.coalesce((_finish(t) < finish) | ((_finish(t) == finish) & tie), F.lit(False)).cast("int")
    return sum((held(t) for t in range(1, most)), held(0))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, budget: int | None):
    light = cut(_sized(docs, id_col, text_col, source_col))
    buckets = power_of_two(light.count() / BUCKET_ROWS)
    sums = cut(light.groupBy(*KEY, _bucket(buckets).alias("bucket")).agg(F.sum("size").alias("words")))
    aims = targets(sums.groupBy(*KEY).agg(F.sum("words").alias("source_size")), weights, most)
    run = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select(*KEY, "bucket", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("offset")).join(aims, KEY))
    queued = cut(_queued(light, offsets, buckets))
    total = offsets.select(F.max("budget")).first()[0]
    last = None if total is None else _cut_off(queued, total if budget is None else budget, most)
    return queued, offsets, buckets, last


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, budget: int | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken): one row per row of docs.

    size: the text's words (null: 0). taken = copies * size, copies from 0 to ``most``; a text without words has no copies.
    budget: words in all; by default the sum of all sizes. A null source is a source of its own, after all others, and
    differs from an empty name. Rows that repeat an id queue one after the other; reruns agree, as the order follows
    from the id alone, then the size. An empty table gives an empty result. Other columns are not read.
    """
    queued, _, _, last = _plan(docs, id_col, text_col, source_col, weights, most, budget)
    copies = F.when(F.col("size") > 0, _copies(last, most)).otherwise(0)
    return queued.select("doc_id", "size", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, budget: int | None = None) -> DataFrame:
    """The mix itself in docs' own columns: each row as many times as the mix takes it. A row without words is taken once: it costs nothing."""
    _, offsets, buckets, last = _plan(docs, id_col, text_col, source_col, weights, most, budget)
    whole = _sized(docs, id_col, text_col, source_col, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    copies = F.when(F.col("size") > 0, _copies(last, most)).otherwise(1)
    return _queued(whole, offsets, buckets).select("row", copies.alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
