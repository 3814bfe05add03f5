"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions.storage import cut  # noqa: F401  (for this package)

#: Rows in one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 1024


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the checkpoint folder, which the driver and all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, unless the session's owner has chosen otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stay(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id has no decision against it, in docs' own columns.

    decisions: doc_id (each once) and kept. Only ids that go are joined, so that Spark can broadcast them where they are
    few and otherwise splits hot partitions. Of rows that repeat id and text (A-Z in any case), one stays; rows without an id stay.
    """
    gone = decisions.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__gone"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs[id_col].alias("__id"), F.xxhash64(ascii_lower(docs[text_col])).alias("__same"))
    left = rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    # rows without an id all stay, so they may be spread
    salt = F.when(F.col("__id").isNull(), F.monotonically_increasing_id())
    nth = F.row_number().over(Window.partitionBy("__id", "__same", "__salt").orderBy("__same"))
    return left.withColumn("__salt", salt).withColumn("__nth", nth).where("__nth = 1 or __id is null").select("__row.*")


def few_by_hash(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most so many rows of df, those with the smallest hashes of their id, whatever the order of df.

    A threshold on the hash, from the number of rows, first leaves about one and a half times as many as are wanted, so
    that no task sorts or gathers more than that however many partitions df has.
    """
    h = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40))
    n = df.count()
    near = df if n <= 2 * rows else df.where(h < int((1 << 40) * min(1.0, 1.5 * rows / n)))
    return near.orderBy(h, id_col).limit(rows)


def bounded(texts: DataFrame, rows: int, size: int) -> DataFrame:
    """Of texts (text and other columns, each text once), those with the smallest hashes of their text: at most ``rows`` rows and ``size`` bytes.

    Rows and bytes are bounded before anything is gathered: a running sum over at most ``rows`` hashes and lengths says where to
    stop. A text that does not fit ends the sample only for itself.
    """
    h = F.xxhash64("text")
    some = cut(few_by_hash(texts.select(h.alias("__hash"), F.octet_length("text").alias("__bytes")), "__hash", rows))
    upto = F.sum(F.when(F.col("__bytes") <= size, F.col("__bytes"))).over(Window.orderBy("__hash").rowsBetween(Window.unboundedPreceding, 0))
    chosen = some.where(F.col("__bytes") <= size).withColumn("__upto", upto).where(F.col("__upto") <= size).select("__hash").distinct()
    return texts.withColumn("__hash", h).join(F.broadcast(chosen), "__hash", "left_semi").drop("__hash")


#: Rows of a table of offsets that are sent to every executor, at most; a longer table is joined by shuffling.
OFFSET_ROWS = 200_000


def ranked(df: DataFrame, part: str, order: list) -> DataFrame:
    """df with rank (from 0, in its part by ``order``) and n (rows of its part), written once.

    Rows are sorted in ranges, so a hot part lies in many tasks; each range's first rank is the sum of the counts of the ranges before it.
    """
    rows = cut(df.orderBy(part, *order).withColumn("__at", F.monotonically_increasing_id()))
    here = F.shiftright("__at", 33)
    runs = rows.groupBy(F.col(part).alias("__part"), here.alias("__of")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    own = Window.partitionBy("__part")
    before = F.coalesce(F.sum("__rows").over(own.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("__part", "__of", (F.col("__first") - before).alias("__less"), F.sum("__rows").over(own).alias("n")))
    runs = F.broadcast(runs) if runs.count() <= OFFSET_ROWS else runs
    met = rows.join(runs, F.col(part).eqNullSafe(F.col("__part")) & (here == F.col("__of")))
    return met.select(*df.columns, (F.col("__at") - F.col("__less")).alias("rank"), "n")


def power_of_two(n: float, least: int = 1, most: int = 1 << 20) -> int:
    """The smallest power of two that is n or more, within limits."""
    k = least
    while k < n and k < most:
        k *= 2
    return k


def components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b; labels: what earlier links gave."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(labels, np.maximum(la, lb), low)
        while True:
            jump = labels[labels]
            if (jump == labels).all():
                break
            labels = jump
    return labels
