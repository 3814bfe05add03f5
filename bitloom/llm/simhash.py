"""SimHash near-duplicate groups, found by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits form 32 segments of two bits. The embedding is the vector of the segments' bit counts; the
Manhattan distance of two vectors never exceeds the fingerprints' Hamming distance, so it is a lower bound. The vector
is kept in unary (0, 01, 11 per segment), which makes the Manhattan distance the number of differing bits of two longs.

Range join: the segments form ``max_bits + 3`` blocks. Two vectors within ``max_bits`` agree in at least three blocks,
so each choice of three blocks is one grid, and a grid's cell is what the vectors have there. Fingerprints meet in
cells; the Manhattan bound and then the exact Hamming distance decide. Rows per fingerprint are constant (20 for three
bits), and a task gives a spanning forest of a cell's links, never its pairs. A cell with more than ``CELL_ROWS``
fingerprints is dealt out as pairs of chunks over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import components, cut, prepare, stay, text_of

SEGMENTS = 32
#: Fingerprints of one cell that one task compares with one another.
CELL_ROWS = 4096
#: Links that are folded into labels at once.
FOLD = 1 << 20


def fingerprint(text: str, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed long; 0 for a text without words."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(s), 42) for s in zip(*(w[i:] for i in range(words)), strict=False)]
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        rows = np.array(hashes[i : i + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprint_udf(words: int = 3):
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return fingerprints


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in unary."""
    ones = F.lit(0x5555555555555555)
    other = F.shiftright(fp, 1)
    return fp.bitwiseOR(other).bitwiseAND(ones).bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(ones), 1))


def grids(max_bits: int) -> list[int]:
    """For each choice of three of max_bits + 3 blocks of segments, the mask of those blocks as a signed long."""
    blocks = np.array_split(np.arange(SEGMENTS), max_bits + 3)
    masks = [sum(3 << (2 * int(s)) for s in block) for block in blocks]
    chosen = [reduce(int.__or__, three) for three in combinations(masks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _cells(fps: DataFrame, max_bits: int) -> DataFrame:
    u = embedding(F.col("fp"))
    rows = F.array(*(F.struct(F.lit(i).alias("grid"), F.col("u").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(grids(max_bits))))
    return fps.select("fp", u.alias("u")).select("fp", "u", F.explode(rows).alias("c")).select("fp", "u", "c.grid", "c.cell")


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _linked(fp: np.ndarray, u: np.ndarray, run: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs."""
    n = len(fp)
    labels = np.arange(n)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    longest = int(np.bincount(run).max()) if n else 0
    for d in range(1, longest):
        i = np.flatnonzero(run[d:] == run[:-d])
        j = i + d
        near = _bits(u[i] ^ u[j]) <= max_bits  # Manhattan distance of the embeddings
        i, j = i[near], j[near]
        near = _bits(fp[i] ^ fp[j]) <= max_bits
        i, j = i[near], j[near]
        left.append(i)
        right.append(j)
        held += len(i)
        if held > FOLD:
            labels = components(n, np.concatenate(left), np.concatenate(right), labels)
            left, right, held = [], [], 0
    if left:
        labels = components(n, np.concatenate(left), np.concatenate(right), labels)
    to = np.flatnonzero(labels != np.arange(n))
    return fp[to], fp[labels[to]]


def _link_cells(keys: list[str], max_bits: int):
    """Rows sorted by keys to links (a, b); rows of a cell too large for one task come back with b null and their cell."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [*keys, "a", "b"]
        rest: pd.DataFrame | None = None
        over: tuple | None = None  # the cell that is being passed on

        def passed(rows: pd.DataFrame) -> pd.DataFrame:
            return rows[keys].assign(a=rows["fp"], b=None).astype({"b": "Int64"})[out]

        def solved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            if len(rows) < 2:
                return
            k = rows[keys].to_numpy()
            starts = np.r_[True, (k[1:] != k[:-1]).any(axis=1)]
            run = np.cumsum(starts) - 1
            size = np.bincount(run)[run]
            large = size > 2 * CELL_ROWS
            if large.any():
                yield passed(rows[large])
            some = (size > 1) & ~large
            a, b = _linked(rows["fp"].to_numpy()[some], rows["u"].to_numpy()[some], run[some], max_bits)
            if len(a):
                yield pd.DataFrame({**{c: 0 for c in keys}, "a": a, "b": b}).astype({"b": "Int64"})[out]

        for batch in batches:
            if over is not None:
                same = (batch[keys] == list(over)).all(axis=1).to_numpy()
                if same.any():
                    yield passed(batch[same])
                    batch = batch[~same]
                if len(batch):
                    over = None
                else:
                    continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            last = tuple(rows[keys].iloc[-1])
            open_ = (rows[keys] == list(last)).all(axis=1).to_numpy()
            yield from solved(rows[~open_])
            rest = rows[open_]
            if len(rest) > 2 * CELL_ROWS:
                yield passed(rest)
                rest, over = None, last
        if rest is not None and over is None:
            yield from solved(rest)

    return links


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) that connect all fingerprints of fps (fp, distinct) that are within max_bits of one another, as forests."""
    schema = lambda keys: ", ".join(f"{k} long" for k in keys) + ", a long, b long"
    first = ["grid", "cell"]
    cells = _cells(fps, max_bits).select(F.col("grid").cast("long").alias("grid"), "cell", "fp", "u")
    dealt = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell")
    found = cut(dealt.mapInPandas(_link_cells(first, max_bits), schema(first)))
    near = found.where("b is not null").select("a", "b")

    # cells beyond CELL_ROWS: each pair of chunks is a cell of its own, of two chunks at most
    over = found.where("b is null").select("grid", "cell", F.col("a").alias("fp"))
    chunks = over.groupBy("grid", "cell").agg(F.ceil(F.count("*") / F.lit(CELL_ROWS / 2)).cast("long").alias("n"))
    own = over.join(chunks, ["grid", "cell"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")))
    second = [*first, "low", "high"]
    pairs = (
        own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("grid", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", embedding(F.col("fp")).alias("u"))
        .repartition(*second)
        .sortWithinPartitions(*second)
    )
    far = pairs.mapInPandas(_link_cells(second, max_bits), schema(second)).where("b is not null").select("a", "b")
    return near.unionByName(far).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of edges (a, b), the smallest node it reaches. Large-star and small-star rounds, each cut off from the last."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest id that it reaches over links of max_bits or fewer.

    A null text is empty; a text without words has fingerprint 0, which links like any other. A text of fewer words than
    a shingle is one shingle. Rows that repeat an id each give a row, and the component takes all of them. A null id is
    never a component's id unless the component has no other. An empty table gives an empty result. Other columns of docs are not read.
    """
    prepare(docs.sparkSession)
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(words)(text_of(text_col)).alias("fp")))
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected(links(fps.select("fp"), max_bits))
    classes = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = classes.join(ids, "root").select(F.col("fp").alias("print"), "component_id")
    return prints.join(by_fp, F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the one with the smallest id, in docs' own columns.

    Of rows that repeat both id and text, one stays. Rows without an id stay: no decision can name them.
    """
    groups = near_duplicates(docs, id_col, text_col, words, max_bits)
    decisions = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("kept"))
    return stay(docs, decisions, id_col, text_col)
