"""Exact deduplication with a log-structured merge index over text digests.

Memtables: each task gathers digests in a table of bounded size and flushes it as a run: per bucket of the digest's
leading bits one segment with the digests in order, the kept identifiers, the counts and a Bloom filter.
Compaction: the segments of a bucket meet in one task, are merged in order and keep one identifier per digest (the
smallest, or the largest where asked). Copies are already one entry per run, so a text with a billion copies is as many
entries as there are runs. Buckets grow in number with the rows.
Each compacted segment has a filter over its digests of more than one row; memtables' runs need none, as no lookup meets
them before they are compacted.
Hits: rows that their bucket's filter lets through, and only those, carry their texts to the kept row's text, and bytes
decide. A row whose bytes agree takes its group's identifier and size from the index; only texts that share a digest
without being equal are grouped anew. A digest with very many rows is dealt in parts, each with its own copy of the kept text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import cut, power_of_two, prepare, stay, text_of

#: Digests that a memtable holds before it is flushed.
MEMTABLE_ROWS = 100_000
#: Digests that a bucket is meant to hold after compaction.
BUCKET_ROWS = 50_000
#: Bits of a segment's filter per digest, and hash functions.
FILTER_BITS, FILTER_HASHES = 10, 5
#: Bytes of all segments' filters that are sent to each executor, at most: enough for 26 million digests of more than one
#: row. Beyond that no filter is sent and all texts are verified, which costs a shuffle of them and changes no result.
FILTER_BYTES = 1 << 25
#: A digest is dealt in parts from so many rows on, or from this share of all rows if that is more, so that such digests stay few.
LARGE_ROWS, LARGE_SHARE, PARTS = 1_000, 1e-4, 5

SEGMENT = "bucket int, run string, n long, digests binary, ids binary, known binary, counts binary"
LEVEL = SEGMENT + ", bloom binary"


def digest(text: str, size: int = 32) -> bytes:
    """SHA-256 of the text in UTF-8 with A-Z in lower case, cut to size bytes."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass").lower()).digest()[:size]


def _digest_udf(size: int):
    @F.pandas_udf("binary")
    def digests(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(t, size) for t in texts], dtype=object)

    return digests


def _places(digests: np.ndarray, bits) -> np.ndarray:
    """The filter's bits for each digest (n, size bytes): double hashing over the digest's own bytes. bits: of one filter, or of each digest's own."""
    wide = np.zeros((len(digests), 32), dtype=np.uint8)
    wide[:, : digests.shape[1]] = digests
    a, b = wide[:, 8:16].copy().view(np.uint64)[:, 0], wide[:, 16:24].copy().view(np.uint64)[:, 0] | np.uint64(1)
    bits = np.asarray(bits, dtype=np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(k) * b) % bits for k in range(FILTER_HASHES)], axis=1)


def _bloom(digests: np.ndarray) -> bytes:
    """A filter of FILTER_BITS a digest, in whole bytes; empty without digests."""
    if not len(digests):
        return b""
    flags = np.zeros(len(digests) * FILTER_BITS + 7 & ~7, dtype=bool)
    flags[_places(digests, len(flags)).ravel()] = True
    return np.packbits(flags).tobytes()


class Filters:
    """The filters of all buckets, one after the other."""

    def __init__(self, blooms: list[bytes]) -> None:
        sizes = np.array([len(b) for b in blooms], dtype=np.uint64)
        self.bytes = np.frombuffer(b"".join(blooms) or b"\0", np.uint8)
        self.bits, self.first = sizes * np.uint64(8), np.cumsum(sizes) - sizes

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        at = _bucket(digests, len(self.bits))
        bits = self.bits[at]
        places = _places(digests, np.maximum(bits, np.uint64(8))) + (self.first[at] * np.uint64(8))[:, None]
        places[bits == 0] = 0
        found = (self.bytes[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8)) & 1
        return found.all(axis=1) & (bits > 0)


def _matrix(values, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, size)


def _bucket(digests: np.ndarray, buckets: int) -> np.ndarray:
    """The digest's leading 32 bits, scaled to the number of buckets (a power of two)."""
    wide = np.zeros((len(digests), 4), dtype=np.uint8)
    wide[:, : min(4, digests.shape[1])] = digests[:, :4]
    return (wide.copy().view(">u4")[:, 0].astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _merge(digests: np.ndarray, ids: np.ndarray, known: np.ndarray, counts: np.ndarray, largest: bool):
    """One entry per digest in the digests' order: the kept identifier (an unknown one gives way) and the sum of counts."""
    size = digests.shape[1]
    keys = np.ascontiguousarray(digests).view(f"V{size}")[:, 0] if size > 1 else digests[:, 0]
    order = np.lexsort((ids, known)) if largest else np.lexsort((~ids, known))
    order = order[np.argsort(keys[order], kind="stable")]
    keys = keys[order]
    last = np.r_[keys[1:] != keys[:-1], True] if len(keys) else np.zeros(0, dtype=bool)
    starts = np.r_[0, np.flatnonzero(last)[:-1] + 1] if len(keys) else np.zeros(0, dtype=np.int64)
    kept = order[last]
    total = np.add.reduceat(counts[order], starts) if len(keys) else counts[:0]
    return digests[kept], ids[kept], known[kept], total


def _flush(size: int, buckets: int, largest: bool, memtable_rows: int):
    """Rows (id, known, digest) to segments of sorted runs. No column has nulls, as pandas would turn an identifier beside one into a rounded number."""

    def flush(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def run() -> pd.DataFrame:
            d, i, k, n = _merge(*(np.concatenate(x) for x in zip(*held, strict=True)), largest)
            name, at, out = uuid.uuid4().hex, _bucket(d, buckets), []
            for b in np.unique(at):
                m = at == b
                out.append((int(b), name, int(m.sum()), d[m].tobytes(), i[m].tobytes(), k[m].tobytes(), n[m].tobytes()))
            return pd.DataFrame(out, columns=["bucket", "run", "n", "digests", "ids", "known", "counts"])

        for batch in batches:
            held.append((_matrix(batch["digest"], size), batch["id"].to_numpy(np.int64), batch["known"].to_numpy(np.int8), np.ones(len(batch), dtype=np.int64)))
            rows += len(batch)
            if rows >= memtable_rows:
                yield run()
                held, rows = [], 0
        if rows:
            yield run()

    return flush


def _compact(size: int, largest: bool):
    """Segments sorted by bucket to one segment per bucket, merged run by run."""

    def merged(parts: list) -> tuple:
        d, i, k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _merge(d, i, k, n, largest)

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, held = None, [], 0

        def level() -> pd.DataFrame:
            d, i, k, n = merged(parts)
            return pd.DataFrame([(at, "compacted", len(d), d.tobytes(), i.tobytes(), k.tobytes(), n.tobytes(), _bloom(d[n > 1]))], columns=["bucket", "run", "n", "digests", "ids", "known", "counts", "bloom"])

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.bucket != at:
                    if parts:
                        yield level()
                    at, parts, held = row.bucket, [], 0
                parts.append((_matrix([row.digests], size), np.frombuffer(row.ids, np.int64), np.frombuffer(row.known, np.int8), np.frombuffer(row.counts, np.int64)))
                held += row.n
                if len(parts) > 1 and held > 4 * BUCKET_ROWS:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
        if parts:
            yield level()

    return compact


def build_index(digests: DataFrame, size: int = 32, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """The compacted index over digests (doc_id, digest): one row per bucket, with sorted digests, identifiers, counts and a filter over those of more than one row."""
    buckets = power_of_two(digests.count() / BUCKET_ROWS)
    told = digests.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNotNull().cast("byte").alias("known"), "digest")
    runs = told.mapInPandas(_flush(size, buckets, keep == "largest", memtable_rows), SEGMENT)
    dealt = runs.repartition(buckets, "bucket") if buckets > 1 else runs.repartition("bucket")
    return cut(dealt.sortWithinPartitions("bucket", "run").mapInPandas(_compact(size, keep == "largest"), LEVEL))


def lookup(index: DataFrame, digests: DataFrame, size: int = 32) -> DataFrame:
    """digests (digest and any other columns) with keep_id and group_size from the index; null where the index lacks the digest."""
    return digests.join(entries(index, size), "digest", "left")


def entries(index: DataFrame, size: int = 32, least: int = 1) -> DataFrame:
    """(digest, keep_id, group_size): the index's entries with at least so many rows."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                d, n = _matrix([row.digests], size), np.frombuffer(row.counts, np.int64)
                ids, known = np.frombuffer(row.ids, np.int64), np.frombuffer(row.known, np.int8)
                m = n >= least
                if m.any():
                    keep = pd.array(ids[m], dtype="Int64")
                    keep[known[m] == 0] = pd.NA
                    yield pd.DataFrame({"digest": [x.tobytes() for x in d[m]], "keep_id": keep, "group_size": n[m]})

    return index.mapInPandas(unpack, "digest binary, keep_id long, group_size long")


def filters(index: DataFrame, buckets: int) -> Filters | None:
    """The filters of the index's buckets; None where they are more than FILTER_BYTES."""
    if (index.agg(F.sum(F.octet_length("bloom"))).first()[0] or 0) > FILTER_BYTES:
        return None
    blooms = [b""] * buckets
    for row in index.where("octet_length(bloom) > 0").select("bucket", "bloom").toLocalIterator():
        blooms[row["bucket"]] = bytes(row["bloom"])
    return Filters(blooms)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", size: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): one row per row of docs.

    Texts are equal when identical after lower-casing A-Z; a null text is empty, and empty texts equal one another.
    keep: "smallest" or "largest", the identifier that stays in a group; a null identifier stays only in a group that
    has no other. Rows that repeat the kept identifier are all marked as kept. Bytes decide, not digests: texts that
    share a digest without being equal form groups of their own. An empty table gives an empty result. Other columns are not read.
    Identifiers are whole numbers of up to 64 bits (or text that says one; other text is an error, as Spark's cast has it).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    prepare(spark)
    best = F.max if keep == "largest" else F.min
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    digests = cut(texts.select("doc_id", _digest_udf(size)("text").alias("digest")))
    n = digests.count()
    index = build_index(digests, size, keep, memtable_rows)
    known = filters(index, power_of_two(n / BUCKET_ROWS))
    shared = spark.sparkContext.broadcast(known)

    def hits_of(values: list[bytes]) -> np.ndarray:
        if not values or shared.value is None:
            return np.ones(len(values), dtype=bool)
        return shared.value.may_hold(_matrix(values, size))

    @F.pandas_udf("boolean")
    def hit(values: pd.Series) -> pd.Series:
        return pd.Series(hits_of(values.tolist()), dtype=bool)

    @F.pandas_udf("digest binary, text string")
    def hit_text(values: pd.Series) -> pd.DataFrame:
        d = [digest(t, size) for t in values]
        m = hits_of(d)
        return pd.DataFrame({"digest": [x if y else None for x, y in zip(d, m, strict=True)], "text": [t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if y else None for t, y in zip(values, m, strict=True)]})

    hit_text = hit_text.asNondeterministic()  # else the filter on its digest would work it out once more
    alone = digests.where(~hit("digest")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")

    hits = cut(texts.select("doc_id", hit_text("text").alias("h")).where("h.digest is not null").select("doc_id", "h.digest", "h.text"))
    known_groups = cut(entries(index, size, 2))
    # the kept rows' texts, met on digest and identifier, of which no pair is frequent but for repeated or missing identifiers
    own = hits.join(known_groups.withColumnRenamed("digest", "__digest"), (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    models = own.groupBy("digest", "keep_id", "group_size").agg(F.min("text").alias("model"))
    # digests of very many rows, of which there are 1 / LARGE_SHARE at most, in parts
    large = max(LARGE_ROWS, int(n * LARGE_SHARE))
    heavy = known_groups.where(F.col("group_size") > large).select("digest", F.ceil(F.col("group_size") * PARTS / large).alias("parts"))
    heavy = spark.createDataFrame(heavy.collect(), "digest binary, parts long")
    dealt = hits.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(heavy), "digest", "left").withColumn("part", F.pmod(F.xxhash64("__row"), F.coalesce("parts", F.lit(1)))).drop("__row", "parts")
    copies = models.join(F.broadcast(heavy), "digest", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    agrees = F.coalesce(F.col("text") == F.col("model"), F.lit(False))
    checked = cut(dealt.join(copies, ["digest", "part"], "left").select("doc_id", "digest", "keep_id", "group_size", F.col("model").isNotNull().alias("shared"), agrees.alias("agrees"), F.when(F.col("model").isNotNull() & ~agrees, F.col("text")).alias("other")))
    # a hit without a kept text was the filter's error
    single = checked.where("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    same = checked.where("agrees").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    differ = checked.where("shared and not agrees")
    if differ.isEmpty():
        return alone.unionByName(single).unionByName(same)
    # texts that only share a digest: groups of their own, and not counted with the kept row's
    strangers = differ.groupBy("digest").agg(F.count("*").alias("strangers"))
    same = same.join(strangers, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("strangers", F.lit(0))).drop("strangers")
    others = differ.groupBy("digest", "other").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    own_groups = differ.select("doc_id", "digest", "other").join(others, ["digest", "other"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
    return alone.unionByName(single).unionByName(same).unionByName(own_groups)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, one for each text, in docs' own columns. Rows without an id stay: no decision can name them."""
    decisions = exact_groups(docs, id_col, text_col, keep).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return stay(docs, decisions, id_col, text_col)
