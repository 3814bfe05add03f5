"""Target-distribution importance resampling on hashed n-grams.

A batch of texts is joined into one string of bytes with a sentinel after each text; one regular expression pass finds all
words and sentinels of the batch. Where the words of each text end follows from the sentinels' places, searchsorted tells
each word's text, and n-grams whose first and last word lie in different texts are masked before bincount gives each text's
counts by bucket. Texts are read once: their counts are written, sparse, and both the corpus' counts and the texts' weights
come from them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import ascii_lower, cut, prepare, ranked, text_of

BUCKETS, GRAMS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Bytes and texts of a batch.
STRETCH, TEXTS = 1 << 20, 64
#: Words that a worker remembers the checksums of.
MEMORY_WORDS = 500_000

#: A word: digits, a-z (after lower-casing) and all that is not ASCII, as UTF-8 bytes; or the sentinel.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+|\x00")
COUNTS = "n_words long, n_features long, buckets binary, counts binary"


class Checksums(dict):
    """Words' checksums, worked out when first asked for; the sentinel is -1."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        value = self[word] = -1 if word == b"\0" else zlib.crc32(word)
        return value


_known = Checksums()


def bucket_counts(texts: list[str], buckets: int = BUCKETS, grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's number of words, and (texts, buckets) counts of its runs of 1 to ``grams`` words. texts: lower-cased."""
    # the sentinel is no word's byte, so one that is in a text may become a space
    joined = b"".join(part for t in texts for part in (t.encode("utf-8", "surrogatepass").replace(b"\0", b" "), b"\0"))
    found = WORD.findall(joined)
    sums = np.fromiter(map(_known.__getitem__, found), np.int64, len(found))
    stops = np.flatnonzero(sums < 0)
    ends = stops - np.arange(len(stops))  # words before the end of each text
    words = sums[sums >= 0]
    text_of_word = np.searchsorted(ends, np.arange(len(words)), side="right")
    counts = np.bincount(text_of_word * buckets + words % buckets, minlength=len(texts) * buckets)
    if grams > 1:
        plain = [w for w in found if w != b"\0"]
        run = words
        for k in range(1, grams):
            run = np.fromiter((zlib.crc32(w, zlib.crc32(b" ", int(c))) for w, c in zip(plain[k:], run[: max(0, len(words) - k)], strict=True)), np.int64, max(0, len(words) - k))
            first = text_of_word[: len(run)]
            whole = first == text_of_word[k:]
            counts += np.bincount(first[whole] * buckets + run[whole] % buckets, minlength=len(counts))
    return np.diff(ends, prepend=0), counts.reshape(len(texts), buckets)


def _counts_udf(buckets: int, grams: int):
    @F.pandas_udf(COUNTS)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held, size = [], [], 0
            texts = batch.tolist()
            for i, text in enumerate(texts):
                held.append(text)
                size += len(text)
                if size >= STRETCH or len(held) == TEXTS or i + 1 == len(texts):
                    words, table = bucket_counts(held, buckets, grams)
                    for n, row in zip(words.tolist(), table, strict=True):
                        used = np.flatnonzero(row)
                        out.append((n, int(row.sum()), used.astype("<u4").tobytes(), row[used].astype("<u4").tobytes()))
                    held, size = [], 0
            yield pd.DataFrame(out, columns=["n_words", "n_features", "buckets", "counts"])

    return count


def counted(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """texts without its text, with n_words, n_features and the sparse counts (buckets, counts)."""
    prepare(texts.sparkSession)
    rest = [texts[c] for c in texts.columns if c != text_col]
    made = _counts_udf(buckets, grams)(ascii_lower(text_of(text_col)))
    return texts.select(*rest, made.alias("__made")).select(*(c for c in texts.columns if c != text_col), "__made.*")


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sums of sparse counts by bucket: one dense row per task, then one row per bucket."""

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b, c in zip(batch["buckets"], batch["counts"], strict=True):
                total[np.frombuffer(b, "<u4")] += np.frombuffer(c, "<u4")
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": used, "n": total[used]})

    out = np.zeros(buckets, dtype=np.int64)
    for r in counts.select("buckets", "counts").mapInPandas(dense, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log of how much likelier it is in the target than in the source, rounded down; one is added to every count."""
    buckets = len(source)
    s, t = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """counts with weight, the sum of the gains of each row's features, in place of the sparse counts. gain: one number per bucket, sent to the tasks."""
    shared = counts.sparkSession.sparkContext.broadcast(gain)

    @F.pandas_udf("long")
    def weight(buckets: pd.Series, n: pd.Series) -> pd.Series:
        g = shared.value
        return pd.Series([int(g[np.frombuffer(b, "<u4")] @ np.frombuffer(c, "<u4").astype(np.int64)) for b, c in zip(buckets, n, strict=True)], dtype="int64")

    return counts.withColumn("weight", weight("buckets", "counts")).drop("buckets", "counts")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    grams: int = GRAMS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): every row of docs; rank counts from 1 in the draw and is null for rows that are not drawn.

    A draw without replacement by Gumbel noise from a hash of the seed and the identifier: the highest scores of texts with
    ``least_words`` or more, as many as ``percent`` of these, rounded down; ties go to the smaller identifier (null ones first), then
    to the row with fewer features. Rows that repeat an identifier have the same noise; rows that are the same may change places.
    A null text is empty; a text without words has weight 0. An empty docs gives an empty result, an empty target gains that
    follow from docs alone. Other columns are not read.
    """
    known = cut(counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", buckets, grams))
    aim = counted(target.select(F.col(target_text_col).alias("text")), "text", buckets, grams)
    rows = weighed(known, gains(totals(known, buckets), totals(aim, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = rows.withColumn("score", F.col("weight") + noise)
    placed = ranked(scored.select((F.col("n_words") >= least_words).alias("__fit"), "doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("__row")), "__fit", [F.desc("score"), "doc_id", "n_features", "__row"])
    drawn = F.col("__fit") & (F.col("rank") < F.floor(F.col("n") * percent / 100))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank") + 1).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of docs, in docs' own columns; of rows that repeat an identifier all, where one of them is drawn. Rows without an identifier are not drawn, as nothing can name them."""
    chosen = resample(docs, target, id_col, **options).where("rank is not null and doc_id is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(chosen, docs[id_col] == chosen["__drawn"], "left_semi")
