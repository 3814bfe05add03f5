"""Quality scores by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks. Filters of WIDTH bytes, each with a learned weight for every byte
at every place, run over each chunk; each filter's largest response in the chunk is kept. The means, the largest and the
smallest of the chunks' responses go through one hidden layer to a single probability. All of a text is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import bounded, cut, few_by_hash, prepare, text_of

#: Labelled rows that the network is fitted on, at most; which ones follows from a hash of the identifier.
SAMPLE_ROWS = 4_000
#: Bytes of all their texts, at most.
SAMPLE_BYTES = 16 << 20
FILTERS, WIDTH, HIDDEN = 16, 5, 24
#: Bytes of a chunk and between the starts of chunks; both whole numbers of BLOCK.
BLOCK, CHUNK, STEP = 64, 512, 448
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 11
#: Bytes of texts that are gone through together, and what marks a place at which no filter may begin.
STRETCH, DEAD = 1 << 18, 512


@dataclass
class Network:
    table: np.ndarray  # WIDTH, 256, FILTERS
    bias: np.ndarray  # FILTERS
    w1: np.ndarray  # 3 * FILTERS, HIDDEN
    b1: np.ndarray
    w2: np.ndarray  # HIDDEN
    b2: float

    def peaks(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, FILTERS) largest responses in each BLOCK of places, and the place at which each arises. flat: bytes, and DEAD more where no filter may begin; a whole number of blocks."""
        first = np.concatenate([self.table[0], np.full((1, FILTERS), -np.inf, np.float32)])
        span = BLOCK * 256  # so many places at a time, which bounds memory
        r, one = (np.empty((min(span, len(flat)), FILTERS), np.float32) for _ in range(2))
        x = np.r_[flat, np.zeros(WIDTH - 1, flat.dtype)]
        out, at = [], []
        for a in range(0, len(flat), span):
            m = min(span, len(flat) - a)
            part = x[a : a + m + WIDTH - 1].astype(np.intp)
            np.take(first, np.where(part[:m] < DEAD, part[:m], 256), axis=0, out=r[:m], mode="clip")
            part %= DEAD
            for k in range(1, WIDTH):
                np.take(self.table[k], part[k : k + m], axis=0, out=one[:m], mode="clip")
                np.add(r[:m], one[:m], out=r[:m])
            blocks = r[:m].reshape(-1, BLOCK, FILTERS)
            place = blocks.argmax(axis=1)
            out.append(np.take_along_axis(blocks, place[:, None], axis=1)[:, 0])
            at.append(a + np.arange(len(blocks))[:, None] * BLOCK + place)
        return np.concatenate(out), np.concatenate(at)

    def chunked(self, raw: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts' bytes: (chunks, FILTERS) largest responses, the place at which each arises, each text's first chunk, and the bytes that places count."""
        size = np.array([max(len(x), WIDTH) for x in raw])
        room = -(-size // BLOCK)  # blocks that the bytes take; those in which a filter may begin may be one fewer
        begin = np.cumsum(room) - room
        count = -(-(size - WIDTH + 1) // BLOCK)
        flat = np.full(int(room.sum()) * BLOCK, DEAD, np.int16)
        for x, o, n in zip(raw, (begin * BLOCK).tolist(), size.tolist(), strict=True):
            flat[o : o + n] = 0
            flat[o : o + len(x)] = x
            flat[o + n - WIDTH + 1 : o + n] += DEAD
        blocks, places = self.peaks(flat)
        per, step = CHUNK // BLOCK, STEP // BLOCK
        some = -(-np.maximum(1, count - per + step) // step)
        first = np.cumsum(some) - some
        nth = np.arange(int(some.sum())) - np.repeat(first, some)
        # the last block again where a chunk is short
        held = np.minimum(nth[:, None] * step + np.arange(per), np.repeat(count - 1, some)[:, None]) + np.repeat(begin, some)[:, None]
        which = np.take_along_axis(held[:, :, None], blocks[held].argmax(axis=1)[:, None], axis=1)[:, 0]
        each = np.arange(FILTERS)
        return blocks[which, each] + self.bias, places[which, each], first, flat % DEAD

    def chunks(self, raw: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(chunks, FILTERS) largest responses of one text, and where asked the byte at which each arises."""
        top, at, _, _ = self.chunked([raw])
        return top, at if where else None

    @staticmethod
    def pooled(top: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's means, largest and smallest of its chunks' responses."""
        r = np.tanh(top).astype(np.float64)
        n = np.diff(np.r_[first, len(r)])[:, None]
        return np.concatenate([np.add.reduceat(r, first) / n, np.maximum.reduceat(r, first), np.minimum.reduceat(r, first)], axis=1)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        # einsum, as the same row gives the same number in every batch
        hidden = np.maximum(0, np.einsum("ij,jk->ik", pooled, self.w1) + self.b1)
        return 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", hidden, self.w2) + self.b2, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        out, held, size = [np.zeros(0)], [], 0
        for i, text in enumerate(texts):
            held.append(bytes_of(text))
            size += len(held[-1])
            if size >= STRETCH or i + 1 == len(texts):
                top, _, first, _ = self.chunked(held)
                out.append(self.probability(self.pooled(top, first)))
                held, size = [], 0
        return np.concatenate(out)


def bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def gradient(net: Network, raw: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """The gradient of the weighted mean log loss over some texts' bytes; a filter learns from the places of its largest responses."""
    top, at, first, flat = net.chunked(raw)
    pooled = net.pooled(top, first)
    before = pooled @ net.w1 + net.b1
    hidden = np.maximum(0, before)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))
    d = (p - labels) * weight / len(raw)
    dh = np.outer(d, net.w2) * (before > 0)
    dp = dh @ net.w1.T
    each = np.arange(FILTERS)
    r = np.tanh(top).astype(np.float64)
    ends = np.r_[first, len(r)]
    g = np.repeat(dp[:, :FILTERS] / np.diff(ends)[:, None], np.diff(ends), axis=0)
    for a, b, row in zip(ends[:-1].tolist(), ends[1:].tolist(), dp, strict=True):
        g[a + r[a:b].argmax(axis=0), each] += row[FILTERS : 2 * FILTERS]
        g[a + r[a:b].argmin(axis=0), each] += row[2 * FILTERS :]
    g *= 1 - r**2
    x = np.r_[flat, np.zeros(WIDTH - 1, flat.dtype)].astype(np.int64)
    table = np.stack([np.bincount((x[at + k] * FILTERS + each).ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS) for k in range(WIDTH)])
    return {"table": table, "bias": g.sum(axis=0), "w1": pooled.T @ dh, "b1": dh.sum(axis=0), "w2": hidden.T @ d, "b2": d.sum()}


def untrained(seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    return Network(
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.full(FILTERS, -1.0, np.float32),
        rng.normal(0, (2 / (3 * FILTERS)) ** 0.5, (3 * FILTERS, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN),
        0.0,
    )


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the log loss, all of each text."""
    net = untrained(seed)
    rng = np.random.default_rng(seed)
    raw = [bytes_of(t) for t in texts]
    names = ("table", "bias", "w1", "b1", "w2", "b2")
    first = {k: np.zeros_like(np.asarray(getattr(net, k), dtype=np.float64)) for k in names}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    share = float(labels.mean())
    weight = np.where(labels > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) ** 0.5
    t = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) ** 0.5
        for batch in np.array_split(rng.permutation(len(raw)), max(1, len(raw) // BATCH)):
            t += 1
            grad = gradient(net, [raw[i] for i in batch], labels[batch], weight[batch])
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                now = np.asarray(getattr(net, k))
                setattr(net, k, (now - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(now.dtype))
    net.b2 = float(net.b2)
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, allowed: Column | None = None) -> DataFrame:
    """(text, label): at most ``rows`` texts of labelled rows, copies once, and SAMPLE_BYTES of them; a null label or id is none.

    First the ids with the smallest hashes, which are broadcast, then the texts with the smallest hashes, as an id may have many texts.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if allowed is not None:
        some = some.where(allowed)
    each = some.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("double")).alias("__label"))
    chosen = cut(few_by_hash(each, "__id", rows))
    found = docs.select(docs[id_col].alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    return bounded(cut(found.groupBy("text").agg(F.max("__label").alias("label"))), rows, SAMPLE_BYTES)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, allowed: Column | None = None) -> Network | None:
    """Fit on at most ``rows`` labelled rows; None where they are not of both kinds."""
    prepare(docs.sparkSession)
    got = sorted((r["text"], r["label"]) for r in sample(docs, labels, id_col, text_col, label_col, rows, allowed).toLocalIterator())
    y = np.array([label for _, label in got], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    return train([text for text, _ in got], (y > 0).astype(float))


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per row of docs; 0.5 without a network. A null text is empty; an empty one has a score too. Equal texts have equal scores. Other columns are not read."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(np.full(len(texts), 0.5) if net is None else net.score(texts.tolist()), dtype="float64")

    return docs.select(docs[id_col].alias("doc_id"), scores(text_of(text_col)).alias("score"))
