"""Packing tokenized documents into sequences of fixed length by the sum-of-squares rule.

Only documents longer than a sequence are cut. Full pieces are sequences of their own. The rest are dealt by a hash into
groups of about ``GROUP_PIECES``, as many as the input needs; a group that rows of one id make much larger is dealt anew by
row. Each group is packed in one task: a piece goes where
the sum over gaps of (open sequences with that gap) squared becomes smallest. Larger pieces come first, and a sequence is
opened only where no gap is wide enough: measured on several size distributions, that never needs more sequences than
opening one whenever the sum of squares would be smaller, and often far fewer.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import cut, prepare, text_of

CAPACITY = 2048
GROUP_PIECES = 16_384
#: What a worker remembers: words, and runs of letters or marks.
MEMORY_WORDS, MEMORY_UNITS = 100_000, 250_000
#: Characters of texts whose words are told apart in one go.
STRETCH = 1_000_000
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long,ids:binary>>"


def _byte_characters() -> dict[int, str]:
    """The usual byte-level alphabet: printable Latin-1 characters stand for their own bytes, further ones for the rest."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordTokens:
    """A tokenizer's ids for many texts at once: each different word of a stretch of texts is looked up once.

    For a byte-level tokenizer whose tokens never span white space, that lower-cases, and that takes a run of letters and a
    run of marks as units: units go to its model. Texts outside Latin-1 and texts with marks of special tokens go to the
    tokenizer whole, words of other than letters and closing marks one by one. Whether a vocabulary is of that kind is
    tried out when it is loaded; texts of any other go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_characters()
        self.units: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.by_words = self._tried()

    def _tried(self) -> bool:
        """Whether words give what the tokenizer gives, on every Latin-1 character alone and beside letters, digits and marks."""
        probes = [f"{c} a{c} {c}b x{c}y. {c}{c} 1{c} {c}- A{c}B" for c in map(chr, range(256))] + ["don't WE'LL it's 12ab ab12 a1b. ..a.. (x) e-mail x_y", ""]
        try:
            return self._by_words(probes) == [self._whole(p) for p in probes]
        except Exception:  # a model of another kind may refuse units in any way
            return False

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        form = unit if unit.isascii() else unit.encode("utf-8").decode("latin-1").translate(self.alphabet)
        ids = array("I", [t.id for t in self.model.tokenize(form)])
        if sys.byteorder == "big":
            ids.byteswap()
        made = ids.tobytes()
        if len(self.units) < MEMORY_UNITS:
            self.units[unit] = made
        return made

    def _word(self, word: str) -> bytes:
        stem = word.rstrip(_MARKS)
        if stem and not stem.isalpha():
            return self._whole(word)
        made = self.units.get(stem)
        made = self._unit(stem) if made is None else made
        if len(stem) < len(word):
            marks = self.units.get(word[len(stem) :])
            made += self._unit(word[len(stem) :]) if marks is None else marks
        return made

    def _by_words(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        ends = split.offsets.to_numpy()
        told = split.flatten().dictionary_encode()
        which = told.indices.to_numpy(zero_copy_only=False)
        ids, room = [], MEMORY_WORDS - len(self.words)
        for word in told.dictionary.to_numpy(zero_copy_only=False).tolist():
            made = self.words.get(word)
            if made is None:
                made = self._word(word)
                if room > 0:
                    self.words[word] = made
                    room -= 1
            ids.append(made)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        every, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        out: list[bytes] = []
        a = 0
        while a < len(texts):  # some texts at a time, which bounds what is spread out
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 18), side="right")) - 1)
            some = which[ends[a] : ends[b]]
            size = sizes[some]
            upto = np.cumsum(size)
            spread = every[np.repeat(first[some] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
            cuts = np.r_[0, upto][ends[a : b + 1] - ends[a]].tolist()
            out += [spread[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
            a = b
        return out

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        out: list[bytes | None] = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if self.by_words and "<|" not in text and (text.isascii() or _latin(text)):
                plain.append(i)
            else:
                out[i] = self._whole(text)
        for i, made in zip(plain, self._by_words([texts[i] for i in plain]) if plain else [], strict=True):
            out[i] = made
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_tokenizers: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One per worker process; tasks that reuse the worker reuse what it remembers."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def pieces_udf(path: str, capacity: int, end_id: int, keep_ids: bool):
    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tail = np.array([end_id], dtype="<u4").tobytes()
        tokens = tokens_of(path)

        def cut_up(texts: list[str]) -> list[list[dict]]:
            out = []
            for made in tokens.many(texts):
                raw = made + tail
                parts = [raw[a : a + 4 * capacity] for a in range(0, len(raw), 4 * capacity)]
                out.append([{"piece": k, "start": k * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p), "ids": p if keep_ids else None} for k, p in enumerate(parts)])
            return out

        held: list[str] = []
        size = 0
        for batch in batches:
            held += batch.tolist()
            size += int(batch.str.len().sum())
            if size >= STRETCH:
                yield pd.Series(cut_up(held))
                held, size = [], 0
        if held:
            yield pd.Series(cut_up(held))

    return pieces


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): the text's ids and end_id, cut into pieces of ``capacity``. A null text is empty: one piece of one id."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), pieces_udf(tokenizer, capacity, end_id, keep_ids)(text_of(text_col)).alias("pieces"))
    # there is always a piece; explode() would add a filter on the pieces, for which Spark makes them twice
    return rows.select("doc_id", F.explode_outer("pieces").alias("p")).select("doc_id", "p.*")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item. sizes: from 1 to capacity - 1, largest first."""
    n = len(sizes)
    gaps = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    at, offset = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    made = 0
    for i, s in enumerate(sizes.tolist()):
        fits = np.flatnonzero(gaps[s:capacity]) + s
        chosen = 0
        if len(fits):
            # how the sum changes when a gap of one width is filled, or turns into one of the rest's width
            change = 1 - 2 * gaps[fits] + np.where(fits > s, 2 * gaps[fits - s] + 1, 0)
            chosen = int(fits[np.argmin(change)])
        if chosen:
            b = open_bins[chosen].pop()
            gaps[chosen] -= 1
        else:
            b, chosen = made, capacity
            made += 1
        at[i], offset[i] = b, capacity - chosen
        if chosen > s:
            gaps[chosen - s] += 1
            open_bins[chosen - s].append(b)
    return at, offset


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length and any other columns but ids) with sequence_id and offset.

    Reruns agree but for rows that are the same in doc_id, piece and length, which may change places, and for groups that
    many rows of one doc_id and piece overfill, which are dealt by the rows' places. An empty table gives an empty result. Columns named sequence_id or offset are replaced; other columns may have any name that does not begin with two underscores.
    """
    rows = cut(rows.drop("sequence_id", "offset"))
    loose = F.col("length") < capacity
    n = rows.where(loose).count()
    groups = max(1, -(-n // GROUP_PIECES))
    by_id = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))
    full = rows.where(~loose).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    names = rows.columns

    def packed(part: pa.Table) -> pa.Table:
        # Arrow, as pandas would round identifiers beside a null
        part = part.take(pc.sort_indices(part, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        at, offset = sum_of_squares(part["length"].to_numpy(), capacity)
        sequence = (part["__group"].to_numpy() * GROUP_PIECES * 4 + at) * 2
        return part.select(names).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = rows.where(loose).withColumn("__group", by_id)
    # groups of over twice the size, which only shared ids make, are dealt by row into as many as they need, numbered after the others
    over, made = [], groups
    for g, m in dealt.groupBy("__group").agg(F.count("*").alias("__n")).where(F.col("__n") > 2 * GROUP_PIECES).orderBy("__group").collect():
        over.append((g, made, -(-m // GROUP_PIECES)))
        made += over[-1][2]
    if over:
        split = rows.sparkSession.createDataFrame(over, "__group long, __first long, __parts long")
        place = F.pmod(F.xxhash64("__row"), F.col("__parts"))
        dealt = dealt.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(split), "__group", "left").withColumn("__group", F.coalesce(F.col("__first") + place, "__group")).drop("__row", "__first", "__parts")
    schema = full.schema
    return full.unionByName(dealt.groupBy("__group").applyInArrow(packed, schema))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces and their places."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids=False).drop("ids"), capacity)
