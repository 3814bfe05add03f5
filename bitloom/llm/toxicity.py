"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of abusive words (a fixed list, and words and word beginnings learned with
weights from labelled rows, as stems of abuse take many endings), the same after undoing obfuscation, the distance from a second-person pronoun to such a word, capitals, punctuation and
obfuscation rates. A bounded sample of labelled rows is dealt in three: words are learned on one part, the trees are fitted
on another, and the calibration on the third, which neither has seen; every document is scored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import bounded, cut, few_by_hash, prepare, text_of

#: Labelled rows that the model is fitted on, at most; which ones follows from a hash of the identifier.
SAMPLE_ROWS = 10_000
#: Bytes of all their texts, at most; the texts stay in tasks.
SAMPLE_BYTES = 256 << 20
#: Of six parts of the sample, those that words are learned on and those that trees are fitted on; the rest is for calibration.
WORD_PARTS, TREE_PARTS = (0, 1, 2), (3, 4)
#: Learned beginnings: their lengths, the documents' words that have one at least, and the share of those in toxic documents.
STEM, LEARNED_ROWS, LEARNED_SHARE = (3, 8), 8, 0.6
#: Stands for the distance where a text lacks pronoun or abuse: farther than any text is long.
NOWHERE = 1e12
TREES, DEPTH, RATE, BINS, LEAF_ROWS = 60, 3, 0.2, 32, 5

# English words of abuse, pronouns of the second person in four languages, characters used in place of letters.
ABUSE = frozenset((
    "asshole", "bastard", "bitch", "bonehead", "clown", "coward", "creep", "crap", "cretin", "cunt", "degenerate", "despicable", "dimwit", "disgrace",
    "disgusting", "dumb", "dumbass", "dunce", "failure", "fool", "freak", "fucker", "fucking", "garbage", "gross", "halfwit", "hideous", "idiot",
    "idiotic", "ignorant", "imbecile", "jackass", "jerk", "lazy", "liar", "lunatic", "loser", "lowlife", "maggot", "moron", "moronic", "nitwit",
    "parasite", "pathetic", "pig", "psycho", "rat", "repulsive", "retard", "retarded", "rubbish", "scum", "scumbag", "shit", "slut", "stupid",
    "subhuman", "suck", "sucks", "swine", "trash", "trashy", "twit", "ugly", "useless", "vermin", "vile", "weakling", "whore", "worthless", "wretch",
))
SECOND_PERSON = frozenset((
    "you", "your", "yours", "yourself", "yourselves", "u", "ur", "ya", "thou", "thee", "dich", "dir", "du", "dein", "deine", "euch", "euer", "ihr", "ihnen", "sie", "te", "tu", "ti", "tus",
    "vos", "usted", "ustedes", "vosotros", "vous", "votre", "vos", "toi", "ton", "ta", "tes",
))
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})

FEATURES = 18
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:\w[ .\-_*]){3,}\w(?=\s|$)")


class Learned:
    """Weights of words and, ending in *, of word beginnings. heads: the first letters of all of them, a quick first test."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.heads = frozenset(w.rstrip("*")[: STEM[0]] for w in weights)

    def weight(self, word: str) -> float:
        """The largest weight that the word or a beginning of it has; 0 without one."""
        if word[: STEM[0]] not in self.heads:
            return 0.0
        get = self.weights.get
        return max(get(word, 0.0), *(get(word[:k] + "*", 0.0) for k in range(STEM[0], min(STEM[1], len(word)) + 1)), 0.0)


def features(text: str, learned: Learned) -> np.ndarray:
    """The FEATURES numbers of a whole text; all zero for an empty one."""
    out = np.zeros(FEATURES)
    n = len(text)
    if not n:
        return out
    low = text.lower()
    words = low.split()
    count = max(1, len(words))
    plain = [w.strip(".,;:!?\"'()[]{}<>#$%&*-_~|") for w in words]
    listed = [i for i, w in enumerate(plain) if w in ABUSE]
    heads = learned.heads
    weights = {i: x for i, w in enumerate(plain) if w[: STEM[0]] in heads and (x := learned.weight(w)) > 0}
    taught = list(weights)
    hidden = 0
    odd = 0
    for w in set(words):
        if w.isalpha():
            continue
        core = w.strip(".,;:?\"'()[]{}<>~")
        if not core or core.isalpha() or not any(c.isalpha() for c in core):
            continue
        odd += 1
        bare = core.translate(LOOKALIKE)
        joined = re.sub(r"[^\w]|_", "", core)
        for form in (bare, joined, re.sub(r"[^a-z]", "", bare), re.sub(r"(.)\1{2,}", r"\1", joined)):
            if (form in ABUSE or form in learned.weights) and core.strip("!#$%&*-_|") not in ABUSE and core.strip("!#$%&*-_|") not in learned.weights:
                hidden += 1
                break
    spaced = 0
    for m in _SPACED.finditer(low):
        form = re.sub(r"[^\w]|_", "", m.group())
        spaced += form in ABUSE or form in learned.weights
    hits = sorted({*listed, *taught})
    nearest = NOWHERE
    close = 0
    if hits:
        people = np.array([i for i, w in enumerate(plain) if w in SECOND_PERSON])
        if len(people):
            at = np.array(hits)
            gap = np.abs(people[np.clip(np.searchsorted(people, at), 0, len(people) - 1)] - at)
            gap = np.minimum(gap, np.abs(people[np.clip(np.searchsorted(people, at) - 1, 0, len(people) - 1)] - at))
            nearest, close = float(gap.min()), int((gap <= 5).sum())
    upper = sum(map(str.isupper, text.split()))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    letters = int(((raw >= 65) & (raw <= 90)).sum())
    marks = {c: text.count(c) for c in "!?*#$%"}
    out[:] = (
        len(listed),
        len(listed) / count,
        len(taught),
        len(taught) / count,
        len({plain[i] for i in hits}),
        hidden,
        hidden / count,
        spaced,
        nearest,
        close,
        letters / n,
        upper / count,
        marks["!"] / n,
        sum(marks.values()) / n,
        odd / count,
        math.log(count),
        max(weights.values(), default=0.0),
        sum(weights.values()) / count,
    )
    return out


@dataclass
class Trees:
    """Regression trees of one depth over binned features: split features and edges by level order, leaf values."""

    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = 2**DEPTH - 1
        for f, e, v in zip(self.feature, self.edge, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > e[node])
            out += v[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic gradient boosting with histogram splits; a node without a useful split sends all rows one way."""
    n = len(y)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [np.unique(np.r_[e, np.unique(x[:, f])[: BINS // 2]]) for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    features_, edges_, leaves = [], [], []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        f_of, e_of = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == at)
                best = (1e-6, 0, np.inf)
                if len(rows) >= 2 * LEAF_ROWS:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for f in range(x.shape[1]):
                        b = binned[rows, f]
                        gl, hl, cl = (np.cumsum(np.bincount(b, w, width))[: len(edges[f])] for w in (g[rows], h[rows], np.ones(len(rows))))
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        gain[(cl < LEAF_ROWS) | (len(rows) - cl < LEAF_ROWS)] = 0
                        if len(gain) and gain.max() > best[0]:
                            best = (float(gain.max()), f, float(edges[f][int(gain.argmax())]))
                f_of[at], e_of[at] = best[1], best[2]
                node[rows] = 2 * at + 1 + (x[rows, best[1]] > best[2])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        margin += value[leaf]
        features_.append(f_of)
        edges_.append(e_of)
        leaves.append(value)
    return Trees(np.array(features_), np.array(edges_), np.array(leaves), base)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the rising step function from margins to shares of ones, as knots for linear interpolation."""
    order = np.argsort(margin, kind="stable")
    at, inverse = np.unique(margin[order], return_inverse=True)
    total, ones = np.bincount(inverse).astype(float), np.bincount(inverse, y[order])
    blocks: list[list[float]] = []  # first, last, ones, rows
    for m, k, n in zip(at, ones, total, strict=True):
        blocks.append([m, m, k, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    knots = [(b[i], (b[2] + 0.05) / (b[3] + 0.1)) for b in blocks for i in ((0, 1) if b[0] < b[1] else (0,))]
    return np.array([k[0] for k in knots]), np.maximum.accumulate(np.array([k[1] for k in knots]))


@dataclass
class Model:
    """What scoring needs; small enough to travel with each task."""

    learned: Learned
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


def _unlearned() -> Model:
    """Without labelled rows of both kinds: any listed word makes 0.5 and more."""
    inner = 2**DEPTH - 1
    edge = np.full((1, inner), 0.5)
    return Model(Learned({}), Trees(np.zeros((1, inner), dtype=np.int64), edge, np.where(np.arange(2**DEPTH)[None] == 0, -1.0, 1.0), 0.0), (np.array([-1.0, 1.0]), np.array([0.1, 0.9])))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, allowed: Column | None = None) -> DataFrame:
    """(part, text, label): at most so many labelled rows, each in one of six parts by its id, those with the smallest hashes of their id; a null label or id is none.

    The ids, bounded by ``rows``, are broadcast to the documents. An id that repeats gives its label's largest value and all its texts; fit() bounds those.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if allowed is not None:
        some = some.where(allowed)
    each = some.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("double")).alias("__label"))
    chosen = cut(few_by_hash(each, "__id", rows))
    return docs.select(docs[id_col].alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "__id").select(F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(6)).alias("part"), "text", F.col("__label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, allowed: Column | None = None) -> Model:
    """Fit on at most ``rows`` texts of labelled rows, copies once, and SAMPLE_BYTES of them: words, trees and calibration each on a part of their own, so that each is honest evidence for the next."""
    prepare(docs.sparkSession)
    known = cut(sample(docs, labels, id_col, text_col, label_col, rows, allowed).groupBy("text").agg(F.min("part").alias("part"), F.max("label").alias("label")))
    known = cut(bounded(known, rows, SAMPLE_BYTES))
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    by_word = known.where(F.col("part").isin(*WORD_PARTS)).select("label", word).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic"))
    stems = F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.length("word"))), lambda k: F.concat(F.substring(F.col("word"), F.lit(1), k), F.lit("*")))
    forms = F.concat(F.array("word"), F.when(F.length("word") >= STEM[0], stems).otherwise(F.array().cast("array<string>")))
    by_form = by_word.select(F.explode(forms).alias("form"), "n", "toxic").groupBy("form").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    found = by_form.where((F.col("n") >= LEARNED_ROWS) & (F.col("toxic") >= LEARNED_SHARE * F.col("n")))  # forms that few of ``rows`` texts can have
    learned = Learned({r["form"]: float(np.log((r["toxic"] + 0.5) / (r["n"] - r["toxic"] + 0.5))) for r in found.collect()})

    @F.pandas_udf("array<double>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, learned) for t in texts])

    got = known.where(~F.col("part").isin(*WORD_PARTS)).select(F.col("part").isin(*TREE_PARTS).alias("tree"), "label", numbers("text").alias("x")).toPandas()  # FEATURES numbers for each of at most ``rows`` rows
    tree, rest = got[got["tree"]], got[~got["tree"]]
    if tree["label"].nunique() < 2:
        return _unlearned()

    def sides(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.stack(part["x"].to_numpy()), part["label"].to_numpy().astype(float)
        order = np.lexsort((*x.T, y))  # the same fit in whatever order the rows come
        return x[order], y[order]

    trees = fit_trees(*sides(tree))
    if rest["label"].nunique() < 2:
        return Model(learned, trees, (np.array([-1.0, 0.0, 1.0]), np.array([0.25, 0.5, 0.75])))  # too few rows to calibrate on: the margin's sign decides
    x, y = sides(rest)
    return Model(learned, trees, isotonic(trees.margin(x), y))


def score_udf(model: Model):
    """A column function from text to the score."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.stack([features(t, model.learned) for t in texts])))

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per row of docs. A null text is empty, and an empty one has a score too. Equal texts have equal scores. Other columns are not read."""
    prepare(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), score_udf(model)(text_of(text_col)).alias("score"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, in docs' own columns; no shuffle. A null text counts as empty, rows alike fare alike, ids are not read, and an empty table gives an empty result."""
    prepare(docs.sparkSession)
    return docs.where(score_udf(model)(text_of(text_col)) < threshold)
