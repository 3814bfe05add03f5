"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field's nodes are a document's tokens that hold a digit or an at sign; any other token
can only be "none" and so cuts the chain, which makes leaving it out exact. Neighbouring nodes are linked in a chain,
and tokens that repeat, or agree in their last digits or in an address's first part, and pieces of one number that is
written in several, are linked however far apart they stand. Base spans are observed; loopy message passing gives every other node's marginals, so that a mention which the
patterns miss takes the label of its like elsewhere in the document. Weights are fitted by pseudo-likelihood.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import components, cut, few_by_hash, prepare, text_of

KINDS = ("email", "ip", "card", "phone")
#: Documents that the weights are fitted on, at most: of SURPLUS times as many with the smallest hashes of their id, those with a digit or an at sign.
SAMPLE_ROWS, SURPLUS = 2_000, 4
#: A document's messages go round until none changes by more than TOLERANCE. Loops may keep that from happening; then the last of ROUNDS counts.
ROUNDS, TOLERANCE, DAMPING, THRESHOLD = 1_000, 1e-6, 0.3, 0.5
FIT_STEPS, FIT_RATE, DECAY, SEED = 300, 0.5, 1e-3, 5
#: Where the weight of likeness starts and is drawn to: tokens that are the same are of one kind unless the data say otherwise.
LIKENESS = 3.0

# The patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EVIDENCE = re.compile(r"[0-9@]\S*")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """Leftmost spans without overlap of each kind, by kind, then start. Linear in the text's length."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in four):
                out.append((1, at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass
class Graph:
    """Nodes of some documents: places, features, observed labels (-1: none), chain links and skip links."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


FEATURES = 17


def _features(token: str) -> list[float]:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    at = token.find("@")
    return [
        1.0,
        at >= 0,
        at > 0 and "." in token[at:],
        digits <= 2,
        3 <= digits <= 4,
        5 <= digits <= 6,
        7 <= digits <= 8,
        9 <= digits <= 12,
        13 <= digits <= 19,
        digits > 19,
        token.count(".") == 3 and not letters,
        token.startswith("+"),
        "(" in token or ")" in token,
        "-" in token[1:-1],
        letters > 0,
        letters > 2 and digits > 8,
        letters > digits,
    ]


def _keys(token: str) -> list[str]:
    """What a token must share with another for a skip link."""
    digits = "".join(c for c in token if c.isdigit())
    out = [f"={token.strip('.,;:!?')}"] if len(digits) > 2 or "@" in token else []
    if "@" in token:
        name, _, host = token.strip(".,;:!?<>()").lower().partition("@")
        out.append(f"@{name}@{host.split('.')[0]}")
    elif len(digits) > 6:
        out.append(f"#{digits[-7:]}")
    elif len(digits) > 3:
        out.append(f"#{digits}")
    return out


def _number_keys(tokens: list[str]) -> list[str | None]:
    """For neighbouring tokens, keys by which a number that is written in pieces meets its like.

    A run of tokens without letters that no closing mark ends is one number; where it has seven digits and more, each of its
    pieces has the number's last seven digits and how many digits come after the piece.
    """
    out: list[str | None] = []
    run: list[str] = []

    def close() -> None:
        digits = ["".join(c for c in t if c.isdigit()) for t in run]
        whole, after = "".join(digits), 0
        keys: list[str | None] = []
        for d in reversed(digits):
            keys.append(f"~{whole[-7:]}:{after}" if len(run) > 1 and d and len(whole) > 6 else None)
            after += len(d)
        out.extend(reversed(keys))
        run.clear()

    for t in tokens:
        if any(c.isalpha() or c == "@" for c in t):
            close()
            out.append(None)
            continue
        run.append(t)
        if t[-1] in ".,;:!?":
            close()
    close()
    return out


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    doc, start, end, rows, observed, chain, skip = [], [], [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, spans, strict=True)):
        seen: dict[str, list[int]] = {}
        linked: set[tuple[int, int]] = set()
        tokens: list[str] = []
        free = 0
        first = len(doc)
        for m in _EVIDENCE.finditer(text):
            if m.start() < free:
                continue
            a = m.start()
            while a > free and not text[a - 1].isspace():
                a -= 1
            free = b = m.end()
            token = text[a:b]
            i = len(doc)
            doc.append(d)
            start.append(a)
            end.append(b)
            rows.append(_features(token))
            observed.append(-1)
            if i > first and not text[end[i - 1] : a].strip():
                linked.add((i - 1, i))
            tokens.append(token)
        cuts = [first, *(i for i in range(first + 1, len(doc)) if (i - 1, i) not in linked), len(doc)]
        pieces = [k for x, y in zip(cuts, cuts[1:], strict=False) for k in _number_keys(tokens[x - first : y - first])]
        for i, token, piece in zip(range(first, len(doc)), tokens, pieces, strict=True):
            for key in [*_keys(token), *([piece] if piece else [])]:
                like = seen.setdefault(key, [])
                if like:  # to the first and to the last: linear, and no two are more than two steps apart
                    skip.extend({(like[0], i), (like[-1], i)})
                    like[1:] = [i]
                else:
                    like.append(i)
        chain.extend(linked)
        if base and len(doc) > first:
            lows = np.array(start[first:])
            for kind, a, b in base:
                k = first + max(0, int(np.searchsorted(lows, a, side="right")) - 1)
                while k < len(doc) and start[k] < b:
                    if end[k] > a:
                        observed[k] = kind + 1
                    k += 1
    as_pairs = lambda x: np.array(sorted(set(x)), dtype=np.int64).reshape(-1, 2)
    return Graph(*(np.array(x, dtype=np.int64) for x in (doc, start, end)), np.array(rows, dtype=float).reshape(-1, FEATURES), np.array(observed, dtype=np.int64), as_pairs(chain), as_pairs(skip))


@dataclass
class Field:
    """Weights: node features by label, chain transitions, and what two linked like tokens gain by a shared label."""

    node: np.ndarray  # FEATURES, labels
    step: np.ndarray  # labels, labels
    same: np.ndarray  # labels

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product, damped, until it rests; exact where links form no loops. Observed nodes are fixed."""
        n, k = len(g.doc), len(KINDS) + 1
        unary = g.features @ self.node
        fixed = g.observed >= 0
        unary[fixed] = -50.0
        unary[fixed, g.observed[fixed]] = 0.0
        pairs = np.concatenate([g.chain, g.skip])
        if not len(pairs):
            return _softmax(unary)
        potential = np.concatenate([np.broadcast_to(self.step, (len(g.chain), k, k)), np.broadcast_to(np.diag(self.same), (len(g.skip), k, k))])
        a, b = pairs[:, 0], pairs[:, 1]
        forth, back = np.zeros((len(pairs), k)), np.zeros((len(pairs), k))
        doc = g.doc[a]
        live = np.arange(len(pairs))  # links of documents whose messages still change: each document goes on as if it were alone
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, b[live], forth[live])
            np.add.at(belief, a[live], back[live])
            at, to = a[live], b[live]
            new_forth = _logsum(potential[live] + (belief[at] - back[live])[:, :, None], 1)
            new_back = _logsum(potential[live] + (belief[to] - forth[live])[:, None, :], 2)
            new_forth = DAMPING * forth[live] + (1 - DAMPING) * (new_forth - new_forth.max(axis=1, keepdims=True))
            new_back = DAMPING * back[live] + (1 - DAMPING) * (new_back - new_back.max(axis=1, keepdims=True))
            change = np.maximum(np.abs(new_forth - forth[live]).max(axis=1), np.abs(new_back - back[live]).max(axis=1))
            forth[live], back[live] = new_forth, new_back
            most = np.zeros(int(g.doc.max()) + 1)
            np.maximum.at(most, doc[live], change)
            live = live[most[doc[live]] > TOLERANCE]
            if not len(live):
                break
        belief = unary.copy()
        np.add.at(belief, b, forth)
        np.add.at(belief, a, back)
        return _softmax(belief)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str]) -> Field:
    """Pseudo-likelihood on the base spans' labels. In every other step a random half of the nodes hides all but its plainest features, so that links must tell."""
    k = len(KINDS) + 1
    g = graph(texts, [base_spans(t) for t in texts])
    field = Field(np.zeros((FEATURES, k)), np.zeros((k, k)), np.full(k, LIKENESS))
    field.node[0, 0] = 2.0
    n = len(g.doc)
    if not n:
        return field
    y = np.maximum(g.observed, 0)
    one = np.eye(k)[y]
    rng = np.random.default_rng(SEED)
    like = np.zeros((n, k))
    for a, b in ((0, 1), (1, 0)):
        np.add.at(like, g.skip[:, a], one[g.skip[:, b]])
    like = np.minimum(like, 2)
    weight = np.where(y > 0, 1.0, 0.5)[:, None] / n
    for step in range(FIT_STEPS):
        f = g.features
        if step % 2:
            f = f * np.where((rng.random(n) < 0.5)[:, None] & (np.arange(FEATURES) > 0)[None], 0.0, 1.0)
        z = f @ field.node + like * field.same
        np.add.at(z, g.chain[:, 1], field.step[y[g.chain[:, 0]]])
        np.add.at(z, g.chain[:, 0], field.step.T[y[g.chain[:, 1]]])
        error = (one - _softmax(z)) * weight
        turn = np.zeros((k, k))
        np.add.at(turn, y[g.chain[:, 0]], error[g.chain[:, 1]])
        back = np.zeros((k, k))
        np.add.at(back, y[g.chain[:, 1]], error[g.chain[:, 0]])
        rate = FIT_RATE * 20
        field.node += rate * (f.T @ error - DECAY * field.node)
        field.step += rate * (turn + back.T - DECAY * field.step)
        field.same += rate * ((like * error).sum(axis=0) - DECAY * (field.same - LIKENESS))
    field.same = np.maximum(field.same, 0)  # likeness never tells against a label
    return field


def _plausible(kind: int, mention: str) -> bool:
    """What any mention of a kind must have, whatever its neighbours say."""
    digits = sum(c.isdigit() for c in mention)
    if kind == 0:
        return "@" in mention.strip("@")
    if kind == 1:
        return len(re.findall(r"[0-9]+", mention)) == 4 and not any(c.isalpha() for c in mention)
    letters = any(c.isalpha() for c in mention)
    return not letters and (13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15)


def spans_of(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, both by kind, then start.

    A span is added where the field gives its tokens a kind and at least one of them is like, directly or in steps, a
    token of a base span of that kind. Added spans overlap no base span and not one another.
    """
    base = [base_spans(t) for t in texts]
    g = graph(texts, base)
    added: list[list[Span]] = [[] for _ in texts]
    likes = components(len(g.doc), g.skip[:, 0], g.skip[:, 1])
    anchors = set(zip(likes[g.observed > 0].tolist(), g.observed[g.observed > 0].tolist(), strict=True))
    if anchors:
        p = field.marginals(g)
        label = np.where((g.observed < 0) & (p[:, 1:].max(axis=1) >= THRESHOLD), p[:, 1:].argmax(axis=1) + 1, 0)
        chained = set(g.chain[:, 0].tolist())
        i = 0
        while i < len(label):
            if not label[i]:
                i += 1
                continue
            j = i
            while j in chained and label[j + 1] == label[i]:
                j += 1
            d = int(g.doc[i])
            a, b = int(g.start[i]), int(g.end[j])
            text, kind = texts[d], int(label[i]) - 1
            while a < b and not (text[a].isalnum() or text[a] in "+("):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if any((int(x), kind + 1) in anchors for x in likes[i : j + 1]) and _plausible(kind, text[a:b]) and not any(x < b and a < y for _, x, y in base[d]):
                added[d].append((kind, a, b))
            i = j + 1
    return [(x, sorted(x + y)) for x, y in zip(base, added, strict=True)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Field:
    """Fit on at most ``rows`` documents, copies once. Without any, likeness alone decides."""
    prepare(docs.sparkSession)
    # ids alone are ranked; the few chosen ones, bounded by SURPLUS * rows, are broadcast to the texts
    chosen = cut(few_by_hash(docs.select(docs[id_col].alias("id")).where("id is not null").distinct(), "id", SURPLUS * rows))
    some = docs.select(docs[id_col].alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id").where(F.col("text").rlike("[0-9@]"))
    got = some.groupBy("text").agg(F.min(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("h")).orderBy("h", "text").limit(rows).select("text")
    return train([r["text"] for r in got.toLocalIterator()])


def detect(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end, mention), in code points, end exclusive; one row per row of docs.

    A null text is empty and has no spans. Equal texts have equal spans. Other columns are not read.
    """
    prepare(docs.sparkSession)
    mention = "array<struct<kind:string,start:int,end:int,mention:string>>"

    @F.pandas_udf(f"base {mention}, spans {mention}")
    def found(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        values = texts.tolist()
        for i in range(0, len(values), 256):
            some = values[i : i + 256]
            for text, pair in zip(some, spans_of(some, field), strict=True):
                out.append(tuple([{"kind": KINDS[k], "start": a, "end": b, "mention": text[a:b]} for k, a, b in spans] for spans in pair))
        return pd.DataFrame(out, columns=["base", "spans"])

    return docs.select(docs[id_col].alias("doc_id"), found(text_of(text_col)).alias("f")).select("doc_id", "f.base", "f.spans")
