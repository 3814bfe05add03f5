"""Importance resampling against plain counts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bitloom.llm import resample

SCHEMA = "doc_id long, text string, rank long, n long, weight string, __row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def runs(text, grams):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)]


def bucket(run, buckets):
    return zlib.crc32(run.encode()) % buckets


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_counts_do_not_cross_texts(grams):
    texts = ["", "one", "two words", "a\0b \0", "ÉCOLE école", "x" * 5000, "1 2 3 4 five-six", "\0\0", "end"]
    words, table = resample.bucket_counts([t.translate(LOWER) for t in texts], 97, grams)
    assert words.tolist() == [len(words_of(t)) for t in texts]
    for t, row in zip(texts, table, strict=True):
        want = Counter(bucket(r, 97) for r in runs(t, grams))
        assert {int(b): int(row[b]) for b in np.flatnonzero(row)} == want


def plain(rows, target, buckets, grams, least, percent):
    count = lambda texts: Counter(bucket(r, buckets) for t in texts for r in runs(t, grams))
    s, t = count(x[1] for x in rows), count(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        f = runs(text, grams)
        u = (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[bucket(r, buckets)] for r in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("grams,buckets,percent", [(1, 10_000, 10), (2, 50, 60)])
def test_draw_equals_a_plain_version(spark, monkeypatch, grams, buckets, percent):
    monkeypatch.setattr(resample, "TEXTS", 3)
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["Alpha", "beta", "GAMMA", "délta", "42", "-", "x_y"]) for _ in range(r.randint(0, 40)))
    rows = [(i, text()) for i in range(60)] + [(None, None), (None, "one two three four five"), (7, ""), (2**60 + 1, text()), (2**60 + 3, "long " * 9000)]
    rows += [(90, "same again and again and again")] * 3
    target = [text() for _ in range(9)] + [None, ""]
    frame = spark.createDataFrame([(i, t, 1, 2, "w", "r") for i, t in rows], SCHEMA)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    options = {"buckets": buckets, "grams": grams, "least_words": 5, "percent": percent}
    got = resample.resample(frame, aim, **options)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, target, buckets, grams, 5, percent)
    drawn = resample.draw(frame, aim, **options)
    assert drawn.columns == frame.columns and {x["doc_id"] for x in drawn.collect()} == {x["doc_id"] for x in got.where("rank is not null and doc_id is not null").collect()}


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert resample.resample(frame, frame).count() == 0
    some = spark.createDataFrame([(1, "a b c " * 9, 1, 2, "w", "r")], SCHEMA)
    assert [tuple(r) for r in resample.resample(some, frame, percent=100).select("doc_id", "n_features", "rank").collect()] == [(1, 27, 1)]
