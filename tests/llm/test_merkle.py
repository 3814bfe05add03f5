"""Manifests against plain trees."""

import hashlib
import random

import pytest

from bitloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, digest string, rank int, n int, level int, __row string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def climb(leaves):
    """The root and each leaf's steps (left, right)."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for s, i in zip(steps, at, strict=True):
            s.append((level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else ""))
        level, at = [h("".join(level[k : k + 2])) for k in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], steps


def plain(rows):
    """(doc_id, leaf, subroot, root, proof) of every row."""
    parts = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r["doc_id"]))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = [(sorted(parts[p], key=lambda x: x[:3]),) for p in order]
    climbed = [climb([x[2] for x in t]) for (t,) in trees]
    root, above = climb([c[0] for c in climbed])
    out = []
    for (t,), (sub, steps), more in zip(trees, climbed, above, strict=True):
        out += [(x[3], x[2], sub, root, h("".join(a + b for a, b in s + more))) for x, s in zip(t, steps, strict=True)]
    return out


def got_of(frame):
    m = merkle.manifest(frame, carry={"of": merkle.F.col("doc_id")})
    p = merkle.prove(m)
    own = merkle.hex_of(p["digest"])
    rows = p.select("of", own, "subroot", "root", merkle.digest(merkle.proof_text(p["path"])), merkle.fold(own, p["path"]).alias("folded")).collect()
    assert all(r["folded"] == r["root"] for r in rows)
    return m, [tuple(r)[:5] for r in rows]


@pytest.mark.parametrize("band", [1, 3, 6])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, band):
    monkeypatch.setattr(merkle, "BAND", band)
    r = random.Random(band)
    sizes = {None: 1, "": 2, "en": 23, "é": 8, "z": 9, "Z": 3, "long": 1}
    made = [(r.choice([None, r.randint(-5, 2**62)]), r.choice(["", None, "é" * 9, "x"]), lang, r.choice([None, "s"]), r.choice([None, 7]), "p", "d", 1, 2, 3, "r") for lang, k in sizes.items() for _ in range(k)]
    made += made[-5:-2] * 2
    r.shuffle(made)
    frame = spark.createDataFrame(made, SCHEMA)
    m, got = got_of(frame)
    want = plain([dict(zip(SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), x, strict=True)) for x in made])
    assert sorted(got, key=repr) == sorted(want, key=repr) and m.root() == want[0][3]
    spans = m.nodes.select("part", "n", "level", "lo", "hi").collect()
    assert all(0 <= s["lo"] <= s["hi"] < s["n"] for s in spans) and len(set(spans)) == len(spans)


def test_many_parts_one_row_and_no_rows(spark):
    many = spark.range(150).selectExpr("id as doc_id", "'t' as text", "concat('l', id) as lang", "'s' as source", "id as n_chars")
    _, got = got_of(many)
    assert sorted(got) == sorted(plain([x.asDict() for x in many.collect()]))
    _, got = got_of(many.limit(1))
    leaf = plain_leaf(many.first().asDict())
    assert got == [(0, leaf, leaf, leaf, h(""))]
    m, got = got_of(spark.createDataFrame([], SCHEMA))
    assert got == [] and m.root() is None
