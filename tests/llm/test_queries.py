"""The registered queries against their SQL or a plain version, and the pipeline stage by stage."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from bitloom.llm import media_tiff, simhash
from bitloom.llm import queries as Q
from tests.helpers import connect, content
from tests.llm.test_operators import brute_components, brute_spans, check_packing


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.fixture(scope="module")
def docs(data):
    return pd.read_parquet(f"{data}/documents.parquet")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, data, duck, name):
    assert content(Q.queries()[name](spark, data).toPandas()) == content(duck.execute(Q.oracle_sql()[name]).df())


def test_op2_holds_the_base_spans(spark, data, docs):
    got = Q.op2_pii(spark, data).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        base = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in brute_spans(t)]
        r = got.loc[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in base) for k in ("email", "ip", "card", "phone")]


def plain_components(ids, texts):
    fps = [simhash.fingerprint(t or "") for t in texts]
    roots = brute_components(fps)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    return fps, [least[r] for r in roots]


def test_op4_equals_brute_force(spark, data, docs):
    fps, groups = plain_components(docs["doc_id"].tolist(), docs["text"].tolist())
    want = {(i, f"{f % 2**64:016x}", c) for i, f, c in zip(docs["doc_id"].tolist(), fps, groups, strict=True)}
    assert {tuple(r) for r in Q.op4_simhash(spark, data).collect()} == want


def pieces_of(frame):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.vocabulary_path())
    out = Counter()
    for i, t in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.update((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048))
    return out


def test_op6_packs_every_token(spark, data, docs):
    got = Q.op6_packing(spark, data).toPandas()
    assert Counter(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == pieces_of(docs)
    check_packing(got, 2048)
    assert got["sequence_id"].nunique() <= 1.01 * got["length"].sum() / 2048 + 3


def test_op7_reads_back_what_it_stored(spark, data, docs):
    got = Q.op7_tiff(spark, data).toPandas().set_index("doc_id")
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got.loc[i]
        file = media_tiff.write_tiff(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest()) and "entropy=" in r["feature"]


@pytest.mark.parametrize("name,label,fold,rest,threshold,least", [("op8_toxicity", "toxic", 5, 0, 0.5, 0.9), ("op9_quality", "quality", 4, 2, 0.7, 0.9)])
def test_classifiers_on_held_out_rows(spark, name, label, fold, rest, threshold, least):
    folder = "/root/testdata/sf0.01"
    got = Q.queries()[name](spark, folder).toPandas()
    assert len(got) == len(pd.read_parquet(f"{folder}/documents.parquet")) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % fold == rest for i in got["doc_id"]]).all()
    assert (got["predicted"] == (got["score"] >= threshold)).all()
    held = got[got["held_out"]].merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    assert (held["predicted"] == held[label]).mean() >= least


def test_pipeline_equals_a_plain_version(spark, data, duck, docs, tmp_path):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, data)
        if k < 4:
            assert out.columns == docs.columns.tolist(), name
        out.write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(frame.toPandas())
    scored = Q.op8_toxicity(spark, data).toPandas()
    assert set(kept[0]["doc_id"]) == set(scored["doc_id"][scored["predicted"] == 0])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = kept[0].assign(t=[(t or "").translate(lower) for t in kept[0]["text"]]).groupby("t")["doc_id"].max()
    assert sorted(kept[1]["doc_id"]) == sorted(best)
    ids = kept[1]["doc_id"].tolist()
    _, groups = plain_components(ids, kept[1]["text"].tolist())
    assert sorted(kept[2]["doc_id"]) == sorted(i for i, c in zip(ids, groups, strict=True) if i == c)
    c = connect(data)
    c.execute("DROP VIEW documents")
    c.register("documents", kept[2])
    want = {i: taken // size if size else 1 for i, size, taken in c.execute(f"SELECT doc_id, size, taken FROM ({Q.OP5_SQL})").fetchall()}
    assert Counter(kept[3]["doc_id"].tolist()) == Counter({i: int(n) for i, n in want.items() if n})
    assert Counter(map(tuple, kept[4][["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == pieces_of(kept[3])
    check_packing(kept[4], 2048)


def test_run_joins_the_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, `group` string, __kept string, finish double"


def test_stages_take_awkward_rows(spark, data):
    """Nulls in every column, empty texts, ties, repeated rows, no rows, and names that the operators use themselves."""
    rows = [
        (1, "one two three four", "en", "a", 3, "g", "k", 1.0), (2, "ONE two three four", "en", "a", 3, "g", "k", 1.0), (2, "ONE two three four", "en", "a", 3, "g", "k", 1.0), (3, None, None, None, None, None, None, None),
        (4, "", "en", "", 0, "", "", 0.0), (None, "without an id", None, "a", None, None, None, None), (None, None, None, None, None, None, None, None), (5, "five six seven eight nine ten " * 2000, "en", "b", 1, "g", "k", 2.0),
    ]
    for table in (rows, []):
        frame = spark.createDataFrame(table, AWKWARD)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, data)
            got = out.collect()
            if name != "packing":
                assert out.columns == frame.columns, name
                assert {r["doc_id"] for r in got} <= {r[0] for r in table}, name
            assert bool(got) == bool(table), name
    deduplicated = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, spark.createDataFrame(rows, AWKWARD), data)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in deduplicated.collect() if r["doc_id"] != 5) == [("2", "ONE two three four"), ("4", ""), ("None", ""), ("None", "without an id")]
