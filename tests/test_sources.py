"""Files in and out."""

import hashlib
import json
import tempfile

import pytest

from bitloom.sources import files


def write(name, text):
    folder = tempfile.mkdtemp(prefix="spark-files-")
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return f"{folder}/{name}"


def test_glossary_csv(spark):
    path = write("g.csv", '﻿source,target,tgt_lng\n"a, ""b""\nc",甲,\nx,y,zh_CN\nz,w,fr\n ,q,\n')
    got = sorted(map(tuple, files.read_glossary_csv(spark, path, "zh-CN").collect()))
    assert got == [('a, "b"\nc', "甲", ""), ("x", "y", "zh-cn")]
    for bad in ("source,target,more\na,b,c\n", "source,tgt_lng\na,b\n"):
        with pytest.raises(ValueError):
            files.read_glossary_csv(spark, write("b.csv", bad))
    out = tempfile.mkdtemp(prefix="spark-files-") + "/out"
    files.write_glossary_csv(files.read_glossary_csv(spark, path), out)
    assert files.read_glossary_csv(spark, out).count() == 3


def test_pack_and_catalog(spark):
    body = json.dumps({"schemaVersion": 1, "id": "p", "version": "1.0", "sourceLang": "en", "targetLang": "zh", "sources": [], "entries": [{"source": "a", "target": "甲", "tgt_lng": "zh"}]}, ensure_ascii=False)
    path = write("p.json", body)
    row = ("p", "1.0", hashlib.sha256(body.encode()).hexdigest(), len(body.encode()), 1, "zh", "someone")
    names = "id string, version string, sha256 string, size_bytes long, entry_count int, target_lang string, attribution string"
    assert [tuple(r) for r in files.read_glossary_pack(spark, path, spark.createDataFrame([row], names)).collect()] == [("p", "1.0", "a", "甲", "zh")]
    assert files.read_glossary_pack(spark, path, spark.createDataFrame([(*row[:4], 2, *row[5:])], names)).count() == 0
    bad = [row, ("P!", "x", "zz", 0, 0, "zh", " "), ("q", "1", row[2], 5, 1, "zh", "a"), ("q", "1", row[2], 5, 1, "zh", "a")]
    got = sorted((r["id"], r["violations"]) for r in files.validate_pack_catalog(spark.createDataFrame(bad, names)).collect())
    assert got == [("P!", ["bad_id", "bad_version", "bad_digest", "bad_size", "bad_count", "no_attribution"]), ("p", []), ("q", ["duplicate_id"]), ("q", ["duplicate_id"])]


def test_nested_dictionary(spark):
    entry = {"readings": ["", "r"], "defs": [{"def_cn": "甲", "def_en": "a", "pos_en": "n", "pos_cn": None, "ai": False, "ext": [{"ext_en": "x", "ext_cn": "y"}, {"ext_en": "", "ext_cn": "y"}, {"ext_en": "p", "ext_cn": "q"}, {"ext_en": "s", "ext_cn": "t"}]}, {"def_cn": "latin", "def_en": "b", "pos_en": None, "pos_cn": None, "ai": True, "ext": None}]}
    path = write("d.json", json.dumps({"word": entry, "none": {"readings": [], "defs": []}}, ensure_ascii=False))
    got = {r["word"]: r for r in files.read_nested_dictionary(spark, path).collect()}
    assert got["none"]["skipped"] and got["word"]["reading"] == "r" and got["word"]["is_ai"] and len(got["word"]["senses"]) == 1
    assert [tuple(x) for x in got["word"]["senses"][0]["examples"]] == [("x", "y"), ("p", "q")]


def test_ledger_and_safe_csv(spark):
    path = write("l.jsonl", '{"event": "usage", "callId": "c", "input": 3}\n\nnot json\n{"event": "validation", "accepted": 1}\n')
    assert sorted(r["event"] for r in files.read_ledger(spark, path).collect()) == ["usage", "validation"]
    out = files.safe_csv(spark.createDataFrame([("=1+1", 2), ("@x", 3), ("ok-", 4), (None, 5)], "a string, b int")).collect()
    assert [r["a"] for r in out] == ["'=1+1", "'@x", "ok-", None]
