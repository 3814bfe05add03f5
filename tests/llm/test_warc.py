"""Archives written, read back and resolved."""

import gzip
import os

import pytest

from bitloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, record_key string, copies long, best string"
PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", None), (4, "http://a/4", ""), (5, None, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (None, "http://a b/\r\nX-Row: 9", "é" * 5000),
    (7, "http://a/7", "é" * 5000), (7, "http://a/7", "é" * 5000), (7, "http://other", "é" * 5000), (2**60 + 1, "u", "z"), (2**60 + 3, "u", "z"), (None, None, "only null"), (None, "x", "only null"), (-4, "", "\n\n"),
]


def plain(rows):
    by = {}
    for i, _, html in rows:
        by.setdefault((html or "").encode(), []).append(i)
    out = []
    for body, ids in by.items():
        best = max((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=lambda i: (i != best, i is None, i or 0))
        out += [(i, len(body), warc.plain_digest(body), "revisit" if k else "response", best if k else None) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression", ["gzip", None])
def test_archives_hold_every_row(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(warc, "LARGE_ROWS", 1)
    monkeypatch.setattr(warc, "BLOCK", 2)
    rows = PAGES + [(20, "many", "<p>one</p>")] * 9
    pages = spark.createDataFrame([(*r, "p", "k", 7, "b") for r in rows], SCHEMA)
    folder = f"{tmp_path}/archive"
    warc.write(pages, folder, "page_id", "html", "url", compression)
    back = warc.read(spark, folder).collect()
    assert all(r["problem"] is None for r in back) and len({r["record_id"] for r in back}) == len(rows)
    bodies = {r["row_id"]: bytes(r["payload"]).decode() for r in back if r["record_type"] == "response"}
    assert bodies[7] == "é" * 5000 and bodies[2**60 + 3] == "z" and len([r for r in back if r["record_type"] == "response"]) == 7
    assert {r["url"] for r in back} == {u if u is None else u.replace(" ", "%20").replace("\r\n", "%0D%0A") for _, u, _ in rows} - {""} | {""}
    got = warc.resolve(warc.read(spark, folder, payloads=False))
    assert sorted(map(tuple, got.select("row_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == plain(rows)
    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("part")]
    first = open(files[0], "rb").read()
    assert (gzip.decompress(first) if compression else first).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", "page_id", "html", "url")
    assert warc.resolve(warc.read(spark, f"{tmp_path}/none")).count() == 0


def record(kind, body, *more):
    head = [f"WARC-Type: {kind}", f"WARC-Payload-Digest: sha1:{warc.plain_digest(body)}", *more]
    block = b"HTTP/1.1 200 OK\r\n\r\n" + (body if kind == "response" else b"")
    return ("\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_and_damaged_archives(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    good = record("response", b"body", "WARC-Record-ID: <urn:a>", "X-Row: 5")
    by_digest, lost = record("revisit", b"body", "X-Row: 6"), record("revisit", b"body", "WARC-Refers-To: <urn:gone>", "X-Row: 7")
    wrong = record("response", b"altered", "WARC-Record-ID: <urn:b>", "X-Row: 8").replace(b"\r\n\r\naltered", b"\r\n\r\nALTERED")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in (info, good, by_digest)))  # one member a record, as archives mostly are
    (tmp_path / "b.warc").write_bytes(b"junk\r\n\r\n" + lost + good[:60] + b"\r\n\r\n" + wrong + good[:-9])
    got = {(r["record_type"], r["row_id"]): (r["payload_bytes"], r["refers_to"], r["problem"]) for r in warc.resolve(warc.read(spark, str(tmp_path))).where("record_type is not null").collect() if r["row_id"]}
    assert got == {("response", 5): (4, None, None), ("revisit", 6): (4, 5, None), ("revisit", 7): (None, None, "response not found"), ("response", 8): (7, None, "payload digest differs")}
    assert warc.read(spark, str(tmp_path)).where("problem = 'record cannot be read'").count() == 3


def test_digests_agree(spark):
    texts = ["", "a", "é", "x" * 1000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.digest_of(warc.F.col("t").cast("binary"))).collect()
    assert {r[0]: r[1] for r in got} == {t: warc.plain_digest(t.encode()) for t in texts}
