"""WARC archives with revisit records.

Headers (identifiers, sizes, digests, no payloads) are shuffled by payload digest; the record with the largest identifier of
each payload becomes the response, all others revisit it. Archives are written with fresh headers by Spark's text writer:
a record is one value and the empty lines between records are the line separator, so any file system that Spark knows
will do. Payloads are read from Spark's binary file source, record by record by their Content-Length; revisit records
are joined to the responses they name, so that every record has its payload's size and digest again.

Payloads are shuffled once, as only the chosen row of each keeps its own. Joins of many revisit records to one response deal
the record out in parts, so that a payload of a third of all rows is not one task.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import cut, prepare
from bitloom.llm.merkle import field

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records for which none is given.
DATE = "1970-01-01T00:00:00Z"
#: A response is dealt in parts from so many revisits on, or from this share of all rows if that is more, so that such responses stay few.
LARGE_ROWS, LARGE_SHARE, PARTS = 500, 1e-4, 5
#: Revisits of one repeated row that are made in one task.
BLOCK = 10_000
#: The header that carries the row's identifier.
ROW = "X-Row"
#: Bytes of payload that a file of an archive is meant to hold; a longer record has a file of its own.
FILE_BYTES = 32 << 20

RECORD = "record_id string, record_type string, row_id long, url string, refers_to string, payload_bytes long, payload_digest string, header_digest string, payload binary, problem string"
_END = "\r\n"


def digest_of(payload: Column) -> Column:
    """SHA-1 in upper-case base32, in Spark functions: five hex digits are four symbols."""
    hexed = F.sha1(payload)
    chunks = [F.lpad(F.conv(F.substring(hexed, k * 5 + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*chunks), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plain_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def meet(many: DataFrame, one: DataFrame, keys: list[str], rows_col: str, total: int, how: str = "left") -> DataFrame:
    """many joined to one on keys (each once in one; rows_col says how many rows of many it meets): keys met by very many rows are dealt in parts.

    Such keys are at most 1 / LARGE_SHARE, so they may be sent to every executor.
    """
    large = max(LARGE_ROWS, int(total * LARGE_SHARE))
    heavy = one.where(F.col(rows_col) > large).select(*keys, F.ceil(F.col(rows_col) * PARTS / large).cast("long").alias("__parts"))
    heavy = many.sparkSession.createDataFrame(heavy.collect(), heavy.schema)
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    dealt = many.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(heavy), keys, "left").withColumn("__part", F.pmod(F.xxhash64("__row"), parts)).drop("__row", "__parts")
    copies = one.join(F.broadcast(heavy), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")


def choose(headers: DataFrame) -> DataFrame:
    """headers (record_key, row_id, url, payload_key and any others) with is_best, and the chosen record's best_key, best_id and best_url.

    Rows that share payload_key have one payload; the one with the largest row_id is its response (a null one only without
    another, and of several alike the largest record_key). record_key is each row's own.
    """
    best = F.max(F.struct(F.col("row_id").isNotNull().alias("known"), "row_id", "record_key", "url"))
    chosen = cut(headers.groupBy("payload_key").agg(best.alias("best"), F.count("*").alias("__rows")))
    met = meet(headers, chosen, ["payload_key"], "__rows", headers.count(), "inner")
    return met.withColumns({"is_best": F.col("record_key") == F.col("best.record_key"), "best_key": F.col("best.record_key"), "best_id": F.col("best.row_id"), "best_url": F.col("best.url")}).drop("best", "__rows")


def record_id(key: Column, copy: Column) -> Column:
    """A URN that follows from the row's key, so that a rerun writes the same."""
    h = F.substring(F.sha2(F.concat(key, F.lit("|"), copy.cast("string")), 256), 1, 32)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header's line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def _target(url: Column) -> Column:
    """A URL that cannot break a header's line: spaces and control characters as %-escapes."""
    plain = F.when(~url.rlike(r"[\x00-\x20\x7f]"), url)
    out = url
    for c in [*range(33), 127]:
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.coalesce(plain, out)


def records(docs: DataFrame, id_col: str, payload_col: str, url_col: str, date: str = DATE) -> DataFrame:
    """(record, bytes): one WARC record per row of docs, as text without the empty lines that end it, and its payload's size.

    payload_col: text or bytes; a null one is empty, and empty payloads are equal. Rows that repeat in identifier, URL and payload
    each have a record: the first may be the response, the others revisit it. A null identifier or URL leaves its header line
    out. An empty table has no records. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": digest_of(F.col("payload")), "payload_key": F.sha2("payload", 256)})
    rows = rows.withColumn("record_key", F.sha2(F.concat(field(F.col("row_id")), field(F.col("url")), F.col("payload_key")), 256))
    once = ["row_id", "url", "payload_bytes", "payload_digest", "payload_key"]
    headers = cut(rows.groupBy("record_key").agg(*(F.first(c).alias(c) for c in once), F.count("*").alias("copies")))
    told = cut(choose(headers))
    # rows that repeat meet before payloads are shuffled, and the join needs no second shuffle
    bodies = rows.groupBy("record_key").agg(F.first("payload").alias("payload"))
    responses = bodies.join(told.where("is_best").drop("best_key", "best_id", "best_url"), "record_key")
    # revisits of rows that repeat very often are made in blocks, in many tasks
    first = F.col("is_best").cast("long")
    many = told.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("copies") / BLOCK)))).repartition("record_key", "block")
    low, high = F.greatest(first, F.col("block") * BLOCK), F.least(F.col("copies"), F.col("block") * BLOCK + BLOCK) - 1
    revisits = many.withColumn("copy", F.explode(F.when(low <= high, F.sequence(low, high))))

    def head(kind: str, copy: Column) -> Column:
        named = [
            F.lit(f"{VERSION}{_END}WARC-Type: {kind}{_END}"), _line("WARC-Record-ID", record_id(F.col("record_key"), copy)), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", _target(F.col("url"))),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), _line(ROW, F.col("row_id")), _line("Content-Type", F.lit("application/http; msgtype=response")),
        ]
        return F.concat(*named)

    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END * 2))
    full = F.concat(head("response", F.lit(0)), _line("Content-Length", F.octet_length(answer) + F.col("payload_bytes")), F.lit(_END), answer, F.col("payload").cast("string"))
    bare = f"HTTP/1.1 200 OK{_END * 2}"
    refers = F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", record_id(F.col("best_key"), F.lit(0))), _line("WARC-Refers-To-Target-URI", _target(F.col("best_url"))))
    short = F.concat(head("revisit", F.col("copy")), refers, F.lit(f"Content-Length: {len(bare)}{_END * 2}{bare}"))
    return responses.select(full.alias("record"), F.col("payload_bytes").alias("bytes")).unionByName(revisits.select(short.alias("record"), F.lit(0).cast("long").alias("bytes")))


def write(docs: DataFrame, folder: str, id_col: str, payload_col: str, url_col: str, compression: str | None = "gzip", date: str = DATE) -> None:
    """Write docs as a folder of WARC files: each a run of records, the text writer's line separator being what ends a record."""
    size = docs.agg(F.avg(F.octet_length(F.col(payload_col)))).first()[0] or 0.0
    made = records(docs, id_col, payload_col, url_col, date).select("record")
    made.write.option("lineSep", _END * 2).option("compression", compression or "none").option("maxRecordsPerFile", max(1, int(FILE_BYTES / (size + 512)))).text(folder)


def _inflated(content: bytes) -> bytes:
    """A gzip file's bytes, whatever its number of members; other files as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        if not member.eof:
            break
        content = member.unused_data
    return b"".join(out)


def parse(content: bytes) -> Iterator[tuple]:
    """The records of a WARC file, in RECORD's order. What cannot be read gives a row with its problem, and reading goes on at the next record."""
    at = 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        head = content[at:stop].decode("utf-8", "replace").split("\r\n") if stop >= 0 else [""]
        named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        length = named.get("content-length", "")
        end = stop + 4 + int(length) if length.isdecimal() else -1
        if not head[0].startswith("WARC/") or end < 0 or content[end : end + 4] != b"\r\n\r\n":
            yield (named.get("warc-record-id"), named.get("warc-type"), None, None, None, None, None, None, None, "record cannot be read")
            nxt = content.find(b"\r\n\r\nWARC/", at + 1)
            if nxt < 0:
                return
            at = nxt + 4
            continue
        block = content[stop + 4 : end]
        at = end + 4
        kind, row = named.get("warc-type"), named.get(ROW.lower(), "")
        told = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
        payload, problem = None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if told is not None and told != plain_digest(payload):
                problem = "payload digest differs"
        whole = row.removeprefix("-").isdecimal()
        yield (named.get("warc-record-id"), kind, int(row) if whole else None, named.get("warc-target-uri"), named.get("warc-refers-to"), None if payload is None else len(payload), None if payload is None else plain_digest(payload), told, payload, problem)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all files in folder (RECORD), each file in one task; without ``payloads`` that column is null, while sizes and digests are those of what was read."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        if not payloads:
            out["payload"] = None
        return out

    def records_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                held, size = [], 0
                for r in parse(_inflated(content)):
                    held.append(r if payloads else (*r[:8], None, r[9]))
                    size += len(r[8] or b"") if payloads else 0
                    if size >= 1 << 22 or len(held) >= 4096:
                        yield frame(held)
                        held, size = [], 0
                if held:
                    yield frame(held)

    prepare(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content").mapInPandas(records_of, RECORD)


def resolve(found: DataFrame) -> DataFrame:
    """(row_id, url, payload_bytes, payload_digest, record_type, refers_to, problem): every record with its payload's size and digest, revisits by the response they name.

    refers_to is the response's row_id. A revisit that names no record (WARC-Refers-To) is joined by its payload digest; one whose
    response is not in found keeps nulls and says so in problem. Records that are neither are given as they are.
    """
    headers = cut(found.drop("payload"))
    name = F.coalesce("refers_to", F.concat(F.lit("sha1:"), F.col("header_digest")))
    asked = headers.where("record_type = 'revisit'").withColumn("__key", name)
    wanted = asked.where("__key is not null").groupBy("__key").agg(F.count("*").alias("__rows"))
    keys = F.explode(F.array("record_id", F.concat(F.lit("sha1:"), F.col("payload_digest"))))
    targets = headers.where("record_type = 'response'").select(keys.alias("__key"), F.struct(F.col("row_id").isNotNull(), "row_id", "payload_bytes", "payload_digest").alias("t"))
    one = cut(wanted.join(targets, "__key").groupBy("__key", "__rows").agg(F.max("t").alias("t")))
    met = meet(asked, one, ["__key"], "__rows", headers.count())
    lost = F.when(F.col("t").isNull(), F.lit("response not found"))
    revisits = met.select("row_id", "url", F.col("t.payload_bytes").alias("payload_bytes"), F.col("t.payload_digest").alias("payload_digest"), "record_type", F.col("t.row_id").alias("refers_to"), F.coalesce("problem", lost).alias("problem"))
    others = headers.where("record_type is null or record_type <> 'revisit'").select("row_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "problem")
    return others.unionByName(revisits)
