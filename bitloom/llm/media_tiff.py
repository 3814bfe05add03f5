"""TIFF columns: texts or bytes to TIFF files and back, one row per page.

Reading walks the chain of image directories, decodes strips or tiles (stored, PackBits, LZW, deflate), undoes the
horizontal predictor and gives each page's samples. Writing makes 8-bit greyscale pages of a fixed width.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import prepare, text_of

# TIFF's field types with their sizes in bytes, tags and compression numbers.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 266, 284, 317, 322, 323, 324, 325
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes that one stored byte can stand for at most, by compression: what a page claims beyond that is not in its file.
MOST_FROM_ONE = {STORED: 1, PACKBITS: 64, DEFLATE: 1_032, OLD_DEFLATE: 1_032, LZW: 4_096}

#: Samples in a row, rows in a strip and rows in a page of the files that are written.
ROW, STRIP_ROWS, PAGE_ROWS = 64, 512, 1 << 20

PAGE = "struct<page:int,width:int,height:int,samples:int,bits:int,compression:int,predictor:int,parts:int,feature:string,pixels:binary,error:string>"

#: Each byte with its bits in reverse.
_TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_PAGE = [f.split(":")[0] for f in PAGE[7:-1].split(",")]


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, the rest as literals."""
    out = bytearray()
    a = np.frombuffer(data, np.uint8)
    n = len(a)
    if not n:
        return b""
    starts = np.r_[0, np.flatnonzero(a[1:] != a[:-1]) + 1, n]
    literal = 0
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if e - s < 3:
            continue
        for i in range(literal, s, 128):
            part = data[i : min(s, i + 128)]
            out += bytes((len(part) - 1,)) + part
        while e - s > 1:
            k = min(128, e - s)
            out += bytes((257 - k, data[s]))
            s += k
        literal = s
    for i in range(literal, n, 128):
        part = data[i : i + 128]
        out += bytes((len(part) - 1,)) + part
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += 2 + k
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, widened one code early; 256 clears, 257 ends."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    single = {bytes((i,)): i for i in range(256)}
    table, code, width, prefix = dict(single), 258, 9, b""
    put(256, width)
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in table:
            prefix = longer
            continue
        put(table[prefix], width)
        table[longer] = code
        code += 1
        if code == 4095:
            put(256, width)
            table, code, width = dict(single), 258, 9
        elif code >= (1 << width):
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        put(table[prefix], width)
        code += 1
        if code >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, table, width = bytearray(), [], 9
    held = bits = at = 0
    last = None
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    while len(out) < size:
        while bits < width:
            if at == len(data):
                return bytes(out)
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, None
            continue
        if last is None:
            if not table:
                table = list(first)
            if code > 255:
                raise ValueError("LZW: a code before its entry")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW: a code before its entry")
            table.append(last + entry[:1])
            if len(table) + 1 >= (1 << width) and width < 12:
                width += 1
        out += entry
        last = entry
    return bytes(out)


def _pack(data: bytes, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits(data)
    if compression == LZW:
        return lzw(data)
    return zlib.compress(data, 6) if compression in (DEFLATE, OLD_DEFLATE) else data


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == STORED:
        out = data[:size]
    elif compression == PACKBITS:
        out = unpackbits(data, size)
    elif compression == LZW:
        out = unlzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression} is not read")
    if len(out) < size:
        raise ValueError(f"a part has {len(out)} bytes of {size}")
    return out[:size]


def write_tiff(payload: bytes, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, row: int = ROW, strip_rows: int = STRIP_ROWS, page_rows: int = PAGE_ROWS) -> bytes:
    """A little-endian file with the payload (a multiple of ``row`` bytes, not empty) as 8-bit grey pages. tile: side of square tiles, 0 for strips."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, row)
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for top in range(0, len(pixels), page_rows):
        page = pixels[top : top + page_rows]
        if tile:
            padded = np.zeros((-(-len(page) // tile) * tile, -(-row // tile) * tile), np.uint8)
            padded[: len(page), :row] = page
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            parts = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((len(part), 1), np.uint8))
            raw = _pack(part.tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) & 1)
        fields = [(WIDTH, 4, [row]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        if tile:
            fields += [(TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            raw = b"".join(struct.pack("<H" if kind == 3 else "<I", v) for v in values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) & 1)
                raw = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def _field(data: bytes, order: str, kind: int, count: int, at: int) -> list[int]:
    size = TYPE_SIZE.get(kind, 0) * count
    if size > 4:
        at = struct.unpack_from(order + "I", data, at)[0]
    code = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}.get(kind)
    return list(struct.unpack_from(f"{order}{count}{code}", data, at)) if code else []


def directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    """The fields of each image directory, along the chain; a directory that comes again ends it."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            fields[tag] = _field(data, order, kind, count, at + 10 + 12 * i)
        fields[0] = [1 if order == "<" else 0]
        yield fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _samples(raw: bytes, rows: int, wide: int, samples: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """A part's samples (rows, wide, samples) with the predictor undone; those of under 8 bits are unpacked, rows being whole bytes."""
    if bits < 8:
        each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1).reshape(rows, -1, bits)
        values = (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : wide * samples]
        part = values.reshape(rows, wide, samples)
        return np.cumsum(part, axis=1, dtype=np.uint8) & ((1 << bits) - 1) if predictor == 2 else part
    size = bits // 8
    kind = np.dtype(f"{order}{'f' if predictor == 3 else 'u'}{size}")
    if predictor == 3:
        # bytes of a row are differences; they stand with all first (highest) bytes before all second ones
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, wide * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, wide, samples).astype(kind)
    part = np.frombuffer(raw, kind).reshape(rows, wide, samples)
    return np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")).astype(kind) if predictor == 2 else part


def read_page(data: bytes, f: dict[int, list[int]]) -> dict:
    """A page's size and samples, row by row, samples of a pixel together; 1, 2 and 4 bits as a byte each, 8 to 64 as they are, in the file's byte order."""
    one = lambda tag, default: f[tag][0] if f.get(tag) else default
    width, height, compression, predictor, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(COMPRESSION, STORED), one(PREDICTOR, 1), one(SAMPLES, 1), one(BITS, 1)
    planar = one(PLANAR, 1) == 2 and samples > 1
    order = "<" if f[0][0] else ">"
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(f.get(BITS, []))) > 1:
        raise ValueError(f"samples of {f.get(BITS)} bits are not read")
    if predictor not in (1, 2, 3) or predictor == 3 and bits not in (16, 32, 64):
        raise ValueError(f"predictor {predictor} with samples of {bits} bits is not read")
    tiled = TILE_OFFSETS in f
    wide, tall = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    if min(width, height, wide, tall, samples) < 1:
        raise ValueError("a page without pixels")
    offsets, sizes = (f[TILE_OFFSETS], f[TILE_BYTES]) if tiled else (f[STRIP_OFFSETS], f[STRIP_BYTES])
    across, down = -(-width // wide), -(-height // tall)
    if len(offsets) != across * down * (samples if planar else 1):
        raise ValueError(f"{len(offsets)} parts for {across} x {down} on {samples if planar else 1} planes")
    together = 1 if planar else samples
    held = sum(max(0, min(n, len(data) - at)) for at, n in zip(offsets, sizes, strict=True))
    if height * (width * samples * bits // 8) > held * MOST_FROM_ONE.get(compression, 1):
        raise ValueError(f"{width} x {height} pixels cannot be in {held} bytes")
    out = np.zeros((height, width, samples), np.uint8 if bits < 8 else f"{order}{'f' if predictor == 3 else 'u'}{bits // 8}")
    for i, (at, n) in enumerate(zip(offsets, sizes, strict=True)):
        plane, k = divmod(i, across * down)
        y, x = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - y)
        stored = data[at : at + n].translate(_TURNED) if one(FILL_ORDER, 1) == 2 else data[at : at + n]
        raw = _unpack(stored, compression, rows * -(-wide * together * bits // 8))
        part = _samples(raw, rows, wide, together, bits, order, predictor)
        out[y : y + rows, x : x + wide, plane : plane + together] = part[: height - y, : width - x]
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "parts": len(offsets), "pixels": out.tobytes()}


def feature(pixels: bytes) -> str:
    """Mean, deviation and entropy of a page's bytes, the share of zeros, and which of eight equal stretches are brighter than the mean."""
    a = np.frombuffer(pixels, np.uint8)
    h = np.bincount(a, minlength=256).astype(float)
    n = max(1, len(a))
    mean = float((h * np.arange(256)).sum() / n)
    deviation = float(np.sqrt(max(0.0, (h * np.arange(256) ** 2).sum() / n - mean**2)))
    q = h[h > 0] / n
    bright = "".join("1" if len(x) and x.mean() > mean else "0" for x in np.array_split(a, 8))
    return f"mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(q * np.log2(q)).sum()):.4f};zeros={h[0] / n:.4f};bright={bright}"


BAD = (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, OverflowError, struct.error, zlib.error, MemoryError)


def read_pages(data: bytes | None) -> list[dict]:
    """All pages in order; one that cannot be read has its number and an error only, as has the place where the chain of pages breaks. Null gives no page."""
    out: list[dict] = []
    chain = directories(data) if data is not None else iter(())
    while True:
        try:
            f = next(chain, None)
        except BAD as e:
            return [*out, {"page": len(out), "error": f"directory: {e}"}]
        if f is None:
            return out
        try:
            page = read_page(data, f)
            out.append({"page": len(out), **page, "feature": feature(page["pixels"])})
        except BAD as e:
            out.append({"page": len(out), "error": f"{type(e).__name__}: {e}"})


def read_tiff(data: bytes | None) -> list[dict]:
    """The pages that can be read, in order. Null, and bytes that are not such a file, give no page."""
    return [p for p in read_pages(data) if "error" not in p]


def pad(payload: bytes, row: int = ROW) -> bytes:
    """The payload with bytes 0 up to a multiple of row, at least one row."""
    return payload + b"\0" * (-len(payload) % row if payload else row)


def write_udf(compression: int = DEFLATE, predictor: int = 2, tile: int = 0):
    @F.pandas_udf("binary")
    def files(texts: pd.Series) -> pd.Series:
        return pd.Series([write_tiff(pad(t.encode("utf-8", "surrogatepass")), compression, predictor, tile) for t in texts], dtype=object)

    return files


def pages_of(media: str):
    """The column of a file's pages, those that cannot be read with an error and without the rest."""

    @F.pandas_udf(f"array<{PAGE}>")
    def pages(files: pd.Series) -> pd.Series:
        return pd.Series([[dict.fromkeys(_PAGE) | p for p in read_pages(f)] for f in files], dtype=object)

    return pages(media)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 2, tile: int = 0) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded to whole rows, as a TIFF file; a null text is empty, and an empty one is a row of zeros. Equal texts give equal files."""
    prepare(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), write_udf(compression, predictor, tile)(text_of(text_col)).alias("media"))


def read(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: media's other columns, page, width, height, samples, bits, compression, predictor, parts, feature, pixels, error.

    A column of media with one of these names, in any case, gives way to the page's. A page that cannot be read, and a file that is
    none, give a row with an error and nulls. Null files give no rows. An empty table gives an empty result.
    """
    prepare(media.sparkSession)
    others = [media[c] for c in media.columns if c != media_col and c.lower() not in _PAGE]
    rows = media.select(F.struct(F.lit(0).alias("__first"), *others).alias("own"), F.explode_outer(pages_of(media_col)).alias("page")).where("page is not null")  # explode() would read the files twice
    return rows.select(*(F.col("own")[c].alias(c) for c in media.columns if c != media_col and c.lower() not in _PAGE), "page.*")
