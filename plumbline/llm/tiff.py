"""TIFF columns: images as binary cells, one row per page.

A reader walks the image file directories of a cell, decodes every strip or tile (stored, PackBits, LZW, deflate), undoes the
horizontal predictor and gives the page's samples in row order. A writer makes such cells from 8-bit samples. Both work on
one cell at a time inside Arrow batches, so nothing is shuffled and a task holds one slice of rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import slices

# Fixed values of the format: tag numbers, field types, compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD_TYPES = {1: "B", 3: "H", 4: "I"}
STORED, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_WIDEST = 256, 257, 258, 4096

#: Rows of samples in one page, strip and tile of the cells that ``encode`` writes.
PAGE_ROWS, STRIP_HEIGHT, TILE_SIDE = 16, 8, (192, 16)
#: How page k is stored: scheme k mod 4, as (compression, predictor, tiled).
SCHEMES = ((DEFLATE, 2, False), (PACKBITS, 1, False), (DEFLATE, 1, True), (LZW, 1, False))

PAGE_SCHEMA = (
    "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, "
    "pixels binary, error string"
)


@dataclass
class Page:
    """One directory's image. ``error`` says why ``pixels`` is missing."""

    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes | None
    error: str | None = None


def pack_bits(data: bytes) -> bytes:
    """Run-length coding in signed-count packets: repeats of 3 to 128 bytes, literals of 1 to 128 bytes."""
    out, literal = bytearray(), 0

    def literals(upto: int) -> None:
        nonlocal literal
        while literal < upto:
            n = min(128, upto - literal)
            out.append(n - 1)
            out.extend(data[literal:literal + n])
            literal += n

    for run in re.finditer(rb"(.)\1{2,127}", data, re.S):
        literals(run.start())
        out.append(257 - (run.end() - run.start()))
        out.append(data[run.start()])
        literal = run.end()
    literals(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        count = data[i]
        if count < 128:
            out += data[i + 1:i + 2 + count]
            i += count + 2
        else:
            if count > 128:
                out += data[i + 1:i + 2] * (257 - count)
            i += 2 if count > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, the width growing one code early as the format asks."""
    table, following, width = {bytes((i,)): i for i in range(256)}, LZW_FIRST, 9
    codes, widths = [LZW_CLEAR], [9]
    held = b""

    def put(code: int) -> None:
        codes.append(code)
        widths.append(width)

    for i in range(len(data)):
        longer = held + data[i:i + 1]
        if longer in table:
            held = longer
            continue
        put(table[held])
        table[longer] = following
        following += 1
        held = data[i:i + 1]
        if following == LZW_WIDEST - 2:
            put(LZW_CLEAR)
            table, following, width = {bytes((k,)): k for k in range(256)}, LZW_FIRST, 9
        elif following == 1 << width:
            width += 1
    if held:
        put(table[held])
        if following + 1 == LZW_WIDEST - 2:
            put(LZW_CLEAR)
            width = 9
        elif following + 1 == 1 << width:
            width += 1
    put(LZW_END)
    bits = "".join(format(c, f"0{w}b") for c, w in zip(codes, widths, strict=True))
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(first), 9, b""
    out, made, held, have = [], 0, 0, 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have & ((1 << width) - 1)
        if code == LZW_CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if code == LZW_END:
            break
        if not last:
            if code > 255:
                raise ValueError("LZW data start with a code not yet defined")
            last = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("LZW code beyond the table")
            table.append(last + entry[:1])
            last = entry
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(last)
        made += len(last)
        if made >= size:
            break
    return b"".join(out)[:size]


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


def _stored(data: bytes, size: int) -> bytes:
    return data[:size]


DECODERS = {STORED: _stored, LZW: lzw_decode, DEFLATE: _inflate, DEFLATE_OLD: _inflate, PACKBITS: unpack_bits}


def _deflate(data: bytes) -> bytes:
    return zlib.compress(data, 1)


ENCODERS = {STORED: bytes, LZW: lzw_encode, DEFLATE: _deflate, PACKBITS: pack_bits}


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    """The fields of the directory at ``at`` and the place of the next one."""
    (count,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for entry in range(at + 2, at + 2 + 12 * count, 12):
        tag, kind, n = struct.unpack_from(order + "HHI", data, entry)
        if kind in FIELD_TYPES:
            code = f"{order}{n}{FIELD_TYPES[kind]}"
            place = entry + 8 if struct.calcsize(code) <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
            fields[tag] = struct.unpack_from(code, data, place)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _samples(data: bytes, order: str, fields: dict[int, tuple]) -> Page:
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, tiled = one(COMPRESSION, STORED), one(PREDICTOR, 1), TILE_OFFSETS in fields
    page = Page(width, height, samples, bits, compression, predictor, tiled, None)
    if bits not in (8, 16) or len(set(fields.get(BITS, (bits,)))) > 1:
        page.error = f"bits per sample {fields.get(BITS)}"
    elif compression not in DECODERS:
        page.error = f"compression {compression}"
    elif predictor not in (1, 2) or one(PLANAR, 1) != 1:
        page.error = f"predictor {predictor}, planar configuration {one(PLANAR, 1)}"
    if page.error:
        return page
    across, down = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets = fields[TILE_OFFSETS if tiled else STRIP_OFFSETS]
    counts = fields[TILE_COUNTS if tiled else STRIP_COUNTS]
    kind = np.dtype("u1" if bits == 8 else order + "u2")
    image = np.empty((height, width, samples), kind)
    columns = -(-width // across) if across else 0
    if not columns or not down or len(offsets) != len(counts) or len(offsets) != columns * -(-height // down):
        page.error = "strips or tiles don't cover the image"
        return page
    for k, (offset, n) in enumerate(zip(offsets, counts, strict=True)):
        top, left = k // columns * down, k % columns * across
        rows = down if tiled else min(down, height - top)
        raw = DECODERS[compression](data[offset:offset + n], size := rows * across * samples * kind.itemsize)
        if len(raw) != size:
            page.error = f"segment {k} has {len(raw)} of {size} bytes"
            return page
        block = np.frombuffer(raw, kind).reshape(rows, across, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        part = image[top:top + rows, left:left + across]
        part[:] = block[:part.shape[0], :part.shape[1]]
    page.pixels = image.tobytes()
    return page


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a cell. What can't be read gives a page with an error, never an exception."""
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError(f"magic number {magic}")
    except (KeyError, struct.error, ValueError) as error:
        yield Page(0, 0, 0, 0, 0, 0, False, None, f"no TIFF header: {error}")
        return
    seen = set()
    while at and at not in seen:
        seen.add(at)
        try:
            fields, after = _directory(data, order, at)
            page = _samples(data, order, fields)
        except (struct.error, LookupError, ValueError, TypeError, OverflowError, zlib.error, MemoryError) as error:
            yield Page(0, 0, 0, 0, 0, 0, False, None, f"{type(error).__name__}: {error}")
            return
        yield page
        at = after


def encode(payload: bytes, width: int, page_rows: int = PAGE_ROWS, schemes=SCHEMES) -> bytes:
    """A little-endian TIFF of 8-bit grey samples, ``width`` a row, in pages of ``page_rows`` rows."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    for number, top in enumerate(range(0, len(samples), page_rows)):
        image = samples[top:top + page_rows]
        compression, predictor, tiled = schemes[number % len(schemes)]
        across, down = TILE_SIDE if tiled else (width, STRIP_HEIGHT)
        places, counts = [], []
        for row in range(0, len(image), down):
            for column in range(0, width, across):
                block = image[row:row + down, column:column + across]
                if tiled and block.shape != (down, across):
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                raw = ENCODERS[compression](block.tobytes())
                places.append(len(out))
                counts.append(len(raw))
                out += raw
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [len(image)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]),
                  (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [across]), (TILE_LENGTH, 4, [down]), (TILE_OFFSETS, 4, places), (TILE_COUNTS, 4, counts)] if tiled \
            else [(STRIP_OFFSETS, 4, places), (STRIP_ROWS, 4, [down]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            code = f"<{len(values)}{FIELD_TYPES[kind]}"
            value = struct.pack(code, *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                value, long_value = struct.pack("<I", len(out)), value
                out += long_value
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per page of every cell in ``media``: the key, the page's facts and samples, or an error.

    A NULL or empty cell gives one row with an error. Repeated rows give repeated pages.
    """
    kept = df.select(key, media)
    schema = f"`{key}` {kept.schema[key].dataType.simpleString()}, {PAGE_SCHEMA}"

    def pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media):
                rows = []
                for name, cell in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    for k, p in enumerate(read_pages(bytes(cell or b""))):
                        rows.append((name, k, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, p.error))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c.as_py() for c in columns[0]], part.schema.field(0).type), *(pa.array(c, pa.int32()) for c in columns[1:8]),
                     pa.array(columns[8], pa.bool_()), pa.array(columns[9], pa.binary()), pa.array(columns[10], pa.string())],
                    names=[key, "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels", "error"])

    return kept.mapInArrow(pages, schema)


UNIT = 576
DIGEST_SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string, n_pages int"
)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (UNIT - len(raw) if len(raw) < UNIT else -len(raw) % UNIT)


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as a TIFF cell, read back page by page, and what the read bytes say.

    The feature is the sixteen counts of the samples' upper four bits and the number of pages. A NULL text is an empty one;
    rows are independent, so repeated rows and ties give repeated results, and an empty table an empty one.
    """

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n, payload = payload_of(text)
                    media = encode(payload, UNIT)
                    pages = list(read_pages(media))
                    wrong = next((p.error for p in pages if p.error), None)
                    if wrong:
                        raise ValueError(f"document {name}: {wrong}")
                    back = b"".join(p.pixels for p in pages)
                    counts = np.bincount(np.frombuffer(back, np.uint8) >> 4, minlength=16)
                    rows.append((name, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media),
                                 hashlib.sha256(media).hexdigest(), ",".join(map(str, counts)) + f"|{len(pages)}", len(pages)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
                names = [f.split(" ")[0] for f in DIGEST_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(digest, DIGEST_SCHEMA)
