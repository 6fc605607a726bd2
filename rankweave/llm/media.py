"""Media columns: payloads stored as baseline JPEG files, read back as thumbnails.

``encode`` stores bytes losslessly in a greyscale baseline JPEG.  JPEG's own
unit is the quantised DCT coefficient, and those are what carries the bytes:
64 bytes make one 8x8 block.  The first byte of a block is its DC coefficient
(byte - 128); each further byte is an AC coefficient of size category 8, whose
256 values are exactly one byte.  With all-one quantisation nothing is rounded.

``decode`` parses the markers of any baseline JPEG, Huffman-decodes its scan
and rebuilds the luminance thumbnail from the DC coefficients alone.  Where the
tables in the file give every symbol the same number of bits, code and
appended bits together (as ``encode`` arranges), the symbols start at fixed
distances and numpy decodes them all at once; other files take the bit-wise
decoder.

Defined results: a null text counts as empty; an empty payload is one block of
zero bytes; equal texts, repeated rows and ties give equal files.  Extra columns of
the input are ignored, an empty table gives an empty table.  A row is coded as a whole:
a task needs about thirteen times the bytes of its longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class JpegError(ValueError):
    """The bytes are no baseline JPEG this module can read."""


@dataclass
class Decoded:
    width: int
    height: int
    thumbnail: np.ndarray  # uint8, one value for each 8x8 luminance block
    coefficients: np.ndarray  # int32, luminance blocks x 64, in scan order
    comment: bytes


# -- writing ---------------------------------------------------------------

_DC_LENGTHS = [1] * 9 + [0] * 7  # one code of each length 1..9
_DC_SYMBOLS = [8, 7, 6, 5, 4, 3, 2, 1, 0]
_AC_LENGTHS = [1] + [0] * 15
_AC_SYMBOLS = [0x08]


def _dc_codes() -> np.ndarray:
    """Code and appended bits, nine bits in all, of each difference -255..255."""
    out = np.zeros(511, np.uint16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code = ((1 << (8 - size)) - 1) << 1
        out[diff + 255] = (code << size) | (diff if diff > 0 else diff + (1 << size) - 1) if size else 0b111111110
    return out


_DC_CODE = _dc_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _grid(blocks: int) -> tuple[int, int]:
    """Blocks across and down; nearly square, so both stay within 65535 samples."""
    across = max(1, int(np.ceil(np.sqrt(blocks))))
    return across, -(-blocks // across)


_TABLES = (
    _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC4, bytes([0x00, *_DC_LENGTHS, *_DC_SYMBOLS]))
    + _segment(0xC4, bytes([0x10, *_AC_LENGTHS, *_AC_SYMBOLS]))
)


def encode(payload: bytes) -> bytes:
    """A baseline JPEG that carries `payload`, whose length is a positive multiple of 64."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    blocks = len(payload) // 64
    across, down = _grid(blocks)
    if across > 8191:
        raise ValueError("payload too large for one JPEG")
    units = np.zeros((across * down, 64), np.uint16)
    units[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    dc = units[:, 0].astype(np.int32) - 128
    units[:, 0] = _DC_CODE[np.diff(dc, prepend=0) + 255]
    v = units.reshape(-1, 8)  # eight symbols of nine bits are nine bytes
    out = np.empty((len(v), 9), np.uint8)
    out[:, 0] = v[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (v[:, j - 1] << (8 - j)) | (v[:, j] >> (j + 1))
    out[:, 8] = v[:, 7]
    scan = out.tobytes().replace(b"\xff", b"\xff\x00")
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xFE, b"%d" % len(payload)),
            _TABLES,
            _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
            scan,
            b"\xff\xd9",
        )
    )


# -- reading ---------------------------------------------------------------


Codes = tuple[tuple[tuple[int, int], int], ...]


@lru_cache(256)
def _codes(lengths: bytes, symbols: bytes) -> Codes:
    """(length, code) -> symbol as sorted items, by the canonical rule of T.81 annex C."""
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(lengths[length - 1]):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return tuple(sorted(out.items()))


def _extend(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


@lru_cache(256)
def _uniform(codes: Codes, of_dc: bool) -> np.ndarray | None:
    """For tables whose symbols all take nine bits with what they append: the value of
    each nine-bit word; None for other tables."""
    out = np.full(512, -(1 << 20), np.int32)
    for (length, code), symbol in codes:
        size = symbol & 15
        if symbol >> 4 or length + size != 9 and not (of_dc and symbol == 0 and length == 9) or not of_dc and not size:
            return None
        for bits in range(1 << size):
            out[(code << size) | bits] = _extend(bits, size)
    return out


class _Bits:
    """Bit reader over one entropy-coded segment without stuffing."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
            if self.at > len(self.data) + 8:
                raise JpegError("the scan ends early")
        self.n -= k
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, codes: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise JpegError("no such Huffman code")


def _scan_end(data: bytes, at: int) -> int:
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def decode(data: bytes) -> Decoded:
    """Dimensions, DC-only luminance thumbnail and luminance coefficients of a baseline JPEG."""
    try:
        return _decode(data)
    except (ValueError, IndexError, KeyError, struct.error) as e:
        raise e if isinstance(e, JpegError) else JpegError(f"broken segment: {e}") from e


def _decode(data: bytes) -> Decoded:
    if data[:2] != b"\xff\xd8":
        raise JpegError("no SOI marker")
    at, quant, huff, frame, restart, comment = 2, {}, {}, None, 0, b""
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("no scan")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                step = 128 if wide else 64
                quant[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                k += 1 + step
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                lengths = body[k + 1 : k + 17]
                n = sum(lengths)
                huff[body[k]] = _codes(lengths, body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xC0:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise JpegError("baseline has 8 bits a sample")
            frame = (height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError("not a baseline frame")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    if frame is None:
        raise JpegError("no frame header")
    height, width, parts = frame
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    parts = [(h, v, q, huff[chosen[c] >> 4], huff[0x10 | chosen[c] & 15]) for c, h, v, q in parts if c in chosen]
    scan = data[at : _scan_end(data, at)]
    if len(parts) == 1:
        parts = [(1, 1, *parts[0][2:])]  # a scan of one component has one block a unit
    most_h, most_v = max(p[0] for p in parts), max(p[1] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    units = across * down
    fast = len(parts) == 1 and not restart and (_uniform(parts[0][3], True), _uniform(parts[0][4], False))
    if fast and fast[0] is not None and fast[1] is not None:
        blocks = _decode_uniform(scan, units, *fast)
    else:
        blocks = _decode_bits(scan, units, parts, restart)
    h, v, q = parts[0][:3]
    wide, high = -(-width * h // (8 * most_h)), -(-height * v // (8 * most_v))
    dc = (blocks[:, 0] * quant[q][0]).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    thumb = np.clip(np.floor_divide(dc[:high, :wide] + 4, 8) + 128, 0, 255).astype(np.uint8)
    return Decoded(width, height, thumb, blocks, comment)


def _decode_uniform(scan: bytes, units: int, dc: np.ndarray, ac: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(scan.replace(b"\xff\x00", b"\xff"), np.uint8)
    if len(raw) < units * 72:
        raise JpegError("the scan ends early")
    b = raw[: units * 72].reshape(-1, 9).astype(np.uint16)
    v = np.empty((len(b), 8), np.uint16)
    for j in range(8):
        v[:, j] = (b[:, j] << (j + 1) | b[:, j + 1] >> (7 - j)) & 511
    v = v.reshape(units, 64)
    out = ac[v]
    out[:, 0] = np.cumsum(dc[v[:, 0]])
    if out.min() < -(1 << 16):
        raise JpegError("no such Huffman code")
    return out


def _decode_bits(scan: bytes, units: int, parts: list, restart: int) -> np.ndarray:
    parts = [(h, v, q, dict(dc), dict(ac)) for h, v, q, dc, ac in parts]
    pieces, start, k = [], 0, 0
    while (k := scan.find(b"\xff", k)) >= 0 and k + 1 < len(scan):
        if 0xD0 <= scan[k + 1] <= 0xD7:
            pieces.append(scan[start:k])
            start = k + 2
        k += 2
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in [*pieces, scan[start:]]]
    out, done = [], 0
    for piece in pieces:
        bits, before = _Bits(piece), [0] * len(parts)
        for _ in range(min(restart or units, units - done)):
            for p, (h, v, _q, dc, ac) in enumerate(parts):
                for _b in range(h * v):
                    block = [0] * 64
                    size = bits.symbol(dc)
                    before[p] += _extend(bits.take(size), size)
                    block[0], at = before[p], 1
                    while at < 64:
                        symbol = bits.symbol(ac)
                        run, size = symbol >> 4, symbol & 15
                        if not size and run != 15:
                            break
                        at += run
                        if size:
                            if at > 63:
                                raise JpegError("a run leaves its block")
                            block[at] = _extend(bits.take(size), size)
                        at += 1
                    if p == 0:
                        out.append(block)
            done += 1
    if done < units:
        raise JpegError("the scan ends early")
    return np.array(out, np.int32).reshape(-1, 64)


def stored_payload(image: Decoded) -> bytes:
    """The bytes that ``encode`` put into the coefficients."""
    c = image.coefficients
    out = np.where(c > 0, c, c + 255)
    out[:, 0] = c[:, 0] + 128
    return out.astype(np.uint8).tobytes()[: int(image.comment)]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash: 8 rows of 9 cells, each cell compared with its right neighbour."""
    h, w = thumb.shape
    cells = thumb[(np.arange(8) * h) // 8][:, (np.arange(9) * w) // 9]
    return np.packbits(cells[:, 1:] > cells[:, :-1]).tobytes().hex()


# -- the operator ----------------------------------------------------------

MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, width int, height int, thumb_hash string, thumb_sha256 string, feature string"
)


def _row(text: bytes) -> tuple:
    payload = text + bytes(-len(text) % 64 or (0 if text else 64))
    media = encode(payload)
    image = decode(media)
    back = stored_payload(image)
    phash, tsha = thumbnail_hash(image.thumbnail), hashlib.sha256(image.thumbnail.tobytes()).hexdigest()
    return (
        len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
        hashlib.sha256(media).hexdigest(), image.width, image.height, phash, tsha, f"{image.width}x{image.height}:{phash}:{tsha[:16]}", media,
    )


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store each text as a JPEG, read it back, and return dimensions, digests and
    thumbnail hashes; with `keep_media` also the file itself as column ``media``."""
    schema = MEDIA_SCHEMA + (", media binary" if keep_media else "")
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, ids = [], 0, []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = _row(text.as_buffer().to_pybytes() if text.is_valid else b"")
                ids.append(i)
                rows.append(row)
                size += len(row[-1])
                if keep_media and size > 8 << 20:
                    yield emit(ids, rows)
                    rows, size, ids = [], 0, []
                elif not keep_media:
                    rows[-1] = row[:-1]
            if rows:
                yield emit(ids, rows)

    def emit(ids: list, rows: list) -> pa.RecordBatch:
        columns = [ids, *map(list, zip(*rows, strict=True))][: len(fields)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
