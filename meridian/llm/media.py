"""Media columns: payloads as progressive JPEG files, and files as coefficients and RGB tensors.

A file's unit is the quantised DCT coefficient. Byte b of a payload is the coefficient
+(128 + b) for b < 128, else -(b), so its magnitude has eight bits and no coefficient is
zero. Sixty-four bytes make a block in zigzag order; blocks fill Y (four of six), Cb and Cr of
a 4:2:0 picture, whose rest is filled with byte 0. A comment segment holds the payload's length.

Scans: DC of each component (each block for itself, by restart markers); AC 1-5 and 6-63 of
each component without their two lowest bits (spectral selection); two refinements of AC
1-63 (successive approximation). Since all coefficients are nonzero from the first scan on,
codes have fixed lengths and refinements are end-of-band runs with a correction bit for each
coefficient; so scans are packed by numpy as whole bit arrays. The reader (jpeg.py) takes files
of other writers as well; a file without our comment has no payload.

Null and empty texts are 64 zero bytes. Rows are stored each, also if they repeat a doc_id; equal
texts give equal files. A text is stored whole, in one file; one beyond the 65 535 rows or columns
of a file raises ValueError. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices
from .jpeg import BLOCK, RUN, Picture, read_jpeg, to_rgb

#: Bits that the first AC scans leave to refinements.
LOW = 2
BANDS = ((1, 5), (6, 63))
MEDIA = "doc_id long, n_bytes long, media binary"
TENSORS = "doc_id long, payload binary, height long, width long, rgb binary"
REPORT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: (component, horizontal and vertical sampling)
COMPONENTS = ((1, 2), (2, 1), (3, 1))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: list[int]) -> bytes:
    """A Huffman table whose i-th symbol has a code of i + 1 bits: 0, 10, 110, ..."""
    counts = [1] * len(symbols) + [0] * (16 - len(symbols))
    return bytes([kind, *counts, *symbols])


#: End-of-band symbols by the number of bits of their run; EOB14 comes first, as it is the usual one.
_EOB = [14 << 4, *[n << 4 for n in range(14)]]
_HEADERS = _segment(0xDB, bytes([0] + [1] * 64)), _segment(0xC4, _table(0x00, [8]) + _table(0x10, [8 - LOW]) + _table(0x11, _EOB))


def _scan_header(component: int, table: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, table, first, last, high << 4 | low]))


def _shape(blocks: int) -> tuple[int, int]:
    """Rows and columns of 16 x 16 units that hold so many blocks."""
    units = -(-blocks // 6)
    columns = math.isqrt(units - 1) + 1
    return -(-units // columns), columns


def _stuffed(raw: np.ndarray) -> bytes:
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest bits of each value, the highest of them first, along a new last axis."""
    return ((values[..., None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)


def _packed(bits: np.ndarray) -> bytes:
    bits = bits.ravel()
    pad = -len(bits) % 8
    return _stuffed(np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits))


def _parts(units: int) -> list[tuple[int, int, int]]:
    """Component, first block and number of blocks."""
    out, at = [], 0
    for component, sampling in COMPONENTS:
        n = units * sampling * sampling
        out.append((component, at, n))
        at += n
    return out


def _runs(n: int) -> list[tuple[int, int]]:
    return [(a, min(RUN, n - a)) for a in range(0, n, RUN)]


def _run_head(n: int) -> np.ndarray:
    """Code and extra bits of an end-of-band run of n blocks."""
    size = n.bit_length() - 1
    place = _EOB.index(size << 4)
    return np.array([1] * place + [0] + [n >> k & 1 for k in range(size - 1, -1, -1)], dtype=np.uint8)


def encode_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG file of a payload of a positive multiple of 64 bytes."""
    rows, columns = _shape(len(payload) // BLOCK)
    if max(rows, columns) * 16 > 65535:
        raise ValueError("a text of over a gigabyte does not fit into one file")
    units = rows * columns
    data = np.zeros(units * 6 * BLOCK, dtype=np.uint8)
    data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    data = data.reshape(-1, BLOCK)
    # Sign and magnitude; the extra bits of a value are the magnitude, inverted if negative.
    minus = data >= 128
    size = np.where(minus, data, data + 128).astype(np.uint8)
    frame = struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + b"".join(bytes([c, s << 4 | s, 0]) for c, s in COMPONENTS)
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _HEADERS[0], _segment(0xC2, frame), _HEADERS[1], _segment(0xDD, b"\0\1")]
    extra = np.where(minus, ~size, size)
    for component, at, n in _parts(units):
        out.append(_scan_header(component, 0x00, 0, 0, 0, 0))
        out.append(_dc(extra[at : at + n, 0]))
    out.append(_segment(0xDD, b"\0\0"))
    high = size >> LOW
    first = np.where(minus, ~high, high)
    for lo, hi in BANDS:
        for component, at, n in _parts(units):
            out.append(_scan_header(component, 0x00, lo, hi, 0, LOW))
            bits = np.zeros((n, hi - lo + 1, 1 + 8 - LOW), dtype=np.uint8)
            bits[..., 1:] = _bits(first[at : at + n, lo : hi + 1], 8 - LOW)
            out.append(_packed(bits))
    for low in range(LOW - 1, -1, -1):
        for component, at, n in _parts(units):
            out.append(_scan_header(component, 0x01, 1, 63, low + 1, low))
            bits = (size[at : at + n, 1:] >> low) & 1
            out.append(_packed(np.concatenate([y for a, m in _runs(n) for y in (_run_head(m), bits[a : a + m].ravel())])))
    return b"".join([*out, b"\xff\xd9"])


def _dc(extra: np.ndarray) -> bytes:
    """A block's DC (code 0, eight bits, seven ones to fill) in two bytes; restart markers between blocks."""
    one, two = extra >> 1, (extra & 1) << 7 | 127
    n = len(extra)
    cells = np.zeros((n, 6), dtype=np.uint8)
    cells[:, 0] = one
    cells[:, 2] = two
    cells[:, 4] = 0xFF
    cells[:, 5] = 0xD0 + np.arange(n) % 8
    used = np.ones((n, 6), dtype=bool)
    used[:, 1] = one == 0xFF
    used[:, 3] = two == 0xFF
    used[-1, 4:] = False
    return cells[used].tobytes()


def payload_of(picture: Picture) -> bytes | None:
    """The payload of a file of ours, null for others."""
    if len(picture.comment) != 8:
        return None
    coefficients = np.concatenate([c.blocks for c in picture.components])
    length = struct.unpack(">Q", picture.comment)[0]
    return np.where(coefficients < 0, -coefficients, coefficients - 128).astype(np.uint8).ravel()[:length].tobytes()


def padded(text: bytes) -> bytes:
    return text + bytes(max(1, -(-len(text) // BLOCK)) * BLOCK - len(text))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            media = [encode_jpeg(padded(part.bytes_of(i))) for i in range(len(part))]
            yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(part.off)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(run, MEDIA)


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, payload, height, width and rgb (bytes of a height x width x 3 tensor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("doc_id"), batch.column("media"), strict=True):
                picture = read_jpeg(x.as_py())
                payload, rgb = payload_of(picture), to_rgb(picture)
                columns = [[i.as_py()], [payload], [rgb.shape[0]], [rgb.shape[1]], [rgb.tobytes()]]
                types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(*y) for y in zip(columns, types, strict=True)], names=["doc_id", "payload", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(run, TENSORS)


def media_report(docs: DataFrame) -> DataFrame:
    """Digests of what is stored and of what is read back, and the mean colour as a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("media"):
                media = x.as_py()
                picture = read_jpeg(media)
                payload, rgb = payload_of(picture), to_rgb(picture)
                mean = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) // (rgb.size // 3)
                feature = f"{rgb.shape[0]}x{rgb.shape[1]} " + " ".join(map(str, mean.tolist()))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                names = [x.split()[0] for x in REPORT.split(", ")]
                yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)

    return encode_media(docs).mapInArrow(run, REPORT)
