"""Reading JPEG files, progressive and baseline, into coefficient arrays and RGB tensors.

Scans of any tables, components, spectral bands and approximation bits are decoded by Huffman
codes, one after the other. Where the header shows that all codes of a scan have one length
(a table of one symbol; a refinement of coefficients that are all nonzero), the scan is unpacked
as a whole array of bits instead.
"""

from __future__ import annotations

import functools
import math
import struct
from dataclasses import dataclass, field

import numpy as np

BLOCK = 64
#: Most blocks in one end-of-band run.
RUN = 32767


def _zigzag() -> np.ndarray:
    """Natural place (row * 8 + column) of each zigzag position."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_x, _u = np.meshgrid(np.arange(8), np.arange(8))
#: Rows: frequency, columns: sample.
BASIS = np.cos((2 * _x + 1) * _u * math.pi / 16) * np.where(_u == 0, math.sqrt(1 / 8), 0.5)


def expect(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"not a JPEG file that can be read: {what}")


@dataclass
class Component:
    number: int
    across: int
    down: int
    quantiser: int
    #: Blocks of the component itself, and with what fills up the last units.
    columns: int = 0
    rows: int = 0
    all_columns: int = 0
    blocks: np.ndarray | None = None


@dataclass
class Picture:
    """Components with their coefficients (blocks x 64, zigzag order, int16), and the last comment."""

    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


@functools.lru_cache(maxsize=64)
def _code_table(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """Symbol and length of the code that begins with 16 given bits; files of one writer share their tables."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at = k = 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            span = 1 << 16 - size
            symbol[at : at + span], length[at : at + span] = symbols[k], size
            at, k = at + span, k + 1
    return symbol.tolist(), length.tolist()


class Codes:
    """A Huffman table."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.first_length = next((i + 1 for i, n in enumerate(counts) if n), 0)
        self._counts = counts

    def table(self) -> tuple[list[int], list[int]]:
        return _code_table(self._counts, self.symbols)


class Bits:
    """The bits of one stretch between restart markers; ones follow its end."""

    def __init__(self, raw: np.ndarray):
        bits = np.concatenate([np.unpackbits(raw), np.ones(64, np.uint8)]).astype(np.uint32)
        ahead = bits[: len(bits) - 16].copy()
        for k in range(1, 16):
            ahead = ahead << np.uint32(1) | bits[k : len(bits) - 16 + k]
        self.ahead, self.at = ahead.tolist(), 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        expect(self.at < len(self.ahead), "scan ends early")
        value = self.ahead[self.at] >> (16 - n)
        self.at += n
        return value

    def symbol(self, codes: Codes) -> int:
        symbol, length = codes.table()
        expect(self.at < len(self.ahead), "scan ends early")
        ahead = self.ahead[self.at]
        expect(length[ahead] > 0, "code")
        self.at += length[ahead]
        return symbol[ahead]

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


@dataclass
class Scan:
    parts: list[tuple[Component, Codes | None, Codes | None]]
    first: int
    last: int
    high: int
    low: int
    restart: int

    def units(self, picture: Picture) -> list[list[tuple[int, np.ndarray]]]:
        """For each unit in turn: the part and the coefficients of its blocks."""
        if len(self.parts) == 1:
            c = self.parts[0][0]
            return [[(0, c.blocks[r * c.all_columns + k])] for r in range(c.rows) for k in range(c.columns)]
        most = max(c.across for c in picture.components), max(c.down for c in picture.components)
        wide, tall = -(-picture.width // (8 * most[0])), -(-picture.height // (8 * most[1]))
        one = lambda r, k: [(i, c.blocks[(r * c.down + y) * c.all_columns + k * c.across + x]) for i, (c, _, _) in enumerate(self.parts) for y in range(c.down) for x in range(c.across)]
        return [one(r, k) for r in range(tall) for k in range(wide)]

    def decode(self, picture: Picture, stretches: list[np.ndarray]) -> None:
        units = self.units(picture)
        step = self.restart or max(len(units), 1)
        for n, begin in enumerate(range(0, len(units), step)):
            expect(n < len(stretches), "restart markers")
            self.bits, self.before, self.ended = Bits(stretches[n]), [0] * len(self.parts), 0
            for unit in units[begin : begin + step]:
                for i, block in unit:
                    if self.high:
                        self.refine(i, block)
                    else:
                        self.begin(i, block)

    def begin(self, i: int, block: np.ndarray) -> None:
        """Coefficients of a band for the first time."""
        bits, (_, dc, ac), k = self.bits, self.parts[i], self.first
        if k == 0:
            self.before[i] += bits.signed(bits.symbol(dc))
            block[0] = self.before[i] << self.low
            k = 1
        if k > self.last:
            return
        if self.ended:
            self.ended -= 1
            return
        while k <= self.last:
            zeros, size = divmod(bits.symbol(ac), 16)
            if size:
                k += zeros
                expect(k <= self.last, "run")
                block[k] = bits.signed(size) << self.low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                self.ended = (1 << zeros) - 1 + bits.take(zeros)
                return

    def refine(self, i: int, block: np.ndarray) -> None:
        """One more bit of a band's coefficients."""
        bits, one = self.bits, 1 << self.low
        if self.first == 0:
            block[0] |= bits.take(1) << self.low
            return
        ac, k = self.parts[i][2], self.first

        def correct(at: int) -> None:
            if bits.take(1):
                block[at] += one if block[at] > 0 else -one

        while not self.ended and k <= self.last:
            zeros, size = divmod(bits.symbol(ac), 16)
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif zeros < 15:
                self.ended = (1 << zeros) + bits.take(zeros)
                break
            while k <= self.last:
                if block[k]:
                    correct(k)
                elif zeros == 0:
                    if value:
                        block[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if self.ended:
            for at in range(k, self.last + 1):
                if block[at]:
                    correct(at)
            self.ended -= 1

    def unpack(self, scan: np.ndarray) -> bool:
        """Unpack the scan as one array of bits, if its codes allow that. scan: its bytes without restart markers."""
        if len(self.parts) > 1:
            return False
        c, dc, ac = self.parts[0]
        n = len(c.blocks)
        if n != c.rows * c.columns:
            return False
        if self.last == 0:
            # One size of at most eight bits, behind a code of one bit, and each block on its own: two bytes for each.
            if self.high or self.restart != 1 or len(dc.symbols) != 1 or dc.first_length != 1 or dc.symbols[0] != 8 or len(scan) != 2 * n:
                return False
            cells = scan.reshape(n, 2)
            extra = (cells[:, 0] << 1 | cells[:, 1] >> 7).astype(np.int16)
            c.blocks[:, 0] = np.where(extra < 128, extra - 255, extra) << self.low
            return True
        if self.first == 0 or self.restart:
            return False
        width = self.last - self.first + 1
        if not self.high:
            # Each coefficient has its code of one bit and so many bits.
            if len(ac.symbols) != 1 or ac.first_length != 1 or not 1 <= ac.symbols[0] <= 8:
                return False
            size = ac.symbols[0]
            bits = np.unpackbits(scan)[: n * width * (1 + size)].reshape(n, width, 1 + size)
            value = np.zeros((n, width), dtype=np.int16)
            for k in range(1, 1 + size):
                value = value << 1 | bits[..., k]
            c.blocks[:, self.first : self.last + 1] = np.where(bits[..., 1] == 0, value - ((1 << size) - 1), value) << self.low
            return True
        band = c.blocks[:, self.first : self.last + 1]
        if not band.all():
            return False
        # No coefficient is new: runs of blocks that have ended, with a bit for each coefficient.
        stream, used = np.unpackbits(scan), 0
        symbol, length = ac.table()
        for begin in range(0, n, RUN):
            m = min(RUN, n - begin)
            ahead = int(stream[used : used + 16].dot(1 << np.arange(15, -1, -1)[: len(stream[used : used + 16])]))
            zeros, coded = divmod(symbol[ahead], 16)
            used += length[ahead]
            run = (1 << zeros) + int(stream[used : used + zeros].astype(np.int64).dot(1 << np.arange(zeros - 1, -1, -1)))
            used += zeros
            if coded or zeros == 15 or run != m:
                return False
            bits = stream[used : used + m * width].reshape(m, width).astype(np.int16) << self.low
            used += m * width
            part = band[begin : begin + m]
            part += np.where(part < 0, -bits, bits)
        return True


def _entropy(raw: np.ndarray, media: bytes, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A scan's bytes without stuffing and restart markers, where these were, and where the next marker is."""
    end = at
    while True:
        end = media.find(b"\xff", end)
        expect(0 <= end < len(media) - 1, "end")
        if media[end + 1] == 0 or 0xD0 <= media[end + 1] <= 0xD7:
            end += 2
        else:
            break
    scan = raw[at:end]
    flag = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[flag + 1]
    keep = np.ones(len(scan), dtype=bool)
    keep[flag + 1] = False
    marks = flag[after != 0]
    keep[marks] = False
    kept = np.concatenate([[0], np.cumsum(keep)]) if len(marks) else keep
    return scan[keep], kept[marks] if len(marks) else marks, end


def _frame(body: bytes, picture: Picture) -> None:
    depth, picture.height, picture.width, n = struct.unpack(">BHHB", body[:6])
    expect(depth == 8 and picture.height > 0 and picture.width > 0 and n in (1, 3), "frame")
    for k in range(n):
        number, sampling, quantiser = body[6 + 3 * k : 9 + 3 * k]
        picture.components.append(Component(number, sampling >> 4, sampling & 15, quantiser))
    across, down = max(c.across for c in picture.components), max(c.down for c in picture.components)
    for c in picture.components:
        expect(across % c.across == 0 and down % c.down == 0, "sampling")
        c.columns, c.rows = -(-(-(-picture.width * c.across // across)) // 8), -(-(-(-picture.height * c.down // down)) // 8)
        c.all_columns = -(-picture.width // (8 * across)) * c.across
        c.blocks = np.zeros((c.all_columns * -(-picture.height // (8 * down)) * c.down, BLOCK), dtype=np.int16)


def read_jpeg(media: bytes) -> Picture:
    """The coefficients of a baseline or progressive file of Huffman codes with 8-bit samples."""
    raw = np.frombuffer(media, dtype=np.uint8)
    expect(media[:2] == b"\xff\xd8", "start")
    picture, codes, restart, at = Picture(), {}, 0, 2
    while True:
        expect(len(media) >= at + 2 and media[at] == 0xFF, "end")
        marker = media[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0xD9:
            break
        expect(len(media) >= at + 4, "end")
        long = struct.unpack(">H", media[at + 2 : at + 4])[0]
        body = media[at + 4 : at + 2 + long]
        at += 2 + long
        if marker == 0xFE:
            picture.comment = body
        elif marker in (0xC0, 0xC1, 0xC2):
            _frame(body, picture)
        elif marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                table = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8)
                picture.quantisers[number], body = table.astype(np.int32), body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]], body = Codes(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            n = body[0]
            of = {c.number: c for c in picture.components}
            expect(all(body[1 + 2 * k] in of for k in range(n)), "scan")
            parts = [(of[body[1 + 2 * k]], codes.get(body[2 + 2 * k] >> 4), codes.get(16 + (body[2 + 2 * k] & 15))) for k in range(n)]
            first, last, bits = body[1 + 2 * n :]
            one = Scan(parts, first, last, bits >> 4, bits & 15, restart)
            data, marks, at = _entropy(raw, media, at)
            if not one.unpack(data):
                one.decode(picture, np.split(data, marks))
        else:
            expect(0xE0 <= marker <= 0xEF, f"marker {marker:x}")
    expect(bool(picture.components), "no frame")
    return picture


def to_rgb(picture: Picture) -> np.ndarray:
    """The picture at full resolution, height x width x 3, as uint8."""
    across, down = max(c.across for c in picture.components), max(c.down for c in picture.components)
    planes = []
    for c in picture.components:
        table = picture.quantisers.get(c.quantiser)
        values = c.blocks if table is None or (table == 1).all() else c.blocks * table
        block = np.empty((len(values), BLOCK))
        block[:, ZIGZAG] = values
        block = np.matmul(np.matmul(BASIS.T, block.reshape(-1, 8, 8)), BASIS)
        plane = block.reshape(-1, c.all_columns, 8, 8).swapaxes(1, 2).reshape(-1, c.all_columns * 8)
        if (across, down) != (c.across, c.down):
            plane = np.repeat(np.repeat(plane, down // c.down, axis=0), across // c.across, axis=1)
        planes.append(plane[: picture.height, : picture.width])
    y = planes[0] + 128
    cb, cr = planes[1:] if len(planes) == 3 else (0.0, 0.0)
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
