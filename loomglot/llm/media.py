"""Media columns: progressive JPEG written and read in numpy.

The reader handles progressive JPEG in general: spectral selection and successive approximation scans, interleaved or not, restart
intervals, end-of-band runs, any Huffman tables and sampling factors. Scans are accumulated into one coefficient array per component,
which is dequantised, inverse-transformed, upsampled and converted to full-resolution RGB. All arithmetic is on
integers (the transform in doubles that hold exact integers), so equal files give equal tensors on any machine.

A payload is stored losslessly in the format's own unit, the quantised coefficient: byte ``b`` is the coefficient ``256 + b`` (AC) or,
for DC, ``768 + b`` and ``b`` in turn, so that all differences fall into one category. Every symbol of a scan is then the same, its
table has one code of one bit, and all fields have one width; the reader sees that from the table and takes such a scan apart as an
array. Other scans go through the bit reader.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text, record_batch, small_batches

UNIT = 192
NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
MOST_ROWS = 4000  # of MCUs; the format ends at 65,535 lines


def zigzag_order() -> np.ndarray:
    """Natural index of each zigzag position: anti-diagonals, walked in alternate directions."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag_order()
#: Inverse transform basis, scaled to integers: row u, sample x.
SCALE = 12
BASIS = np.rint((1 << SCALE) * np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)]))


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    blocks_wide: int = 0  # of the whole array, which covers all MCUs
    blocks_high: int = 0
    own_wide: int = 0  # of a scan of this component alone
    own_high: int = 0
    coefficients: np.ndarray | None = None  # (blocks, 64) in zigzag order


@dataclass
class Huffman:
    """Code lengths and symbols of a table; ``only`` is the symbol of a table with one code of one bit."""

    counts: tuple[int, ...]
    symbols: bytes
    codes: dict = field(default_factory=dict)

    def __post_init__(self):
        code, at = 0, 0
        for length, n in enumerate(self.counts, 1):
            for _ in range(n):
                self.codes[length, code] = self.symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = self.symbols[0] if self.counts[0] == 1 and sum(self.counts) == 1 else None


class Bits:
    """Reads bits from unstuffed bytes; past the end all bits are 1."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            found = table.codes.get((length, code))
            if found is not None:
                return found
        raise ValueError("a code that its table doesn't have")

    def value(self, size: int) -> int:
        """A signed number of ``size`` bits: those below half the range are negative."""
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


def read_progressive(data: bytes) -> Picture:
    """Parse a progressive JPEG and accumulate its scans."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, tables, restart, at = Picture(), {}, 0, 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide, ident = body[k] >> 4, body[k] & 15
                kind = ">u2" if wide else "u1"
                out.quantisers[ident] = np.frombuffer(body, kind, 64, k + 1).astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = tuple(body[k + 1 : k + 17])
                tables[body[k]] = Huffman(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xC2:
            _start_frame(out, body)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only Huffman-coded progressive frames are read here")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            out.comments.append(body)
        elif marker == 0xDA:
            found = NEXT_MARKER.search(data, at)
            end = found.start() if found else len(data)
            n = body[0]
            chosen = [(next(c for c in out.components if c.ident == body[1 + 2 * k]), body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            _scan(out, tables, restart, chosen, first, last, approx >> 4, approx & 15, data[at:end])
            at = end
    return out


def _start_frame(out: Picture, body: bytes) -> None:
    precision, out.height, out.width, n = struct.unpack_from(">BHHB", body)
    if precision != 8:
        raise ValueError("only 8-bit samples are read here")
    out.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
    h, v = max(c.h for c in out.components), max(c.v for c in out.components)
    for c in out.components:
        c.blocks_wide, c.blocks_high = -(-out.width // (8 * h)) * c.h, -(-out.height // (8 * v)) * c.v
        c.own_wide, c.own_high = -(-(-(-out.width * c.h // h)) // 8), -(-(-(-out.height * c.v // v)) // 8)
        c.coefficients = np.zeros((c.blocks_wide * c.blocks_high, 64), np.int32)


def _block_order(chosen: list) -> list[tuple[int, np.ndarray]]:
    """For each unit of a scan's repeating pattern, the component's place in the scan and its blocks' rows in order."""
    if len(chosen) == 1:
        c = chosen[0][0]
        return [(0, (np.arange(c.own_high)[:, None] * c.blocks_wide + np.arange(c.own_wide)).ravel())]
    out = []
    for k, (c, _, _) in enumerate(chosen):
        across, down = c.blocks_wide // c.h, c.blocks_high // c.v
        for y in range(c.v):
            for x in range(c.h):
                out.append((k, ((np.arange(down)[:, None] * c.v + y) * c.blocks_wide + np.arange(across) * c.h + x).ravel()))
    return out


def _scan(out: Picture, tables: dict, restart: int, chosen: list, first: int, last: int, high: int, low: int, data: bytes) -> None:
    order = _block_order(chosen)
    n = len(order[0][1])
    c, dc, ac = chosen[0]
    table = tables.get(dc if first == 0 else 0x10 | ac)
    if len(chosen) == 1 and not restart:
        blocks, band = order[0][1], slice(first, last + 1)
        width = last - first + 1
        if first == 0 and high:
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8), count=n)
            c.coefficients[blocks, 0] |= bits.astype(np.int32) << low
            return
        if first == 0 and table.only is not None:
            got = _fixed_fields(data, n, 1 + table.only)
            c.coefficients[blocks, 0] = np.cumsum(_signed(got, table.only)) << low
            return
        if first and not high and table.only is not None and 0 < table.only < 16:
            got = _fixed_fields(data, n * width, 1 + table.only)
            c.coefficients[blocks, band] = (_signed(got, table.only) << low).reshape(n, width)
            return
        if first and high and table.only == 0 and c.coefficients[blocks, band].all():
            bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8), count=n * (1 + width)).reshape(n, 1 + width)[:, 1:]
            held = c.coefficients[blocks, band]
            c.coefficients[blocks, band] = held + (np.sign(held) * bits.astype(np.int32) << low)
            return
    _scan_bits(tables, restart, chosen, order, first, last, high, low, data)


def _fixed_fields(data: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` fields of ``width`` bits."""
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
    if width == 8:
        return raw[:n].astype(np.int32)
    bits = np.unpackbits(raw, count=n * width).reshape(n, width)
    return bits.astype(np.int32) @ (1 << np.arange(width - 1, -1, -1)).astype(np.int32)


def _signed(fields: np.ndarray, size: int) -> np.ndarray:
    v = fields & ((1 << size) - 1)
    return np.where(v >> (size - 1), v, v - (1 << size) + 1) if size else v * 0


def _scan_bits(tables: dict, restart: int, chosen: list, order: list, first: int, last: int, high: int, low: int, data: bytes) -> None:
    """A scan of any kind, bit by bit."""
    parts = [p.replace(b"\xff\x00", b"\xff") for p in RESTART.split(data)]
    bits, part, run = Bits(parts[0]), 0, 0
    predicted = [0] * len(chosen)
    for unit in range(len(order[0][1])):
        if restart and unit and unit % restart == 0:
            part += 1
            bits, run, predicted = Bits(parts[part] if part < len(parts) else b""), 0, [0] * len(chosen)
        for k, blocks in order:
            c, dc, ac = chosen[k]
            block = c.coefficients[blocks[unit]]
            if first == 0:
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    predicted[k] += bits.value(bits.symbol(tables[dc]))
                    block[0] = predicted[k] << low
            elif not high:
                run = _first_ac(bits, tables[0x10 | ac], block, first, last, low, run)
            else:
                run = _refine_ac(bits, tables[0x10 | ac], block, first, last, 1 << low, run)


def _first_ac(bits: Bits, table: Huffman, block: np.ndarray, first: int, last: int, low: int, run: int) -> int:
    if run:
        return run - 1
    k = first
    while k <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            block[k] = bits.value(size) << low
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
    return 0


def _refine_ac(bits: Bits, table: Huffman, block: np.ndarray, first: int, last: int, step: int, run: int) -> int:
    def correct(k):
        if bits.take(1):
            block[k] += step if block[k] > 0 else -step

    k = first
    if not run:
        while k <= last:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = step if bits.take(1) else -step
            elif zeros < 15:
                run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                break
            while k <= last:  # past known coefficients and ``zeros`` unknown ones
                if block[k]:
                    correct(k)
                elif zeros == 0:
                    if new:
                        block[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
    if run:
        for j in range(k, last + 1):
            if block[j]:
                correct(j)
        run -= 1
    return run


def to_rgb(picture: Picture) -> np.ndarray:
    """``(height, width, 3)`` unsigned 8-bit: dequantise, inverse-transform, upsample by repetition, convert. One component is grey."""
    h, v = max(c.h for c in picture.components), max(c.v for c in picture.components)
    planes = []
    for c in picture.components:
        natural = np.empty((len(c.coefficients), 64))
        natural[:, ZIGZAG] = c.coefficients * picture.quantisers[c.table]
        rows = (natural.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
        samples = (np.ascontiguousarray(rows).reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
        whole = np.floor(samples / (1 << 2 * SCALE) + 128.5).astype(np.int32).clip(0, 255)
        plane = whole.reshape(c.blocks_high, c.blocks_wide, 8, 8).swapaxes(1, 2).reshape(8 * c.blocks_high, 8 * c.blocks_wide)
        if (c.h, c.v) != (h, v):
            plane = np.repeat(np.repeat(plane, v // c.v, 0), h // c.h, 1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    # The format's colour equations in 16-bit fixed point.
    rgb = np.stack([y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr - 32768) >> 16), y + ((116130 * cb + 32768) >> 16)], 2)
    return rgb.clip(0, 255).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_symbol(ident: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([ident, 1, *[0] * 15, symbol]))


def _scan_header(ident: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, ident, 0, first, last, high << 4 | low]))


def _stuffed(bits_or_bytes: np.ndarray) -> bytes:
    return bits_or_bytes.tobytes().replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last one filled with ones."""
    flat = bits.ravel()
    return _stuffed(np.packbits(np.concatenate((flat, np.ones(-len(flat) % 8, np.uint8)))))


def write_payload(payload: bytes) -> bytes:
    """A 4:2:0 progressive JPEG whose coefficients are ``payload``, of a positive multiple of 192 bytes; the rest of the last
    MCUs is zero bytes. Its length stands in a comment."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    units = -(-len(blocks) // 6)
    wide = -(-units // MOST_ROWS)
    high = -(-units // wide)
    units = wide * high
    full = np.zeros((6 * units, 64), np.uint8)
    full[: len(blocks)] = blocks
    parts = {1: full[: 4 * units], 2: full[4 * units : 5 * units], 3: full[5 * units :]}
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, bytes([0, *[1] * 64])), _segment(0xC2, frame)]
    out.append(_one_symbol(0x00, 9))
    for ident, part in parts.items():  # DC differences alternate between +-(257..511): always nine bits
        value = (part[:, 0] >> 1).astype(np.int32)
        value[0::2] += 384
        difference = np.diff(value, prepend=0)
        coded = np.where(difference < 0, difference + 511, difference)
        out += [_scan_header(ident, 0, 0, 0, 1), _packed((coded[:, None] >> np.arange(9, -1, -1) & 1).astype(np.uint8))]
    out.append(_one_symbol(0x10, 7))
    for ident, part in parts.items():  # 64..127: one code bit and seven value bits are one byte
        for first, last in ((1, 5), (6, 63)) if ident == 1 else ((1, 63),):
            out += [_scan_header(ident, first, last, 0, 2), _stuffed(part[:, first : last + 1] >> 2 | 0x40)]
    out.append(_one_symbol(0x10, 0))
    for low in (1, 0):
        for ident, part in parts.items():
            bits = part >> low & 1
            if low == 0:
                out += [_scan_header(ident, 0, 0, 1, 0), _packed(bits[:, 0])]
            bits = bits.copy()
            bits[:, 0] = 0  # the end-of-band code, then a correction bit for each coefficient
            out += [_scan_header(ident, 1, 63, low + 1, low), _packed(bits)]
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(picture: Picture) -> bytes:
    """The bytes that ``write_payload`` stored."""
    length = int(next(c for c in picture.comments if c.startswith(b"payload ")).split()[1])
    return np.concatenate([(c.coefficients & 255).astype(np.uint8) for c in picture.components]).tobytes()[:length]


def padded(text: bytes) -> bytes:
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def feature_of(rgb: np.ndarray) -> str:
    """Size, then mean and mean square of each channel in thousandths, from exact integer sums."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    sums, squares = flat.sum(0, dtype=np.int64), np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(f"{1000 * int(a) // n}/{1000 * int(b) // n}" for a, b in zip(sums, squares))


MEDIA = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("height", pa.int64()), ("width", pa.int64()), ("rgb", pa.binary())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media, height, width, rgb``: each whole text as a JPEG and the RGB tensor (row-major bytes) read back from it.

    Null texts count as empty, which is one unit of spaces; null ids and repeated rows stay; an empty table gives no rows; other columns
    are ignored. One map over the scan; a task holds one slice of rows (or the longest text).
    """

    def run(batches):
        for batch in small_batches(batches, rows=64, byte_budget=1 << 20):
            files = [write_payload(padded(t.encode())) for t in batch.column(1).to_pylist()]
            tensors = [to_rgb(read_progressive(f)) for f in files]
            yield record_batch(MEDIA, [batch.column(0), files, [t.shape[0] for t in tensors], [t.shape[1] for t in tensors], [t.tobytes() for t in tensors]])

    return doc_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, media binary, height bigint, width bigint, rgb binary")


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``media_columns`` in digest: each text is stored, read back from the stored bytes alone, and described."""

    def digest(text: bytes) -> tuple:
        media = write_payload(padded(text))
        picture = read_progressive(media)
        payload = payload_of(picture)
        return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(to_rgb(picture)))

    def run(batches):
        for batch in small_batches(batches):
            found = [digest(t.encode()) for t in batch.column(1).to_pylist()]
            yield record_batch(DIGEST, [batch.column(0), *map(list, zip(*found))])

    return doc_text(df, id_col, text_col).mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
