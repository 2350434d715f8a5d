"""Progressive JPEG: a decoder for any file of the kind, and a lossless store of bytes in it.

Decoding accumulates the scans (spectral selection and successive approximation) into one array of
coefficients per component, inverse-transforms all blocks by one matrix product, repeats chroma to
full size and converts to RGB.  Where the Huffman table of a scan leaves no choice (one symbol, and
so a fixed number of bits for every coefficient), the scan is read as an array; else symbol by
symbol.

A payload is stored in the format's own unit, the quantised coefficient: a byte is the eight
additional bits of a coefficient of category 8 (-255..-128, 128..255), 64 bytes are one 8x8 block,
and six blocks one unit of a 4:2:0 image (four Y, one Cb, one Cr), zeros filling the last one.  A
first pass of scans carries the upper bits, a second refines them.  A comment holds the length.

Cases of the operators: null text is empty and has a payload of 64 zeros; null ids stay null; equal
texts give equal files, tensors and features; a text of any length is one file, one task holding its
coefficients (two bytes a byte) and tensor (two bytes a byte, three channels) at a time; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common


def _zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in the order of the format."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_k, _x = np.arange(8)[:, None], np.arange(8)[None]
_COS = np.where(_k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _x + 1) * _k * np.pi / 16)
#: From 64 coefficients in the order of the format to 64 samples.
INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    wide: int = 0  # blocks of the component itself
    high: int = 0
    full: int = 0  # blocks a row holds in interleaved scans
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


class Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols = symbols
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None
        self.codes: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1


class Bits:
    """Bits of one restart interval, stuffing removed."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = int.from_bytes(data, "big"), 0, 8 * len(data)

    def take(self, n: int) -> int:
        self.at += n
        if self.at > self.size:
            raise ValueError("the scan ends early")
        return (self.data >> (self.size - self.at)) & ((1 << n) - 1)

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table.codes:
                return table.codes[length, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


class Decoder:
    """Coefficients, size and comment of a progressive file."""

    def __init__(self, data: bytes):
        self.tables: dict[int, np.ndarray] = {}
        self.huffman: dict[int, Huffman] = {}
        self.components: list[Component] = []
        self.comment, self.restart = b"", 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            kind = data[at + 1]
            if kind == 0xD9:
                return
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.tables[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                    body = body[1 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = Huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xC2:
                self._frame(body)
            elif kind in (0xC0, 0xC1) or 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive Huffman file")
            elif kind == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif kind == 0xFE:
                self.comment = body
            elif kind == 0xDA:
                at = self._scan(body, data, at)

    def _frame(self, body: bytes) -> None:
        if body[0] != 8:
            raise ValueError("only 8-bit samples are read")
        self.height, self.width, n = struct.unpack(">HHB", body[1:6])
        self.components = [Component(i, hv >> 4, hv & 15, t) for i, hv, t in struct.iter_unpack("BBB", body[6 : 6 + 3 * n])]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.wide, c.high = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.full = self.across * c.h
            c.coefficients = np.zeros((c.full * self.down * c.v, 64), np.int32)

    def _order(self, parts: list[Component]) -> list[np.ndarray]:
        """For each component the block numbers in the order of the scan, a row per unit."""
        if len(parts) == 1:
            c = parts[0]
            return [(np.arange(c.high)[:, None] * c.full + np.arange(c.wide)).reshape(-1, 1)]
        y, x = np.divmod(np.arange(self.across * self.down), self.across)
        return [np.stack([(y * c.v + i) * c.full + x * c.h + j for i in range(c.v) for j in range(c.h)], 1) for c in parts]

    def _scan(self, body: bytes, data: bytes, at: int) -> int:
        end = at
        while True:
            end = data.index(b"\xff", end)
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
            else:
                break
        n = body[0]
        picked = [(next(c for c in self.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
        first, last, approx = body[1 + 2 * n : 4 + 2 * n]
        before, low = approx >> 4, approx & 15
        parts = [c for c, _ in picked]
        order = self._order(parts)
        units = len(order[0])
        step = self.restart or units
        raw = data[at:end]
        pieces, a = [], 0
        for _ in range(0, units - step, step):  # markers are the only FF D0..D7 there
            b = a
            while True:
                b = raw.index(b"\xff", b)
                if 0xD0 <= raw[b + 1] <= 0xD7:
                    break
                b += 2
            pieces.append(raw[a:b])
            a = b + 2
        pieces.append(raw[a:])
        for k, piece in enumerate(pieces):
            own = [o[k * step : (k + 1) * step] for o in order]
            piece = piece.replace(b"\xff\x00", b"\xff")
            if first == 0 and before == 0:
                self._dc(Bits(piece), picked, own, low)
            elif first == 0:
                blocks = np.concatenate([np.column_stack([np.full(o.size // len(own[0]) * len(o), i), o.reshape(-1)]) for i, o in enumerate(own)]) if len(own) == 1 else None
                bits = np.unpackbits(np.frombuffer(piece, np.uint8)).astype(np.int32)
                if blocks is not None:
                    parts[0].coefficients[blocks[:, 1], 0] |= bits[: len(blocks)] << low
                else:
                    per = sum(o.shape[1] for o in own)
                    grid = bits[: per * len(own[0])].reshape(-1, per)
                    j = 0
                    for c, o in zip(parts, own):
                        c.coefficients[o, 0] |= grid[:, j : j + o.shape[1]] << low
                        j += o.shape[1]
            else:
                table = self.huffman[16 | picked[0][1] & 15]
                (self._ac_refine if before else self._ac)(piece, parts[0].coefficients, own[0][:, 0], table, first, last, low)
        return end

    def _dc(self, bits: Bits, picked: list, order: list[np.ndarray], low: int) -> None:
        tables = [self.huffman[t >> 4].codes for _, t in picked]
        values = [[] for _ in picked]
        last = [0] * len(picked)
        widths = [o.shape[1] for o in order]
        text = f"{bits.data:0{bits.size}b}" if bits.size else ""
        at = 0
        for _ in range(len(order[0])):
            for i, wide in enumerate(widths):
                codes = tables[i]
                for _ in range(wide):
                    length = 1
                    code = text[at] == "1"
                    while (length, code) not in codes:
                        code = code << 1 | (text[at + length] == "1")
                        length += 1
                        if length > 16:
                            raise ValueError("no such code")
                    n = codes[length, code]
                    at += length
                    if n:
                        v = int(text[at : at + n], 2)
                        at += n
                        last[i] += v if v >> (n - 1) else v - (1 << n) + 1
                    values[i].append(last[i])
        for (c, _), o, v in zip(picked, order, values):
            c.coefficients[o, 0] = np.array(v, np.int32).reshape(o.shape) << low

    def _ac(self, piece: bytes, out: np.ndarray, blocks: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
        band = last - first + 1
        if table.only is not None and 0 < table.only < 16:  # every coefficient takes the same bits
            size = table.only
            bits = np.frombuffer(piece, np.uint8)
            if size == 7:
                v = bits[: len(blocks) * band].astype(np.int32)
            else:
                v = np.unpackbits(bits)[: len(blocks) * band * (1 + size)].reshape(-1, 1 + size).astype(np.int32) @ (1 << np.arange(size, -1, -1))
            if (v >> size).any():
                raise ValueError("no such code")
            v = np.where(v >> (size - 1), v, v - (1 << size) + 1)
            out[blocks[:, None], np.arange(first, last + 1)] = v.reshape(-1, band) << low
            return
        bits, run = Bits(piece), 0
        for b in blocks:
            if run:
                run -= 1
                continue
            k = first
            while k <= last:
                r, s = divmod(bits.symbol(table), 16)
                if s:
                    k += r
                    out[b, k] = bits.signed(s) * (1 << low)
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) + (bits.take(r) if r else 0) - 1
                    break

    def _ac_refine(self, piece: bytes, out: np.ndarray, blocks: np.ndarray, table: Huffman, first: int, last: int, low: int) -> None:
        band = last - first + 1
        part = out[blocks, first : last + 1]
        if table.only == 0 and part.all():  # each block is an end of block and a correction for all
            bits = np.unpackbits(np.frombuffer(piece, np.uint8))[: len(blocks) * (1 + band)].reshape(-1, 1 + band)
            if bits[:, 0].any():
                raise ValueError("no such code")
            out[blocks, first : last + 1] = part + np.sign(part) * (bits[:, 1:].astype(np.int32) << low)
            return
        bits, run, one = Bits(piece), 0, 1 << low

        def correct(b: int, k: int) -> None:
            if bits.take(1):
                out[b, k] += one if out[b, k] > 0 else -one

        for b in blocks:
            k = first
            while k <= last and not run:
                r, s = divmod(bits.symbol(table), 16)
                if not s and r < 15:
                    run = (1 << r) + (bits.take(r) if r else 0)
                    break
                new = (one if bits.take(1) else -one) if s else 0
                while k <= last:
                    if out[b, k]:
                        correct(b, k)
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                if new and k <= last:
                    out[b, k] = new
                k += 1
            if run:
                for j in range(k, last + 1):
                    if out[b, j]:
                        correct(b, j)
                run -= 1

    def rgb(self) -> np.ndarray:
        """Samples (height, width, 3); grey files have three equal channels."""
        planes = []
        for c in self.components:
            flat = (c.coefficients.astype(np.float32) * self.tables[c.table]) @ INVERSE
            plane = np.clip(np.rint(flat + 128), 0, 255).reshape(-1, c.full, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * c.full)
            if (c.v, c.h) != (self.v, self.h):
                plane = plane.repeat(self.v // c.v, 0).repeat(self.h // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][..., None], 3, 2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, kind, len(body) + 2) + body


def _table(number: int, lengths: dict[int, int]) -> bytes:
    """A Huffman table by code lengths of symbols."""
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return bytes([number]) + counts + bytes(sorted(lengths, key=lambda s: (lengths[s], s)))


#: Components are Y (2x2), Cb and Cr; table 0 codes the differences of the first coefficients, 16
#: one symbol of category 7 and 17 the end of a block.
_DC = {s: 4 for s in range(9)}
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1]) * 64)
_TABLES = _segment(0xC4, _table(0, _DC) + _table(16, {7: 1}) + _table(17, {0: 1}))
_PARTS = (slice(0, 4), slice(4, 5), slice(5, 6))


def _start(parts: bytes, tables: int, first: int, last: int, before: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p, tables]) for p in parts) + bytes([first, last, before << 4 | low]))


def _packed(bits: np.ndarray) -> bytes:
    """Bits filled up with ones, FF stuffed."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def encode(payload: bytes) -> bytes:
    """A file whose coefficients are the bytes; their number is a positive multiple of 64."""
    n = len(payload)
    if not n or n % 64:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    units = -(-n // 384)
    across = -(-units // 4000)
    down = -(-units // across)
    b = np.zeros((across * down, 6, 64), np.uint8)
    b.reshape(-1)[:n] = np.frombuffer(payload, np.uint8)
    out = [_HEAD, _segment(0xFE, b"payload %d" % n), _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES]
    dc = b[:, :, 0].astype(np.int32)
    dc = np.where(dc < 128, dc - 255, dc)
    high = dc >> 1
    step = np.empty_like(high)
    for p in _PARTS:
        flat = high[:, p].reshape(-1)
        step[:, p] = np.diff(flat, prepend=0).reshape(step[:, p].shape)
    step = step.reshape(-1)
    size = np.ceil(np.log2(np.abs(step) + 1)).astype(np.int32)
    extra = np.where(step < 0, step + (1 << size) - 1, step)
    word = (size << size) | extra  # four bits of code, then the additional ones
    length = size + 4
    shift = length[:, None] - 1 - np.arange(12)
    bits = ((word[:, None] >> np.maximum(shift, 0)) & 1).astype(np.uint8)[shift >= 0]
    out += [_start(b"\1\2\3", 0, 0, 0, 0, 1), _packed(bits)]
    grid = b.reshape(down, across, 6, 64)
    own = [np.ascontiguousarray(grid[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4)).reshape(-1, 64), grid[:, :, 4].reshape(-1, 64), grid[:, :, 5].reshape(-1, 64)]
    for first, last in ((1, 5), (6, 63)):
        for k, x in enumerate(own):
            out += [_start(bytes([k + 1]), 0, first, last, 0, 1), (x[:, first : last + 1] >> 1).tobytes()]
    out += [_start(b"\1\2\3", 0, 0, 0, 1, 0), _packed((dc & 1).astype(np.uint8).reshape(-1))]
    for k, x in enumerate(own):
        low = (x & 1) ^ (x < 128)
        low[:, 0] = 0  # the code of the end of a block
        out += [_start(bytes([k + 1]), 1, 1, 63, 1, 0), np.packbits(low.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")]
    return b"".join(out) + b"\xff\xd9"


def payload(image: Decoder) -> bytes:
    """The bytes that ``encode`` stored."""
    n = int(image.comment.removeprefix(b"payload "))
    y, cb, cr = (c.coefficients.reshape(image.down, -1, 64) for c in image.components)
    y = image.components[0].coefficients.reshape(image.down, 2, image.across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(image.down, image.across, 4, 64)
    grid = np.concatenate([y, cb[:, :, None], cr[:, :, None]], 2)
    return (np.where(grid < 0, grid + 255, grid)).astype(np.uint8).tobytes()[:n]


def feature(rgb: np.ndarray) -> str:
    """Size, mean colour and a 64-bit hash of which cells of an 8x8 grid are lighter than the mean."""
    h, w, _ = rgb.shape
    colour = [int(x) for x in rgb.reshape(-1, 3).mean(0)]
    rows = np.add.reduceat(rgb.sum(2, dtype=np.int64), np.arange(8) * h // 8, 0)
    cells = np.add.reduceat(rows, np.arange(8) * w // 8, 1)
    bits = np.packbits((cells * 64 > cells.sum()).reshape(-1)).tobytes().hex()
    return f"{w}x{h}:{colour[0]:02x}{colour[1]:02x}{colour[2]:02x}:{bits}"


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_TENSOR = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("feature", pa.string())])


def _blocks(schema: pa.Schema, rows: Iterator[tuple], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    block, size = [], 0
    for row in rows:
        block.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > most or len(block) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)
            block, size = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text as a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    yield i, len(text), encode(text + bytes(-len(text) % 64 if text else 64))

        yield from _blocks(_MEDIA, rows())

    return common.mapped(common.texts(docs), run, "doc_id long, n_bytes long, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """Reads files back: ``doc_id, n_bytes, media, payload, height, width, rgb, feature``; ``rgb``
    holds height x width x 3 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i, n, file in zip(*(c.to_pylist() for c in batch.columns)):
                    image = Decoder(file)
                    rgb = image.rgb()
                    yield i, n, file, payload(image), rgb.shape[0], rgb.shape[1], rgb.tobytes(), feature(rgb)

        yield from _blocks(_TENSOR, rows())

    return common.mapped(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary, feature string")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
