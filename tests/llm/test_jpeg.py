import hashlib
import random
import zlib

import numpy as np
import pytest

from quillstone.llm import jpeg
from tests.llm.conftest import ODD


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> (n - 1 - i) & 1 for i in range(n)]

    def value(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def bytes(self):
        return jpeg._packed(np.array(self.bits, np.uint8))


SYMBOLS = [r << 4 | s for r in range(16) for s in range(15)][:240]


def general_file(blocks, low, restart=0):
    """A grey file of 64-coefficient blocks in a row, by the plain procedures of the format."""
    n = len(blocks)
    flat = {s: 8 for s in SYMBOLS}
    code = {s: i for i, s in enumerate(sorted(flat))}
    out = [b"\xff\xd8", jpeg._segment(0xDB, bytes([0]) + bytes(range(1, 65))), jpeg._segment(0xC2, bytes([8, 0, 8, n * 8 >> 8, n * 8 & 255, 1, 1, 0x11, 0]))]
    out += [jpeg._segment(0xC4, jpeg._table(0, {s: 4 for s in range(12)}) + jpeg._table(16, flat))]
    if restart:
        out.append(jpeg._segment(0xDD, restart.to_bytes(2, "big")))
    step = restart or n

    def scan(first, last, before, at, body):
        parts = [body(blocks[i : i + step]) for i in range(0, n, step)]
        data = parts[0] + b"".join(bytes([255, 0xD0 + i % 8]) + p for i, p in enumerate(parts[1:]))
        out.extend([jpeg._start(b"\1", 0, first, last, before, at), data])

    def dc(part):
        w, last = Writer(), 0
        for b in part:
            v = (b[0] >> low) - last
            last = b[0] >> low
            w.put(abs(v).bit_length(), 4)
            w.value(v) if v else None
        return w.bytes()

    def ac(part):
        w, run = Writer(), 0

        def end():
            nonlocal run
            if run:
                k = run.bit_length() - 1
                w.put(code[k << 4], 8)
                w.put(run - (1 << k), k)
                run = 0

        for b in part:
            zeros = 0
            for k in range(1, 64):
                v = (abs(b[k]) >> low) * (1 if b[k] > 0 else -1)
                if not v:
                    zeros += 1
                    continue
                end()
                while zeros > 15:
                    w.put(code[0xF0], 8)
                    zeros -= 16
                w.put(code[zeros << 4 | abs(v).bit_length()], 8)
                w.value(v)
                zeros = 0
            run += zeros > 0
        end()
        return w.bytes()

    scan(0, 0, 0, low, dc)
    scan(1, 63, 0, low, ac)
    for at in range(low - 1, -1, -1):
        scan(0, 0, at + 1, at, lambda part: jpeg._packed(np.array([b[0] >> at & 1 for b in part], np.uint8)))

        def refine(part):
            w = Writer()
            for b in part:
                mags = [abs(v) >> at for v in b]
                final = max([k for k in range(1, 64) if mags[k] == 1], default=0)
                zeros, held = 0, []
                for k in range(1, 64):
                    if not mags[k]:
                        zeros += 1
                        continue
                    while zeros > 15 and k <= final:
                        w.put(code[0xF0], 8)
                        w.bits += held
                        zeros, held = zeros - 16, []
                    if mags[k] > 1:
                        held.append(mags[k] & 1)
                        continue
                    w.put(code[zeros << 4 | 1], 8)
                    w.put(int(b[k] > 0), 1)
                    w.bits += held
                    zeros, held = 0, []
                if zeros or held:
                    w.put(code[0], 8)
                    w.bits += held
            return w.bytes()

        scan(1, 63, at + 1, at, refine)
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("low, restart", [(0, 0), (1, 0), (2, 3), (3, 1)])
def test_general_files(low, restart):
    rng = random.Random(low)
    blocks = [[rng.choice([0, 0, 0, 0, 1, -1, 2, -3, 7, 40, -90]) if rng.random() < d else 0 for _ in range(64)] for d in (0, 0, 0.02, 0.1, 0.5, 1, 0, 1, 0.03, 0)]
    image = jpeg.Decoder(general_file(blocks, low, restart))
    assert (image.components[0].coefficients == np.array(blocks)).all()
    x = np.arange(8)
    block = np.zeros((8, 8))
    q = np.zeros(64)
    q[jpeg.ZIGZAG] = np.array(blocks[5]) * np.arange(1, 65)
    for u in range(8):
        for v in range(8):
            a = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
            block += a * q[8 * u + v] * np.outer(np.cos((2 * x + 1) * u * np.pi / 16), np.cos((2 * x + 1) * v * np.pi / 16))
    assert np.abs(image.rgb()[:, 40:48, 0] - np.clip(block + 128, 0, 255)).max() <= 1


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


@pytest.mark.parametrize("size", [64, 128, 384, 448, 64 * 100, 384 * 4000 + 64])
def test_round_trip(size):
    data = bytes(random.Random(size).choices(range(256), k=size))
    file = jpeg.encode(data)
    image = jpeg.Decoder(file)
    assert jpeg.payload(image) == data and image.rgb().shape == (image.height, image.width, 3)


def test_fast_scans_agree_with_plain_ones(monkeypatch):
    file = jpeg.encode(bytes(range(256)) * 3)
    fast = jpeg.Decoder(file)

    class Plain(jpeg.Huffman):
        def __init__(self, *a):
            super().__init__(*a)
            self.only = None

    monkeypatch.setattr(jpeg, "Huffman", Plain)
    plain = jpeg.Decoder(file)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, plain.components))


def test_odd_rows(spark, odd, none):
    got = {(r.doc_id, r.n_bytes): r for r in jpeg.digest(jpeg.tensors(jpeg.stored(odd))).collect()}
    for i, t in ODD:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        r = got[i, len(b)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[1, 0].media_sha256 == got[2, 0].media_sha256 and got[1, 0].feature == got[2, 0].feature
    assert jpeg.tensors(jpeg.stored(none)).count() == 0
