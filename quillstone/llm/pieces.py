"""Sampled segmentation into the pieces of a SentencePiece vocabulary, and its exact inverse.

A text's lattice has a node at every character and an edge for every piece; characters that are
no piece run through byte pieces.  Forward filtering sums the weights of all paths to each node;
backward sampling walks from the end, choosing each edge in proportion to the weight of the paths
through it.  So every segmentation is drawn with its probability under the pieces' weights, raised
to ``sharpness``.  A piece's weight falls with its rank in the vocabulary, as 1 / (2 + rank).

Two characters that are neighbours in no piece have no edge across, so a text falls into a chain of
parts there; the lattices of the distinct parts of some texts are filtered and sampled at once with
numpy.  The random numbers are a hash of seed, row key and place, hence equal
for a row wherever and whenever it is read.

Decoding joins the bytes of the pieces, and gives back every text exactly.

Cases: null text is empty and has no pieces; a null key counts as its own key; repeated rows get
the same pieces; a text of any length is one row, whose parts are filtered in groups, but whose pieces
are held together; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

#: Neighbours are looked up for characters below this; above it, texts are cut at blanks only.
LATIN = 0x250
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Of a byte piece; it competes with no other.
BYTE_WEIGHT = math.log(1e-5)
#: Codes of bytes follow the last character.  Weights are raised by so much per code, which leaves
#: the shares of segmentations as they are and their sums near one.
_BYTE, _TILT = 0x110000, 2.5


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Vocabulary:
    _shared: dict[str, "Vocabulary"] = {}

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface: list[bytes] = []
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.surface.append(text.encode())
                self.pieces[text] = (i, -math.log(2 + min(-model.get_score(i), 1e6)))
        #: Whether two characters are neighbours in a piece; the last row and column are for the others.
        self.joined = np.zeros((LATIN + 1, LATIN + 1), bool)
        self.joined[LATIN] = self.joined[:, LATIN] = True
        after_other = any(a != " " and b == " " for t in self.pieces for a, b in zip(t, t[1:]))
        self.joined[LATIN, 32] = after_other
        for text in self.pieces:
            for a, b in zip(text, text[1:]):
                self.joined[min(ord(a), LATIN), min(ord(b), LATIN)] = True

    def parts(self, text: str) -> list[str]:
        """The text cut wherever no piece can lie across."""
        if not text:
            return []
        c = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), LATIN)
        cut = np.flatnonzero(~self.joined[c[:-1], c[1:]]) + 1
        bounds = [0, *cut.tolist(), len(text)]
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    @classmethod
    def shared(cls, path: str) -> "Vocabulary":
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Sampler:
    """Samples many texts at once.  The lattices of their distinct parts are laid out as arrays: a
    node per code (a character, or a byte of one that is no piece), edges sorted by the node they
    enter, each with the summed share of the edges up to it."""

    _shared: dict[tuple[str, float], "Sampler"] = {}

    def __init__(self, vocabulary: Vocabulary, sharpness: float):
        self.vocabulary, self.longest = vocabulary, max(map(len, vocabulary.pieces))
        coded = {tuple(map(ord, t)): found for t, found in vocabulary.pieces.items()}
        coded |= {(_BYTE + b,): (i, BYTE_WEIGHT / sharpness) for b, i in vocabulary.bytes.items()}
        self.single = np.array(sorted(c[0] for c in coded if len(c) == 1))
        # by length: hashes of all beginnings of pieces, and for each its piece (or -1) and weight
        self.tables = []
        for n in range(1, self.longest + 1):
            starts = {c[:n] for c in coded if len(c) >= n}
            rows = sorted((self._hash(c), *coded.get(c, (-1, 0.0))) for c in starts)
            self.tables.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.exp(np.array([r[2] for r in rows]) * sharpness + _TILT * n)))
            if len(np.unique(self.tables[-1][0])) != len(rows):
                raise ValueError("two pieces have one hash")

    @staticmethod
    def _hash(codes: tuple[int, ...]) -> int:
        h = 0
        for c in codes:
            h = (h * int(_GOLD) + c + 1) % (1 << 64)
        return h

    @classmethod
    def shared(cls, path: str, sharpness: float) -> "Sampler":
        if (path, sharpness) not in cls._shared:
            cls._shared[path, sharpness] = cls(Vocabulary.shared(path), sharpness)
        return cls._shared[path, sharpness]

    def _codes(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all parts and where each part begins."""
        flat = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        begin = np.cumsum([0, *map(len, parts)])
        odd = ~np.isin(flat, self.single)
        if odd.any():
            spelled = {int(c): np.frombuffer(chr(c).encode(), np.uint8).astype(np.int64) + _BYTE for c in np.unique(flat[odd])}
            size = np.ones(len(flat), np.int64)
            size[odd] = [len(spelled[c]) for c in flat[odd].tolist()]
            at = np.concatenate([[0], np.cumsum(size)])
            out = np.repeat(flat, size)
            for i in np.flatnonzero(odd).tolist():
                out[at[i] : at[i + 1]] = spelled[int(flat[i])]
            flat, begin = out, at[begin]
        return flat, begin

    def _lattice(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Each part's last node; each node's first edge; edges' summed share, origin, piece."""
        code, begin = self._codes(parts)
        n = len(code)
        length = np.diff(begin)
        end = np.repeat(begin[1:], length)
        offset = np.arange(n) - np.repeat(begin[:-1], length)
        live, h = np.arange(n), np.zeros(n, np.uint64)
        into, origin, piece, weight = [], [], [], []
        for size, (hashes, ids, weights) in enumerate(self.tables, 1):
            inside = live + size <= end[live]
            live, h = live[inside], h[inside]
            if not len(live):
                break
            h = h * _GOLD + code[live + size - 1].astype(np.uint64) + np.uint64(1)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            known = hashes[k] == h
            live, h, k = live[known], h[known], k[known]
            whole = ids[k] >= 0
            into.append(live[whole] + size - 1)
            origin.append(live[whole] - 1)
            piece.append(ids[k[whole]])
            weight.append(weights[k[whole]])
        into, origin, piece, weight = map(np.concatenate, (into, origin, piece, weight))
        order = np.lexsort((-origin, into))  # short edges first
        into, origin, piece, weight = into[order], origin[order], piece[order], weight[order]
        start = offset[origin + 1] == 0  # the edge leaves the part's beginning
        # forward filtering: all nodes at one distance from their parts' beginnings at a time
        first = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
        degree = np.diff(np.append(first, len(into)))
        rank = np.arange(len(into)) - np.repeat(first, degree)
        alpha = np.zeros(n)
        share = np.empty(len(into))
        by_step = np.argsort(offset[into], kind="stable")
        bounds = np.searchsorted(offset[into][by_step], np.arange(int(length.max()) + 1))
        for step in range(len(bounds) - 1):
            e = by_step[bounds[step] : bounds[step + 1]]
            p = np.where(start[e], 1.0, alpha[origin[e]]) * weight[e]
            if step >= self.longest:
                p = np.where(start[e], 0.0, p)
            heads = np.flatnonzero(rank[e] == 0)
            total = np.add.reduceat(p, heads)
            node = into[e[heads]]
            share[e] = p / np.repeat(total, np.diff(np.append(heads, len(e))))
            alpha[node] = total
            if step % 32 == 31:  # only ratios matter: bring each part's newest nodes back to one
                for back in range(min(self.longest, step + 1) - 1, -1, -1):
                    alpha[node - back] /= total
        for k in range(1, int(degree.max())):
            at = np.flatnonzero(rank == k)
            share[at] += share[at - 1]
        share[np.append(first[1:], len(into)) - 1] = 2.0
        edge = np.zeros(n, np.int64)
        edge[into[first]] = first
        return begin[1:] - 1, edge, share, np.where(start, -1, origin), piece

    def encode_all(self, texts: list[str], keys: np.ndarray) -> list[bytes]:
        """Piece numbers of each text as little-endian uint32; ``keys``: uint64 per text."""
        parts = [self.vocabulary.parts(t) for t in texts]
        known: dict[str, int] = {}
        number = np.array([known.setdefault(x, len(known)) for p in parts for x in p], np.int64)
        if not len(number):
            return [b""] * len(texts)
        last, first, share, origin, piece = self._lattice(list(known))
        sizes = np.array([len(p) for p in parts])
        node = last[number]
        ordinal = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = mix(np.repeat(keys, sizes) + ordinal.astype(np.uint64) * _GOLD)
        live, steps, counts = np.arange(len(node)), [], np.zeros(len(node), np.int64)
        step = 0
        while len(live):
            u = (mix(key + np.uint64(step * int(_GOLD) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first[node]
            on = np.flatnonzero(u >= share[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= share[edge[on]]]
            steps.append((live, piece[edge]))
            counts[live] += 1
            node = origin[edge]
            left = node >= 0
            live, node, key = live[left], node[left], key[left]
            step += 1
        stop = np.cumsum(counts)
        out = np.empty(int(stop[-1]), "<u4")
        for k, (which, pieces) in enumerate(steps):
            out[stop[which] - 1 - k] = pieces
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        cut = np.concatenate([[0], stop])[bounds]
        return [out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]


def row_keys(ids: pa.Array, seed: int) -> np.ndarray:
    whole = ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
    return mix(whole * _GOLD + np.uint64(seed) + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))


def encode(docs: DataFrame, model_path: str, seed: int = 1, sharpness: float = 1.0) -> DataFrame:
    """``doc_id, ids``: one sampled segmentation of each text, as little-endian uint32."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler.shared(model_path, sharpness)
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), row_keys(batch.column(0), seed)
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) < 1_000_000):
                    size += len(texts[b])
                    b += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sampler.encode_all(texts[a:b], keys[a:b]), pa.binary())], schema=schema)
                a = b

    return common.mapped(common.texts(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, text``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.shared(model_path)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                texts = [vocabulary.decode(i).decode() for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=schema)

    return common.mapped(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("decoded_sha256"),
    )
