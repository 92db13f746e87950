"""Byte-level BPE encoding and decoding, merging over a segment tree.

The tree stands over the byte positions of a piece. A leaf has the rank of the pair that
starts there, an inner node the smallest rank below it, so the leftmost minimum is found
by descending from the root. A merge makes one position dead and changes the pairs of
two live neighbours: three point updates of logarithmic cost, whatever the piece's length.
Short pieces, nearly all, are merged in step over many trees at once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import small_batches, tidy
from scholium.llm.packing import spaced

#: Entries of each of a worker's two caches, of pieces and of chunks of text, and their longest entry.
CACHE, CHUNK = 150_000, 32
NONE = 1 << 60


def load_ranks(definition: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, definition.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of smallest rank is merged until no pair has a rank."""
    known = ranks.get(piece)
    if known is not None:
        return [known]
    n = len(piece)
    get = ranks.get
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for p in range(size - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours

    def put(at: int, rank: int) -> None:
        p = size + at
        tree[p] = rank
        while p > 1:
            p >>= 1
            a, b = tree[2 * p], tree[2 * p + 1]
            least = a if a <= b else b
            if tree[p] == least:
                break
            tree[p] = least

    while (least := tree[1]) < NONE:
        p = 1
        while p < size:
            p *= 2
            if tree[p] != least:
                p += 1
        i = p - size
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
        if tree[size + j] != NONE:
            put(j, NONE)
        put(i, get(piece[i : after[end]], NONE) if end < n else NONE)
        if (k := before[i]) >= 0:
            put(k, get(piece[k:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Merger:
    """merge() for many short pieces at once: one segment tree for each, all in step.

    Live parts are token ids, so that the rank of a pair is looked up by two ids.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [
            (x << 32 | y, r) for t, r in ranks.items() for i in range(1, len(t))
            if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.keys, self.values = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where they don't merge or an id is below 0."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], NONE)

    def merge(self, pieces: list[bytes], levels: int) -> list[bytes]:
        """Ids of pieces of 2 to 2 ** levels bytes."""
        size, rows = 1 << levels, np.arange(len(pieces))
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), size + 1), -1, np.int64)  # one more: where the end of a piece points
        inside = np.arange(size + 1) < n[:, None]
        ids[inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.tile(np.arange(1, size + 2), (len(pieces), 1)), n[:, None])
        before = np.tile(np.arange(-1, size), (len(pieces), 1))
        tree = np.full((len(pieces), 2 * size), NONE, np.int64)
        tree[:, size:] = self.pair(ids[:, :-1], ids[:, 1:])
        for p in range(size - 1, 0, -1):
            tree[:, p] = np.minimum(tree[:, 2 * p], tree[:, 2 * p + 1])

        def put(r: np.ndarray, at: np.ndarray, rank) -> None:
            q = at + size
            tree[r, q] = rank
            for _ in range(levels):
                q >>= 1
                tree[r, q] = np.minimum(tree[r, 2 * q], tree[r, 2 * q + 1])

        r = rows[tree[:, 1] < NONE]
        while len(r):
            least, p = tree[r, 1], np.ones(len(r), np.int64)
            for _ in range(levels):
                p *= 2
                p += tree[r, p] != least
            i = p - size
            j = after[r, i]
            end = after[r, j]
            ids[r, i], ids[r, j] = least, -1
            after[r, i] = end
            before[r, end] = i
            put(r, j, NONE)
            put(r, i, self.pair(ids[r, i], ids[r, end]))
            k = before[r, i]
            some = k >= 0
            put(r[some], k[some], self.pair(ids[r[some], k[some]], ids[r[some], i[some]]))
            r = r[tree[r, 1] < NONE]
        live = ids >= 0
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(4 * live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Codec:
    """Encodes texts to little-endian unsigned 32-bit ids and decodes them; caches what is frequent.

    Texts are cut at spaces into chunks, these by the pattern into pieces. Both caches
    stop growing when full; what isn't in them is worked out again for each batch.
    """

    def __init__(self, definition: bytes, pattern: str):
        self.ranks = load_ranks(definition)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.merger = Merger(self.ranks)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _merged(self, pieces: set[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        short: dict[int, list[str]] = {}
        for piece in pieces:
            data = piece.encode()
            known = self.ranks.get(data)
            if known is not None:
                out[piece] = known.to_bytes(4, "little")
            elif 2 <= len(data) <= 32:
                short.setdefault((len(data) - 1).bit_length(), []).append(piece)
            else:
                out[piece] = np.array(merge(data, self.ranks), "<u4").tobytes()
        for levels, some in short.items():
            for i in range(0, len(some), 4096):
                part = some[i : i + 4096]
                out.update(zip(part, self.merger.merge([x.encode() for x in part], levels), strict=True))
        return out

    @staticmethod
    def _keep(cache: dict[str, bytes], new: dict[str, bytes]) -> None:
        for key, ids in new.items():
            if len(cache) >= CACHE:
                break
            if len(key) <= CHUNK:
                cache[key] = ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        known, pieces = self.chunks, self.pieces
        cut_up = [spaced(t) or [t] for t in texts]  # with white space that a cut could part, a text is one chunk
        new = {c: self.split(c) for c in {c for chunks in cut_up for c in chunks if c not in known}}
        fresh = self._merged({p for found in new.values() for p in found if p not in pieces})
        ids = {c: b"".join([pieces[p] if p in pieces else fresh[p] for p in found]) for c, found in new.items()}
        out = [b"".join([known[c] if c in known else ids[c] for c in chunks]) for chunks in cut_up]
        self._keep(pieces, fresh)
        self._keep(known, ids)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def codec(definition: bytes, pattern: str) -> Codec:
    """One for each worker process, kept over its tasks."""
    return Codec(definition, pattern)


def encoded(docs: DataFrame, definition: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row; ids are little-endian unsigned 32-bit integers in a binary column.

    Each match of pattern is encoded by itself, without special tokens. A NULL text is
    empty and has no ids. Rows are independent: repeated keys and rows stay as they are.
    """
    return _mapped(docs, definition, pattern, key, text, "ids binary", lambda c, ids: [ids])


def round_trip(docs: DataFrame, definition: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them."""

    def digest(c: Codec, ids: bytes) -> list:
        return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()]

    return _mapped(docs, definition, pattern, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def decoded(encoded: DataFrame, definition: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """encoded with a binary column ``decoded`` added: the bytes that the ids stand for. NULL stays NULL."""
    small_batches(encoded.sparkSession)
    shipped = encoded.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern)
        for batch in batches:
            out = [None if x is None else own.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(tidy(run), f"{fields}, decoded binary")


def _mapped(docs, definition, pattern, key, text, columns, make) -> DataFrame:
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(definition)  # one file of fixed size
    kind = docs.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]
    types = [{"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value, pattern)
        for batch in batches:
            rows = [make(own, ids) for ids in own.encode_all([t or "" for t in batch.column(1).to_pylist()])]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["key", *names])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, {columns}")
