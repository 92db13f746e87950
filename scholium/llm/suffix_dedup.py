"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first ``width`` bytes only, most significant digit first;
suffixes that are equal to that depth are the repeated windows. The digits are chosen so
that hardly any suffix needs more than the first:

1. Each window is represented by its anchor, the GRAM bytes in it with the least hash;
   neighbouring windows share one, and equal windows have equal anchors at equal places.
   Only anchors are sorted, about one for every thirteen suffixes. An anchor that no
   other document has settles all its windows.
2. The second digit is the cell, all bytes that an anchor's windows cover. Where cells
   are equal too, all their windows are.
3. Only where cells differ around one anchor - at the ends of a passage - are single
   windows sorted, by all their bytes.

Digits are compared by 48-bit hashes, both of them together for cells, and a window by 128
bits in the third pass. Each task first combines what it has itself: of rows that agree in
both digits only the smallest document's are sorted globally, so a passage that many
documents share sends one row a task. An anchor with very many different cells is dealt
by cell, and its windows one by one in pass 3; other cells are sent whole and compared
where all those of an anchor meet. Rows travel in compressed blocks, one for each task
and range of hashes, and are sorted by Spark, which spills, on the other side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut, small_batches, tidy

WIDTH, GRAM = 50, 20
#: Bytes of text handled at a time, and anchors that a task gathers before it combines and sends them.
BLOCK, GATHER = 1 << 19, 500_000
#: Different cells of one anchor in one gathering from which it is dealt by cell; cells of one
#: anchor in all from which their windows are sorted one by one.
MANY, HOT = 32, 2048
#: Ranges of hashes for each partition of the global sort, and in all: a block of rows goes to
#: each, so that more ranges would mean smaller blocks.
RANGES, MOST_RANGES = 16, 4096
#: Rows of one anchor that a task holds while more come; beyond it they are settled as they come.
HELD = 1 << 18
LAST = (1 << 63) - 1  # a NULL key counts as the largest
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BITS = np.uint64(16)  # what digits of 48 bits leave


def _mix(x: np.ndarray, y) -> np.ndarray:
    x = (x + y) * _C[1]
    x ^= x >> np.uint64(29)
    x *= _C[2]
    x ^= x >> np.uint64(32)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data as one number; data ends with 8 bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))


def _spans(words: np.ndarray, start: np.ndarray, length: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of the spans from start, each at least 8 bytes long."""
    x = seed.astype(np.uint64) * _C[0] + length.astype(np.uint64)
    for at in range(0, int(length.max(initial=0)), 8):
        on = at < length
        y = _mix(x, words[np.minimum(start + at, start + length - 8)])
        x = np.where(on, y, x)
    return x


def anchors(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(h, c, start, length) of the cells of texts that lie one after the other in data.

    ends: where each text ends. data has 8 bytes of padding. Windows don't cross texts.
    """
    total = int(ends[-1]) if len(ends) else 0
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    n = total - width + 1  # windows, those across texts included
    if n <= 0:
        return none
    words = _words(data)
    m = total - gram + 1
    h = np.zeros(m, np.uint64)
    for at in [*range(0, gram - 8, 8), gram - 8]:
        h = _mix(h, words[at : at + m])
    # Leftmost least gram of each window, by windows of 1, 2, 4, ... grams.
    value, place, span, need = h, np.arange(m, dtype=np.int32), 1, width - gram + 1
    while span < need:
        step = min(span, need - span)
        right = value[step:] < value[: len(value) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        value = np.minimum(value[step:], value[: len(value) - step])
        span += step
    valid = np.ones(n, bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - width + 1) : e] = False
    first = valid.copy()
    first[1:] &= (place[1:n] != place[: n - 1]) | ~valid[:-1]
    lo = np.flatnonzero(first)
    if not len(lo):
        return none
    final = valid.copy()
    final[:-1] &= (place[1:n] != place[: n - 1]) | ~valid[1:]
    hi = np.flatnonzero(final)
    at, length = place[lo].astype(np.int64), hi - lo + width
    return h[at], _spans(words, lo, length, at - lo), lo, length


def _block(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte integers, by planes of their bytes, compressed."""
    return zstandard.compress(b"".join(x.view("u1").reshape(-1, 8).T.tobytes() for x in columns), 1)


def _unblock(block: bytes) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(block), np.uint8).reshape(5, 8, -1)
    return [np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes]


def _combined(ranges: int, h, c, k, t, place) -> pa.RecordBatch:
    """Blocks of rows (h, c, k, t, place) to sort globally, by range of h.

    Rows whose (h, c) a smaller document of the task has, too, are known to go: they make
    a block of their own, with a place below 0 and no hashes.
    """
    order = np.lexsort((k, c, h)).astype(np.int32)
    h, c = h[order], c[order]
    new_h = np.r_[True, h[1:] != h[:-1]]
    new_v = new_h | np.r_[True, c[1:] != c[:-1]]
    k, t, place = k[order], t[order], place[order]
    gone = k > k[np.flatnonzero(new_v)][np.cumsum(new_v, dtype=np.int32) - 1]
    first = np.flatnonzero(new_h)
    many = np.add.reduceat(new_v, first, dtype=np.int32) >= MANY
    none = np.zeros(int(gone.sum()), np.int64)
    blocks = [(int(k[0]) % ranges, _block(none, none, k[gone], t[gone], -1 - place[gone]))] if len(none) else []
    marks = h[first[many]]
    dealt = many[np.cumsum(new_h, dtype=np.int32) - 1][~gone] if len(marks) else None
    if len(none):
        h, c, k, t, place = h[~gone], c[~gone], k[~gone], t[~gone], place[~gone]
    if len(marks):  # they tell the anchor's own group that it has more cells elsewhere
        zeros = np.zeros(len(marks), np.int64)
        h = np.r_[np.where(dealt, _mix(h, c) >> _BITS, h), marks]
        c, k, t = np.r_[c, zeros.view(np.uint64)], np.r_[k, np.full(len(marks), LAST)], np.r_[t, zeros]
        place = np.r_[np.where(dealt, place | 256, place), np.full(len(marks), 256)]
        order = np.argsort(h, kind="stable")
        h, c, k, t, place = h[order], c[order], k[order], t[order], place[order]
    at = (h >> np.uint64(16)).astype(np.int64) * ranges >> 32
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        step = np.diff(h[i:j].view(np.int64), prepend=0)
        blocks.append((int(at[i]), _block(step, c[i:j].view(np.int64), k[i:j], t[i:j], place[i:j])))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["range", "block"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column(1).to_pylist():
            h, c, k, t, place = _unblock(block)
            # Rows that are known to go stand anywhere but together.
            h = np.where(place < 0, _mix(k.astype(np.uint64), place.astype(np.uint64)).view(np.int64), np.cumsum(h))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, k, t, place)], ["h", "c", "k", "t", "place"])


class _Gather:
    """Gathers rows of a task in place until there are GATHER of them."""

    def __init__(self, ranges: int) -> None:
        self.rows = [np.empty(GATHER, kind) for kind in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
        self.n, self.ranges = 0, ranges

    def add(self, *row: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, size = 0, len(row[0])
        while at < size:
            n = min(GATHER - self.n, size - at)
            for own, x in zip(self.rows, row, strict=True):
                own[self.n : self.n + n] = x[at : at + n]
            self.n, at = self.n + n, at + n
            if self.n == GATHER:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield _combined(self.ranges, *(x[: self.n] for x in self.rows))
        self.n = 0


def _blocks(keys: list[int], texts: list[bytes], tags: list[int], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(data, ends, keys, tags, offsets) of about BLOCK bytes; longer texts come in parts that overlap by a window less one."""
    part: list[tuple[int, bytes, int, int]] = []
    size = 0

    def out():
        data = np.frombuffer(b"".join([*(p[1] for p in part), bytes(8)]), np.uint8)
        return data, np.cumsum([len(p[1]) for p in part]), *(np.array([p[i] for p in part], np.int64) for i in (0, 2, 3))

    for k, text, tag in zip(keys, texts, tags, strict=True):
        for at in range(0, max(1, len(text) - width + 1), BLOCK):
            t = text[at : at + BLOCK + width - 1] if len(text) > BLOCK else text
            part.append((k, t, tag, at))
            size += len(t)
            if size >= BLOCK:
                yield out()
                part, size = [], 0
    if part:
        yield out()


def _cells(width: int, gram: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = _Gather(ranges)
        for batch in batches:
            for data, ends, keys, tags, offsets in _blocks(*(batch.column(i).to_pylist() for i in range(3)), width):
                h, c, start, length = anchors(data, ends, width, gram)
                own = np.searchsorted(ends, start, "right")
                begin = np.r_[0, ends[:-1]]
                yield from gather.add(h >> _BITS, c >> _BITS, keys[own], tags[own], (start - begin[own] + offsets[own]) << 9 | length)
        yield from gather.flush()

    return run


def _expanded(data: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int):
    """(own, at, h, c) of the windows of spans of data: the span's number, the offset in it, and 128 bits."""
    n = length - width + 1
    own = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    words, start, size = _words(data), begin[own] + at, np.full(len(own), width, np.int64)
    h, c = (_spans(words, start, size, np.full(len(own), seed)) for seed in (1, 2))
    return own, at, h, c


def _asked(width: int, gram: int):
    """The cells that a text was asked for, by anchor; those of hot anchors as single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "c", "k", "t", "place", "cell"]
        for batch in batches:
            rows = [(k, t, x, text[(at := x >> 9) : at + (x & 255)]) for k, text, t, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) for x in asked]
            for i in range(0, len(rows), GATHER // 16):
                some = rows[i : i + GATHER // 16]
                k, t, place = (np.array([r[j] for r in some], np.int64) for j in range(3))
                data = np.frombuffer(b"".join([*(r[3] for r in some), bytes(8)]), np.uint8)
                ends = np.cumsum([len(r[3]) for r in some])
                h, _, start, _ = anchors(data, ends, width, gram)  # all windows of a cell have its anchor
                anchor = np.empty(len(k), np.uint64)
                anchor[np.searchsorted(ends, start, "right")] = h
                hot = np.flatnonzero(place & 256)
                cool = np.flatnonzero((place & 256) == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[cool].view(np.int64)), pa.array(np.zeros(len(cool), np.int64)), pa.array(k[cool]), pa.array(t[cool]), pa.array(place[cool]),
                     pa.array([some[j][3] for j in cool], pa.binary())], names)
                if not len(hot):
                    continue
                own, at, h, c = _expanded(data, (ends - np.diff(ends, prepend=0))[hot], place[hot] & 255, width)
                kk, tt, pp = k[hot][own], t[hot][own], ((place[hot][own] >> 9) + at << 9) | width
                order = np.lexsort((kk, c, h))
                h, c, kk, tt, pp = h[order], c[order], kk[order], tt[order], pp[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
                gone = kk > kk[new][np.cumsum(new) - 1]  # settled here: no need to meet the others
                h = np.where(gone, _mix(kk.astype(np.uint64), pp.astype(np.uint64)), h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(kk), pa.array(tt), pa.array(np.where(gone, -1 - pp, pp)), pa.nulls(len(kk), pa.binary())], names)

    return run


def _settled(width: int):
    """Over rows (h, c, k, t, place, cell) with all of an h together: the windows that a smaller document has."""

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, c, k, t, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        cells = batch.column(5).drop_null().to_pylist()
        whole = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
        single = ~whole
        data = np.frombuffer(b"".join([*cells, bytes(8)]), np.uint8)
        length = np.array([len(x) for x in cells], np.int64)
        own, at, h2, c2 = _expanded(data, np.cumsum(length) - length, length, width)
        known = single & (place < 0)
        single &= ~known
        h = np.r_[h[single].view(np.uint64), h2]
        c = np.r_[c[single].view(np.uint64), c2]
        start = np.r_[place[single] >> 9, (place[whole] >> 9)[own] + at]
        kk, tt = np.r_[k[single], k[whole][own]], np.r_[t[single], t[whole][own]]
        order = np.lexsort((kk, c, h))
        h, c, kk, tt, start = h[order], c[order], kk[order], tt[order], start[order]
        if len(h):
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            gone = kk > kk[new][np.cumsum(new) - 1]
            kk, tt, start = kk[gone], tt[gone], start[gone]
        kk, tt, start = np.r_[kk, k[known]], np.r_[tt, t[known]], np.r_[start, (-1 - place[known]) >> 9]
        return pa.RecordBatch.from_arrays([pa.array(kk), pa.array(tt), pa.array((start << 9) | width)], ["k", "t", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one h, which may go on
        for batch in batches:
            if not len(batch):
                continue
            h = batch.column(0).to_numpy()
            edges = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and held[0].column(0)[0].as_py() != h[0]:
                yield judged(pa.concat_batches(held))
                held = []
            if len(edges):
                yield judged(pa.concat_batches([*held, batch.slice(0, int(edges[-1]))]))
                held = []
            held.append(batch.slice(int(edges[-1]) if len(edges) else 0))
        if held:
            yield judged(pa.concat_batches(held))

    return run


def _judged(h, c, k, t, place, before: tuple[int, int] | None = None, hot_from: int | None = None):
    """Columns (k, t, span, ask) of rows sorted by (h, c, k): which go, and which are asked for.

    before: (c, least k) of the cell that rows before these ended with, of the first h;
    hot_from: that h, if it is known to have many cells.
    """
    known = place < 0
    back = -1 - place[known]
    out = [(k[known], t[known], back, np.zeros(len(back), bool))]
    h, c, k, t, place = h[~known], c[~known], k[~known], t[~known], place[~known]
    if len(h):
        new_h = np.r_[True, h[1:] != h[:-1]]
        new_v = new_h | np.r_[True, c[1:] != c[:-1]]
        leasts = k[new_v].copy()
        if before and h[0] == hot_from and c[0] == before[0]:
            leasts[0] = before[1]
        least = leasts[np.cumsum(new_v) - 1]
        first = np.flatnonzero(new_h)
        more = (np.maximum.reduceat(least, first) > np.minimum.reduceat(least, first)) | (np.maximum.reduceat(place & 256, first) > 0) | (h[first] == hot_from if hot_from is not None else False)
        real = (place & 255) > 0
        gone = (k > least) & real
        ask = (k == least) & real & more[np.cumsum(new_h) - 1]
        size = np.add.reduceat(ask.astype(np.int64), first)
        hot = (size > HOT) | (np.maximum.reduceat(place & 256, first) > 0) | (h[first] == hot_from if hot_from is not None else False)
        place = (place & ~256) | np.where(hot[np.cumsum(new_h) - 1] & ask, 256, 0)
        for pick, asked in ((gone, False), (ask, True)):
            out.append((k[pick], t[pick], place[pick], np.full(int(pick.sum()), asked)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in map(np.concatenate, zip(*out, strict=True))], ["k", "t", "span", "ask"])


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (h, c, k): which go, as their (h, c) is in a smaller document, and
    which are asked for their windows, as their h has another c with another first document.

    Rows of one h are held until all are there. From HELD rows on, if they have more than
    one cell, the h counts as hot and its rows are settled as they come.
    """
    held: list[list[np.ndarray]] = []
    before = hot_from = None

    def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
        return _judged(*cols, before, hot_from)

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if not len(cols[0]):
            continue
        edges = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        if held and held[0][0][0] != cols[0][0]:
            yield flush([np.concatenate(x) for x in zip(*held, strict=True)])
            held, before, hot_from = [], None, None
        if hot_from is not None and hot_from != cols[0][0]:
            before = hot_from = None
        if len(edges):
            at = int(edges[-1])
            yield flush([np.concatenate(x) for x in zip(*held, [c[:at] for c in cols], strict=True)])
            held, before, hot_from = [], None, None
            cols = [c[at:] for c in cols]
        held.append(cols)
        if sum(len(x[0]) for x in held) >= HELD or hot_from is not None:
            h, c, k, t, place = (np.concatenate(x) for x in zip(*held, strict=True))
            if hot_from is not None or c[0] != c[-1]:
                hot_from = h[0]
                yield _judged(h, c, k, t, place, before, hot_from)
                if not (before and before[0] == c[-1]):
                    before = (c[-1], k[np.searchsorted(c, c[-1])])
                held = []
    if held:
        yield flush([np.concatenate(x) for x in zip(*held, strict=True)])


def merged(spans: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (starts, ends) of spans given as start << 9 | length; runs that touch are one."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = np.sort(np.array(spans, np.int64))
    start, end = x >> 9, np.maximum.accumulate((x >> 9) + (x & 255))
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[new[1:], True]]


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[Column, Column, Column]:
    """Columns k, the key as a number; t, which tells apart different texts of one key, else 0; and the bytes of the text."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    k = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    by = docs.select(k.alias("k"), F.xxhash64(data).alias("t")).groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    if by.where("a != b").isEmpty():
        return k, F.lit(0).cast("long"), data
    return k, F.xxhash64(data), data


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, carry: list[Column] | None = None):
    """(rows, spans): docs as (k, t, data, c0, c1, ...), and for each (_k, _t) with any the list of covered spans.

    A span is start << 9 | length in bytes: every byte of it lies in a string of ``width``
    bytes that also starts in a text with a smaller key. Texts with equal keys are no
    smaller than each other; a NULL key counts as the largest 64-bit integer; NULL texts
    are empty. c0, c1, ... are the columns to carry along.
    """
    if not 16 <= gram < width <= 128:
        raise ValueError("16 <= gram < width <= 128")
    spark = docs.sparkSession
    small_batches(spark)
    k, t, data = _keyed(docs, key, text)
    texts = docs.select(k.alias("k"), data.alias("data"), t.alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(RANGES * parts, MOST_RANGES)
    blocks = texts.mapInArrow(tidy(_cells(width, gram, ranges)), "range int, block binary").repartition(parts, "range")
    rows = blocks.mapInArrow(tidy(_opened), "h long, c long, k long, t long, place long").sortWithinPartitions("h", "c", "k")
    found = cut(rows.mapInArrow(tidy(_reduced), "k long, t long, span long, ask boolean"))
    # Both uses of the rows by key below are one exchange, as they read the same columns.
    along = [c.alias(f"c{i}") for i, c in enumerate(carry or [])]
    dealt = docs.select(k.alias("k"), t.alias("t"), data.alias("data"), *along).repartition(parts, "k", "t")
    asked = _listed(found.where("ask"), "asked")
    cells = dealt.join(asked, [dealt["k"] == asked["_k"], dealt["t"] == asked["_t"]])
    cells = cells.select("k", "data", "t", "asked", *[f"c{i}" for i in range(len(along))]).mapInArrow(tidy(_asked(width, gram)), "h long, c long, k long, t long, place long, cell binary")
    settled = cells.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(_settled(width)), "k long, t long, span long")
    spans = found.where("not ask").select("k", "t", "span").union(settled)
    return dealt, _listed(spans, "spans")


def _listed(spans: DataFrame, name: str) -> DataFrame:
    """A row for each text with its spans; there are no more than the text has windows."""
    return spans.groupBy(F.col("k").alias("_k"), F.col("t").alias("_t")).agg(F.collect_list("span").alias(name))


def _kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))


def _digested(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for data, spans in batches:
        rows = []
        for x, found in zip(data.to_pylist(), spans.to_pylist(), strict=True):
            starts, ends = merged(found)
            rows.append((len(x), int((ends - starts).sum()), len(starts), hashlib.sha256(_kept(x, starts, ends)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 3, pa.string()], strict=True)], ["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cleaned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for data, spans in batches:
        # A cut inside a character takes the rest of it along.
        yield pa.array([_kept(x, *merged(found)).decode("utf-8", "ignore") if found else x.decode() for x, found in zip(data.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def _over(docs: DataFrame, key: str, text: str, width: int, run, kind: str, carry: list[Column]) -> DataFrame:
    """(out, c0, c1, ...) of docs; only the bytes and spans of a text go to the Python worker."""
    dealt, spans = repeated_spans(docs, key, text, width, carry=carry)
    each = tidy(run)
    each.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    joined = dealt.join(spans, [dealt["k"] == spans["_k"], dealt["t"] == spans["_t"]], "left")
    return joined.select(F.arrow_udf(each, kind)("data", "spans").alias("out"), *[f"c{i}" for i in range(len(carry))])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    Repeated rows are judged alike, each with its row; an empty table gives an empty
    result. The order among texts is that of their keys, which must be integers; ties
    leave both. Columns travel under names of their own, so none of the input can clash.
    """
    out = _over(docs, key, text, width, _digested, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", [F.col(key)])
    return out.select(F.col("c0").alias("key"), "out.*")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with repeated bytes removed from the texts; NULL texts stay NULL, all rows and columns stay."""
    rest = [c for c in docs.columns if c != text]
    out = _over(docs, key, text, width, _cleaned, "string", [F.col(text).isNull(), *[F.col(c) for c in rest]])
    own = {c: F.col(f"c{i}") for i, c in enumerate(rest, 1)} | {text: F.when(~F.col("c0"), F.col("out"))}
    return out.select(*[own[c].alias(c) for c in docs.columns])
