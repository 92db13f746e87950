"""Packing token sequences into windows by minimum bin slack.

Documents longer than a window are cut into full windows and a rest. Which rests share a
window is decided on the histogram of their lengths, which has at most as many entries
as a window has tokens: the longest rest that is left opens a window, and dynamic
programming over a bitset of subset sums, a bit for each fill, finds the multiset of
remaining lengths that leaves the least slack; its counts are read back from the bitsets.
The same filling is used as often as the counts allow. Rests then find their place by
their rank among rests of their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholium.llm.common import cut, ranked, small_batches, tidy

WINDOW = 2048
END_ID = 1


#: How byte-level BPE splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranks_of(definition: dict) -> dict[bytes, int] | None:
    """Ranks of byte strings, if the definition is byte-level BPE by PATTERN and its ids follow the merges."""
    model, before = definition["model"], definition.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not definition.get("normalizer") and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    )
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary = model["vocab"]
    for i, merge in enumerate(model["merges"]):
        if vocabulary.get("".join(merge) if isinstance(merge, list) else merge.replace(" ", "")) != 256 + i:
            return None
    special = {t["content"] for t in definition.get("added_tokens", [])}
    return {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}


class Tokens:
    """Ids of whole texts as the tokenizers library gives them, as little-endian unsigned 32-bit integers.

    Definitions of plain byte-level BPE, whose ids are ranks, are run by tiktoken, which
    gives the same ids in a fraction of the time; others by the library itself. So are
    texts that hold the string of an added token, which the library gives the id of that
    token.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.definition, self._library = definition, None
        read = json.loads(definition)
        added = [t["content"] for t in read.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        ranks = ranks_of(read)
        self._ids = None
        if ranks:
            import tiktoken

            self._ids = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def by_library(self, texts: list[str]) -> list[bytes]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.definition)
        return [array("I", e.ids).tobytes() for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self._ids:
            return self.by_library(texts)
        return [self.by_library([t])[0] if self.added(t) else self._ids(t).astype("<u4").tobytes() for t in texts]


def spaced(text: str) -> list[str] | None:
    """The chunks of a text, each but the first with the space before it; None if it can't be cut safely."""
    parts = text.split(" ")
    for p in parts[:-1]:
        if not p or p[-1].isspace():
            return None
    return [parts[0], *[" " + p for p in parts[1:]]]


def pieces(docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): each document cut into full windows and a rest.

    A document is its text's ids and END_ID; a NULL text is empty and has END_ID alone.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(definition)  # one file of fixed size
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = Tokens(shipped.value), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            encoded = own.encode([t or "" for t in batch.column(1).to_pylist()])
            for i, ids in enumerate(encoded):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, window):
                    part = ids[4 * a : 4 * (a + window)]
                    rows.append((i, a, len(part) // 4, zlib.crc32(part), n))
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(cols[0]), *cols[1:]], ["key", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length give the largest sum of at most ``room``.

    Bit s of a bitset is set if the lengths so far can sum to s. A length with n copies
    is or-ed in as 1, 2, 4, ... copies; each step's bitset is kept to read the counts back.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        n = min(counts[length], room // length)
        k = 1
        while n > 0:
            take = min(k, n)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            n, k = n - take, 2 * k
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Fillings as (repeats, {length: copies}) that use up a histogram of lengths up to window.

    Their number has a bound that only the window sets. A filling is repeated until a
    length it has n copies of, n at most window / length, has fewer than n left; the same
    length can end as many fillings after that as it has copies left. So there are at
    most the sum over all lengths of 1 + window / length: about 18,000 for a window of 2048,
    however many documents there are.
    """
    left, out = {k: n for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill({k: n for k, n in left.items() if n and k <= window - longest}, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        for k, n in fill.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
        out.append((times, fill))
    return out


def pack(
    docs: DataFrame, definition: str, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    Sequence ids are gapless from 0, offsets gapless in each sequence. Only sequences that
    no filling of the lengths left can complete fall short of the window. Rows with equal
    keys are packed as documents of their own; an empty table gives an empty result. A NULL
    or empty text is END_ID alone. Columns of the input other than key and text aren't read.
    """
    cutout = cut(pieces(docs, definition, key, text, window))
    histogram = {r[0]: r[1] for r in cutout.groupBy("length").count().collect()}  # at most window rows
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = dict.fromkeys(histogram, 0), 0
    for times, fill in plan(histogram, window):
        offset = 0
        for length in sorted(fill, reverse=True):
            runs.setdefault(length, []).append((ranks[length], fill[length], sequence, offset))
            ranks[length] += times * fill[length]
            offset += length * fill[length]
        sequence += times
    shipped = docs.sparkSession.sparkContext.broadcast(runs)  # bounded by plan()'s number of fillings
    placed = ranked(cutout, ["length"], ["key", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {k: (np.array([x[0] for x in v]), np.array(v, np.int64)) for k, v in shipped.value.items()}
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequences, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                own = length == k
                firsts, rows = table[k]
                first, copies, seq, off = rows[np.searchsorted(firsts, rank[own], "right") - 1].T
                sequences[own] = seq + (rank[own] - first) // copies
                offsets[own] = off + (rank[own] - first) % copies * k
            out = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequences), pa.array(offsets)], [*names, "sequence_id", "offset"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cutout.schema)
    return placed.mapInArrow(tidy(run), f"{fields}, sequence_id long, offset long")
