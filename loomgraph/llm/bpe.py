"""Byte-level BPE over whole columns of texts: padded numpy matrices of pre-tokens, merged in rounds.

The pre-tokens of a chunk of documents are made distinct and sorted by their length into matrices. In every round each
row merges its leftmost pair of least rank: pair ranks come from an open-addressing hash table of (left id,
right id), the merged cell takes the rank's id, and the cells behind it move one place left (compaction). Rows
without a pair leave the matrix. A pre-token that is itself in the vocabulary is its own id, as in the public library.

Nulls: a null text is empty and has no tokens. Repeated rows give repeated results. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomgraph.llm import common as C

NONE = np.int32(2**31 - 1)
#: Pre-tokens beyond so many bytes are merged one at a time.
WIDEST = 256
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Ranks:
    """A vocabulary of byte strings by rank, and the hash table of the pairs that merge. Fixed size, so it may be broadcast."""

    def __init__(self, ranks: dict[bytes, int]):
        most = max(ranks.values()) + 1
        self.pieces = [b""] * most
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary holds all 256 bytes")
        self.ranks = ranks
        keys, values = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left, ranked = np.array(keys, np.int64), np.array(values, np.int32)
        self.probes, slot = 0, self._slot(left)
        while len(left):  # a round places the first key that wants each free slot; the others try the next slot
            free = self.keys[slot] == -1
            chosen, first = np.unique(slot[free], return_index=True)
            at = np.flatnonzero(free)[first]
            self.keys[chosen], self.values[chosen] = left[at], ranked[at]
            rest = np.ones(len(left), bool)
            rest[at] = False
            left, ranked, slot = left[rest], ranked[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(C.BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    @classmethod
    def load(cls, path: str) -> Ranks:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())})


def merge(table: Ranks, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges a matrix (rows: pre-tokens of one length). Returns the ids row by row, -1 behind each end, and the rows' lengths."""
    n, width = ids.shape
    out = ids.astype(np.int32)
    lengths = np.full(n, width, np.int64)
    if width < 2 or not n:
        return out, lengths
    rows = np.arange(n)
    live = out.copy()
    ranks = table.pair(live[:, :-1].ravel(), live[:, 1:].ravel()).reshape(n, width - 1)
    while len(rows):
        at = ranks.argmin(axis=1)  # the first of equals: leftmost
        every = np.arange(len(rows))
        best = ranks[every, at]
        done = best == NONE
        if done.any():
            gone = rows[done]
            out[gone, : live.shape[1]] = live[done]
            out[gone, live.shape[1] :] = -1
            rows, live, ranks, at, best = (x[~done] for x in (rows, live, ranks, at, best))
            every = np.arange(len(rows))
            if not len(rows):
                break
        lengths[rows] -= 1
        wide = live.shape[1]
        if wide == 2:
            out[rows, 0], out[rows, 1:] = best, -1
            break
        live[every, at] = best
        keep = np.ones(live.shape, bool)
        keep[every, at + 1] = False
        live = live[keep].reshape(len(rows), wide - 1)
        keep = np.ones(ranks.shape, bool)
        keep[every, at] = False
        ranks = ranks[keep].reshape(len(rows), wide - 2)
        has = np.flatnonzero(at > 0)
        ranks[has, at[has] - 1] = table.pair(live[has, at[has] - 1], live[has, at[has]])
        has = np.flatnonzero(at < wide - 2)
        ranks[has, at[has]] = table.pair(live[has, at[has]], live[has, at[has] + 1])
    return out, lengths


def merge_long(table: Ranks, ids: list[int]) -> list[int]:
    """The same for one very long pre-token: a heap of pairs over a linked list."""
    import heapq

    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    first = table.pair(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
    heapq.heapify(heap)
    one = np.zeros(1, np.int64)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j] = rank, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := int(table.pair(one + ids[a], one + ids[b])[0])) != NONE:
                heapq.heappush(heap, (r, a, ids[a], ids[b]))
    return [x for x, ok in zip(ids, alive) if ok]


def encode_pieces(table: Ranks, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each pre-token, on end, and how many each has."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    counts = np.ones(len(pieces), np.int64)
    whole = np.array([table.ranks.get(p, -1) for p in pieces], np.int64)
    matrices: list[tuple[np.ndarray, np.ndarray]] = []
    for size in np.unique(sizes[whole < 0]).tolist():
        rows = np.flatnonzero((whole < 0) & (sizes == size))
        if size > WIDEST:
            for row in rows.tolist():
                ids = np.array(merge_long(table, table.single[np.frombuffer(pieces[row], np.uint8)].tolist()), np.int32)
                counts[row] = len(ids)
                matrices.append((np.array([row]), ids[None, :]))
            continue
        raw = np.frombuffer(b"".join([pieces[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), size)
        ids, counts[rows] = merge(table, table.single[raw])
        matrices.append((rows, ids))
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    own = whole >= 0
    out[(ends - counts)[own]] = whole[own]
    for rows, ids in matrices:
        row, column = np.nonzero(ids >= 0)
        out[(ends - counts)[rows][row] + column] = ids[row, column]
    return out, counts


def decode(table: Ranks, ids: np.ndarray) -> np.ndarray:
    """The bytes of a run of ids."""
    return table.bytes[C.ragged(table.starts[ids], table.lengths[ids])]


def encode_texts(table: Ranks, pattern: regex.Pattern, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, on end, and the offsets of each text (n + 1)."""
    import pandas as pd

    found: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = pattern.findall(text)
            counts[i] = len(own)
            found += own
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    codes, distinct = pd.factorize(np.array(found, object))
    ids, sizes = encode_pieces(table, [x.encode() for x in distinct])
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[codes]
    before = np.concatenate([[0], np.cumsum(lengths)])
    return ids[C.ragged(starts[codes], lengths)], before[np.concatenate([[0], np.cumsum(counts)])]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes the texts of docs(doc_id, text), decodes them again, and returns counts and digests (with_ids: the ids too)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(Ranks.load(path))  # a fixed public vocabulary
    compiled = regex.compile(pattern)

    def work(batch: pa.RecordBatch) -> dict:
        ranks = table.value
        ids, at = encode_texts(ranks, compiled, batch.column("text").to_pylist())
        raw = ids.astype("<u4")
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array(np.diff(at)),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in C.packed(raw, 4 * at)],
        }
        total = np.concatenate([[0], np.cumsum(ranks.lengths[ids])])
        out["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in C.packed(decode(ranks, ids), total[at])]
        if with_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
        return out

    return C.map_texts(docs.select("doc_id", "text"), SCHEMA + (", ids array<int>" if with_ids else ""), work, most=3 * C.CHUNK_BYTES)
