"""Token counts by a linear longest-match automaton over a byte vocabulary.

A word is read as one space and its bytes, and split greedily into the longest vocabulary entries. The trie of the
vocabulary gets, for every node, a failure link (the node that is reached once the longest matched entries at its start
are popped) and the number of entries popped on the way, so each byte is read once and no pieces are built. Words of a
chunk are made distinct by hash and walk the automaton in lockstep, one byte a step.

Nulls: a null text has no words. Words are [^\\x20\\x09-\\x0D]+. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import common as C

#: Longer words walk alone.
WIDEST = 128
ROOT = 0
SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint, longest_word_tokens bigint"


class Automaton:
    """Trie, failure links and pop counts; children are looked up in an open-addressing table of (node, byte)."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        accepts = [False]
        for piece in vocabulary:
            node = ROOT
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    accepts.append(False)
                node = children[node][byte]
            accepts[node] = bool(piece)
        if not all(b in children[ROOT] and accepts[children[ROOT][b]] for b in range(256)):
            raise ValueError("the vocabulary must hold all 256 bytes: else a word may have no split")
        n = len(children)
        fail, pops = [-1] * n, [0] * n
        level = [ROOT]
        while level:  # breadth first: links lead to shallower nodes
            following = []
            for parent in level:
                for byte, node in children[parent].items():
                    if accepts[node]:
                        fail[node], pops[node] = ROOT, 1
                    else:
                        state, count = fail[parent], pops[parent]
                        while state >= 0 and byte not in children[state]:
                            count += pops[state]
                            state = fail[state]
                        fail[node], pops[node] = (children[state][byte], count) if state >= 0 else (-1, count)
                    following.append(node)
            level = following
        self.children = children
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        keys = np.array([node << 8 | byte for node, own in enumerate(children) for byte in own], np.int64)
        values = np.array([child for own in children for child in own.values()], np.int32)
        self.bits = (4 * len(keys) - 1).bit_length()
        self.keys, self.values, self.probes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            chosen, first = np.unique(slot[free], return_index=True)
            at = free[first]
            self.keys[chosen], self.values[chosen] = keys[at], values[at]
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.after_space = children[ROOT][32]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(C.BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node by a byte, -1 if there is none."""
        key = node.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], -1)
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

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of the greedy split of each span, a space put before it."""
        n = len(starts)
        total = np.zeros(n, np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: the words still read are a prefix
        begin, size = starts[order], (ends - starts)[order]
        state = np.full(n, self.after_space, np.int64)
        counts = np.zeros(n, np.int64)
        short = int(np.searchsorted(-size, -WIDEST))
        for step in range(int(size[short]) if short < n else 0):
            upto = int(np.searchsorted(-size, -step))
            todo = np.arange(short, upto)
            byte = data[begin[short:upto] + step].astype(np.int64)
            while len(todo):
                to = self.child(state[todo], byte)
                hit = to >= 0
                state[todo[hit]] = to[hit]
                todo, byte = todo[~hit], byte[~hit]
                counts[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        for i in range(short):
            node, own = self.after_space, 0
            for byte in data[begin[i] : begin[i] + size[i]].tolist():
                while byte not in self.children[node]:
                    own += int(self.pops[node])
                    node = int(self.fail[node])
                node = self.children[node][byte]
            state[i], counts[i] = node, own
        todo = np.arange(n)
        while len(todo):  # what is still matched at the end is popped down to the root
            counts[todo] += self.pops[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > ROOT]
        total[order] = counts
        return total


def load(path: str) -> list[bytes]:
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines()]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Words and greedy entries of every text, by a vocabulary in the public rank format."""
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(load(path)))  # a fixed public vocabulary

    def work(batch: pa.RecordBatch) -> dict:
        texts = C.Texts.of(batch.column("text"))
        starts, ends, firsts = C.words(texts)
        _, at, code = np.unique(C.span_hashes(texts.data, starts, ends), return_index=True, return_inverse=True)
        each = automaton.value.count(texts.data, starts[at], ends[at])[code]
        longest = np.zeros(texts.n, np.int64)
        if len(each):
            some = np.flatnonzero(np.diff(firsts))
            longest[some] = np.maximum.reduceat(each, firsts[some])
        return {"doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(firsts)), "n_tokens": pa.array(C.sums(each, firsts)), "longest_word_tokens": pa.array(longest)}

    return C.map_texts(docs.select("doc_id", "text"), SCHEMA, work)
