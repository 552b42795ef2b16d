"""Line dedup by a sharded minimal perfect hash: documents probe arrays instead of joining lines.

A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased. Keys of 40 code points or more
that stand in 5 documents or more lose all their lines but those in the largest doc_id that holds them.

Every document gives the 128-bit hash of each of its long keys once; counts and largest ids are pre-aggregated before their
shuffle. Keys common enough are dealt into shards of bounded size, and a task for each shard builds a minimal perfect hash (levels of
bit arrays; a key belongs to the first level where no other wants its bit, and the rank of that bit is its index)
and the arrays that it indexes: 64-bit fingerprints, counts and largest ids. Shards are broadcast in groups below a fixed
number of bytes; each group is one narrow pass over the documents, so an index of any size is probed in bounded
memory. (A group's pass drops its own keys' lines; the documents are checkpointed between groups.)

Nulls: a null or empty text is one empty line, and its kept text is empty. A null doc_id is less than all others, and its
lines count as a document's. Repeated rows count as documents of their own; if they hold the largest id, all keep the line.
All columns of the input are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import common as C

SHORTEST, DOCUMENTS = 40, 5
#: Keys of a shard, about, and bytes of the shards that are broadcast together.
SHARD_KEYS, GROUP_BYTES = 50_000, 64 << 20
GAMMA, LEVELS = 2, 40
NO_ID = -(1 << 63)


class Shard:
    """Minimal perfect hash of distinct 64-bit keys, and the arrays behind it."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray, clashes: tuple[np.ndarray, ...] | None = None):
        """clashes: keys, fingerprints, counts and keepers of what shares its key with another entry; hardly ever any."""
        self.levels, self.fingerprints, self.counts, self.keepers = levels, fingerprints, counts, keepers
        self.clashes = clashes or (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.words, self.starts = words, np.cumsum([0] + [len(x) for x in levels])

    @staticmethod
    def _bit(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return C.mixed(keys + np.uint64((level + 1) * C.BASE & (2**64 - 1))) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, keepers: np.ndarray, clashes: tuple[np.ndarray, ...] | None = None) -> Shard:
        levels: list[np.ndarray] = []
        rest = keys
        while len(rest):
            if len(levels) == LEVELS:
                raise ValueError("keys of a shard must be distinct")
            words = -(-GAMMA * len(rest) // 64)
            bit = cls._bit(rest, len(levels), words)
            wanted = np.bincount(bit.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(wanted, bitorder="little").view("<u8").astype(np.uint64))
            rest = rest[~wanted[bit.astype(np.int64)]]
        empty = cls(levels, fingerprints, counts, keepers)
        at = empty.index(keys)
        order = np.empty(len(keys), np.int64)
        order[at] = np.arange(len(keys))
        return cls(levels, fingerprints[order], counts[order], keepers[order], clashes)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key of the set (another key gets any index, or -1)."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (start, stop) in enumerate(zip(self.starts.tolist(), self.starts[1:].tolist())):
            if not len(todo):
                break
            bit = self._bit(keys[todo], level, stop - start)
            word, place = start + (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            mask = np.uint64(1) << place
            hit = (self.words[word] & mask) != 0
            out[todo[hit]] = self.before[word[hit]] + np.bitwise_count(self.words[word[hit]] & (mask[hit] - np.uint64(1)))
            todo = todo[~hit]
        return out

    def keeper_of(self, keys: np.ndarray, fingerprints: np.ndarray, documents: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the set with a count of so many documents, and the largest doc_id that holds it."""
        at = self.index(keys)
        if not len(self.fingerprints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        inside = (at >= 0) & (self.fingerprints[at] == fingerprints) & (self.counts[at] >= documents)
        keepers = self.keepers[at]
        for key, fingerprint, n, keeper in zip(*(x.tolist() for x in self.clashes)):
            hit = (keys == key) & (fingerprints == fingerprint) & (n >= documents)
            inside, keepers = inside | hit, np.where(hit, keeper, keepers)
        return inside, keepers

    def columns(self) -> dict[str, bytes]:
        own = {"sizes": np.array([len(x) for x in self.levels], np.int64), "bits": self.words, "fingerprints": self.fingerprints, "counts": self.counts, "keepers": self.keepers}
        return {k: x.tobytes() for k, x in own.items()} | {"clashes": b"".join(x.astype("<i8" if i > 1 else "<u8").tobytes() for i, x in enumerate(self.clashes))}

    @classmethod
    def of(cls, row) -> Shard:
        sizes, words = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint64)
        keys, marks, counts, keepers = np.frombuffer(row["clashes"], np.int64).reshape(4, -1)
        clashes = keys.view(np.uint64), marks.view(np.uint64), counts.astype(np.int32), keepers
        return cls(np.split(words, np.cumsum(sizes)[:-1]), np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.int32), np.frombuffer(row["keepers"], np.int64), clashes)


def long_keys(texts: C.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines and the lines before each document; which lines have long keys; these keys' hashes (n x 2)."""
    starts, ends, firsts = C.lines(texts)
    solid = np.flatnonzero(~C.SPACE[texts.data])
    if not len(solid):
        return starts, ends, firsts, np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    left, right = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(right > left)
    begin, end = solid[left[some]], solid[right[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    wide = points[end] - points[begin] >= SHORTEST
    lowered = memoryview(C.LOWER[texts.data].tobytes())
    digests = b"".join(xxhash.xxh3_128_digest(lowered[a:b]) for a, b in zip(begin[wide].tolist(), end[wide].tolist()))
    return starts, ends, firsts, some[wide], np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)


def common_keys(docs: DataFrame) -> DataFrame:
    """(hi, lo, n, keeper): keys in enough documents, and the largest id that holds each."""

    def work(batch: pa.RecordBatch) -> dict | None:
        _, _, firsts, at, keys = long_keys(C.Texts.of(batch.column("text")))
        if not len(at):
            return None
        row = np.searchsorted(firsts, at, side="right") - 1
        held = np.unique(np.column_stack([row.astype(np.uint64), keys]), axis=0)  # once for each document
        return {"hi": pa.array(held[:, 1].view(np.int64)), "lo": pa.array(held[:, 2].view(np.int64)), "keeper": batch.column("doc_id").take(pa.array(held[:, 0].astype(np.int64)))}

    keys = C.map_texts(docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text"), "hi bigint, lo bigint, keeper bigint", work)
    return keys.groupBy("hi", "lo").agg(F.count("*").cast("int").alias("n"), F.max("keeper").alias("keeper")).where(F.col("n") >= DOCUMENTS)


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The shards as rows (shard, arrays), and their number. hi picks the shard and is its key; lo is the fingerprint."""
    keys = C.checkpointed(common_keys(docs))
    n = max(1, -(-keys.count() // SHARD_KEYS))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        again = group["hi"].duplicated()  # keys that share their first 64 bits with another
        parts = [
            (part["hi"].to_numpy().view(np.uint64), part["lo"].to_numpy().view(np.uint64), part["n"].to_numpy().astype(np.int32), part["keeper"].to_numpy())
            for part in (group[~again], group[again])
        ]
        return pd.DataFrame([{"shard": group["shard"].iloc[0], **Shard.build(*parts[0], parts[1]).columns()}])

    sharded = keys.withColumn("shard", F.pmod(F.col("hi"), F.lit(n)).cast("int"))
    schema = "shard int, sizes binary, bits binary, fingerprints binary, counts binary, keepers binary, clashes binary"
    return C.checkpointed(sharded.groupBy("shard").applyInPandas(build, schema)), n


def probe(docs: DataFrame, shards: dict[int, Shard], n: int, dropped: str) -> DataFrame:
    """docs without the lines whose keys the given shards hold, unless the document keeps them; dropped counts on."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(shards)  # below GROUP_BYTES

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        texts = C.Texts.of(batch.column("text"))
        starts, ends, firsts, at, keys = long_keys(texts)
        own = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()[np.searchsorted(firsts, at, side="right") - 1] if len(at) else np.zeros(0, np.int64)
        gone = np.zeros(len(starts), bool)
        shard_of = np.mod(keys[:, 0].view(np.int64), n)
        for shard in np.unique(shard_of).tolist():
            if shard in index:
                rows = np.flatnonzero(shard_of == shard)
                inside, keeper = index[shard].keeper_of(keys[rows, 0], keys[rows, 1], DOCUMENTS)
                gone[at[rows]] = inside & (keeper != own[rows])
        n_gone = C.sums(gone, firsts)
        kept = batch.column("text").fill_null("").to_pylist()
        for i in np.flatnonzero(n_gone).tolist():
            lines = range(firsts[i], firsts[i + 1])
            kept[i] = b"\n".join(texts.data[starts[j] : ends[j]].tobytes() for j in lines if not gone[j]).decode()
        arrays = []
        for name in batch.schema.names:
            old = batch.column(name)
            arrays.append(pa.array(kept, old.type) if name == "text" else pa.array(old.to_numpy() + n_gone) if name == dropped else old)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return C.map_texts(docs, docs.schema, work)


def drop_lines(docs: DataFrame, dropped: str = "n_dropped") -> DataFrame:
    """docs with the kept texts, and a column of the lines dropped (its name must be free)."""
    if dropped.lower() in map(str.lower, docs.columns):  # Spark's names know no case
        raise ValueError(f"the input has a column {dropped}")
    index, n = build_index(docs)
    sizes = F.length("sizes") + F.length("bits") + F.length("fingerprints") + F.length("counts") + F.length("keepers") + F.length("clashes")
    groups, held = [[]], 0
    for row in index.select("shard", sizes.alias("bytes")).orderBy("shard").toLocalIterator():
        if groups[-1] and held + row["bytes"] > GROUP_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(row["shard"])
        held += row["bytes"]
    now = docs.withColumn(dropped, F.lit(0).cast(T.LongType()))
    for i, group in enumerate(groups):
        rows = index.where(F.col("shard").isin(group)).collect() if group else []
        now = probe(now if i == 0 else C.checkpointed(now), {r["shard"]: Shard.of(r) for r in rows}, n, dropped)
    return now


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the digest of the kept text of every document."""
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))), F.lit(0)).cast("bigint") + 1
    return drop_lines(docs.select("doc_id", "text", n_lines.alias("n_lines"))).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, i, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS stripped
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
k AS (SELECT doc_id, i, line, translate(stripped, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL AND c.keeper <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL OR c.keeper = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""
