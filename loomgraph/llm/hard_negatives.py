"""Hard-negative mining by segment summaries.

Every vector stores, for segments of its components, their mean and their deviation (the length of what is left once the mean is taken
off). The inner product of two vectors is the sum over segments of (width x product of means) plus or minus at most (product of
deviations), so summaries bound it. Few wide segments are tried first; pairs that these bounds cannot dismiss are bounded again by more, narrower
segments, and only what is left is scored exactly, in whole numbers.

Anchors are a query set against all rows, in blocks of at most BLOCK of them that are broadcast. Every block makes two narrow passes: the first
keeps each task's best rows of an anchor's own label, the second, for each positive that came out, each task's best rows of
other labels within the positive's window of scores. A task keeps TOP rows an anchor (and positive) at most, whatever it reads, and the worst of them dismisses further
rows by their bounds. Only those few are shuffled. The blocks' results are written in the shared folder one after the other, so
neither the driver nor a task ever holds more than a block.

Rows with a null vec_id, label or vector, or with a null or non-finite component take no part. Components of 65,536 and beyond (either sign)
count as that. Shorter vectors count as filled up with zeros. Rows of the anchor's own vec_id are not "other rows"; repeated rows each count,
as anchors and as answers. Equal scores go by the smaller vec_id. Positives below zero have no window, hence no rows. An empty table gives
no rows. Columns but vec_id, embedding and label are not read. A very long vector only makes a batch smaller.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import common as C
from loomgraph.plans.session import shared_folder

SCALE, LABELS, RELABEL, ANCHOR = 256, 10, 7, 50
POSITIVES, NEGATIVES = 5, 3
#: 50 * positive <= 100 * negative <= 95 * positive
LOW, HIGH = 50, 95
LEVELS = (1, 4, 16)
#: Anchors of a block (one broadcast); anchors and rows of one tile of bounds.
BLOCK, TILE_ANCHORS, TILE_ROWS = 8192, 512, 2048
#: Bytes of vectors in a tile of rows, at most (or one row).
TILE_BYTES = 8 << 20
#: The first tile of a task is small, so that the rows kept from it dismiss most of the others.
FIRST_ROWS = 256
#: Share of a tile's pairs above which all of them are computed at once.
DENSE = 0.25
LIMIT = 1 << 24
NONE = -(1 << 62)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part."""
    x = F.col("embedding")
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    own = own.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    whole = F.transform("x", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return own.select("vec_id", F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"), whole.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), C.ragged(np.zeros(len(sizes), np.int64), sizes)] = values
    return out


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each level: means times the root of the width, and deviations; a last column of the latter bears rounding."""
    out = []
    rounding = 1e-6 * np.sqrt((x * x).sum(1, keepdims=True))
    for n in LEVELS:
        parts = x.reshape(len(x), n, -1)
        mean = parts.mean(2)
        deviation = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))
        out.append((mean * np.sqrt(parts.shape[2]), np.concatenate([deviation, rounding], axis=1)))
    return out


def padded(width: int) -> int:
    return max(-(-width // LEVELS[-1]), 1) * LEVELS[-1]


class Rows:
    """Vectors with their summaries, as arrays. They are stored level by level, in `stored` form, and read back by `of`."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.labels, self.x, self.levels = ids, labels, x, levels

    @classmethod
    def of(cls, batch: pa.RecordBatch | pa.Table, width: int) -> Rows:
        ids, labels = (np.asarray(batch.column(c)) for c in ("vec_id", "label"))
        flat = matrix(batch.column("summary"), sum(2 * n + 1 for n in LEVELS))
        levels, at = [], 0
        for n in LEVELS:
            levels.append((np.ascontiguousarray(flat[:, at : at + n]), np.ascontiguousarray(flat[:, at + n : at + 2 * n + 1])))
            at += 2 * n + 1
        return cls(ids, labels, matrix(batch.column("v"), width), levels)

    def some(self, rows: np.ndarray | slice) -> Rows:
        return Rows(self.ids[rows], self.labels[rows], self.x[rows], [(m[rows], d[rows]) for m, d in self.levels])


def summarised(own: DataFrame, width: int) -> DataFrame:
    """vec_id, label, v, summary: the means and deviations of all levels end to end."""
    size = sum(2 * n + 1 for n in LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(at, TILE_ROWS)
                flat = np.concatenate([m for pair in summaries(matrix(part.column("v"), width)) for m in pair], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * size), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("v"), lists], ["vec_id", "label", "v", "summary"])

    return own.mapInArrow(run, "vec_id bigint, label bigint, v array<int>, summary array<double>")


def pairs(a: Rows, b: Rows, wanted: Callable[[np.ndarray | slice, np.ndarray, np.ndarray], np.ndarray], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs whose score `wanted` may want: wanted(i, least, greatest) judges bounds, of a tile or of single pairs."""
    i = j = None
    cells = len(a.ids) * len(b.ids)
    for mean, deviation in zip(*[[(x[k], y[k]) for x, y in zip(a.levels, b.levels)] for k in (0, 1)]):
        if i is None:
            middle, spread = mean[0] @ mean[1].T, deviation[0] @ deviation[1].T
            left = wanted(slice(None), middle - spread, middle + spread)
            if np.count_nonzero(left) <= DENSE * cells:
                i, j = np.nonzero(left)
        else:
            middle, spread = np.einsum("ij,ij->i", mean[0][i], mean[1][j]), np.einsum("ij,ij->i", deviation[0][i], deviation[1][j])
            left = wanted(i, middle - spread, middle + spread)
            i, j = i[left], j[left]
    if i is None:
        i, j = np.nonzero(left)
        score = (a.x @ b.x.T)[i, j] if whole else np.einsum("ij,ij->i", a.x[i].astype(np.int64), b.x[j].astype(np.int64))
    else:
        score = np.einsum("ij,ij->i", a.x[i], b.x[j]) if whole else np.einsum("ij,ij->i", a.x[i].astype(np.int64), b.x[j].astype(np.int64))
    return i, j, score.astype(np.int64)


class Best:
    """The best few (score, id) of each of n slots."""

    def __init__(self, n: int, few: int):
        self.scores, self.ids = np.full((n, few), NONE), np.full((n, few), np.iinfo(np.int64).max)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        near = score >= self.scores[slot, -1]
        slot, score, ids = slot[near], score[near], ids[near]
        if not len(slot):
            return
        few, touched = self.scores.shape[1], np.unique(slot)
        slots, scores, own = np.concatenate([np.repeat(touched, few), slot]), np.concatenate([self.scores[touched].ravel(), score]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((own, -scores, slots))
        first = np.searchsorted(slots[order], touched)
        keep = order[(first[:, None] + np.arange(few)).ravel()]
        self.scores[touched], self.ids[touched] = scores[keep].reshape(-1, few), own[keep].reshape(-1, few)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, k = np.nonzero(self.scores > NONE)
        return slot, self.scores[slot, k], self.ids[slot, k]


def tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Rows]:
    most, n = max(1, min(TILE_ROWS, TILE_BYTES // (8 * width))), FIRST_ROWS
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            size = min(n, most)
            yield Rows.of(batch.slice(at, size), width)
            at, n = at + size, 2 * n


def exact_in_double(a: Rows, b: Rows) -> bool:
    """Whether no inner product of the two can leave the whole numbers that doubles hold."""
    return a.x.shape[1] * np.abs(a.x).max(initial=0) * np.abs(b.x).max(initial=0) < 2**53


def best_of_label(vectors: DataFrame, anchors: Rows, width: int) -> DataFrame:
    """(slot, score, vec_id): each task's best rows of the anchors' own labels."""
    shared = vectors.sparkSession.sparkContext.broadcast(anchors)  # a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best, by_label = Best(len(block.ids), POSITIVES), {x: np.flatnonzero(block.labels == x) for x in np.unique(block.labels).tolist()}
        for rows in tiles(batches, width):
            for label in np.unique(rows.labels).tolist():
                theirs, b = by_label.get(label, ()), rows.some(rows.labels == label)
                for at in range(0, len(theirs), TILE_ANCHORS):
                    own = theirs[at : at + TILE_ANCHORS]
                    a, worst = block.some(own), best.scores[own, -1]
                    i, j, score = pairs(a, b, lambda i, low, high, w=worst: high >= (w[:, None] if isinstance(i, slice) else w[i]), exact_in_double(a, b))
                    other = a.ids[i] != b.ids[j]
                    best.add(own[i[other]], score[other], b.ids[j[other]])
        slot, score, ids = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(score), pa.array(ids)], ["slot", "score", "vec_id"])

    return vectors.mapInArrow(run, "slot bigint, score bigint, vec_id bigint")


def best_of_others(vectors: DataFrame, anchors: Rows, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray, width: int) -> DataFrame:
    """(place, score, vec_id): each task's best rows of other labels within the window of each (anchor, positive), by their place."""
    shared = vectors.sparkSession.sparkContext.broadcast((anchors, slots, scores))  # a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, slot, score = shared.value
        order = np.argsort(slot, kind="stable")
        k = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        place = np.full((len(block.ids), POSITIVES), -1)
        place[slot[order], k] = order
        some = place >= 0
        low = np.where(some, -(-LOW * score[place] // 100), 1 << 62)
        high = np.where(some, HIGH * score[place] // 100, NONE)
        low[low > high], best = 1 << 62, Best(len(slot), NEGATIVES)
        for rows in tiles(batches, width):
            for at in range(0, len(block.ids), TILE_ANCHORS):
                own = np.arange(at, min(at + TILE_ANCHORS, len(block.ids)))
                a = block.some(own)
                floor = np.where(some[own], np.maximum(low[own], best.scores[place[own], -1]), 1 << 62)
                least, most = floor.min(1), high[own].max(1)

                def wanted(i, lower, upper, least=least, most=most):
                    if isinstance(i, slice):
                        return (upper >= least[:, None]) & (lower <= most[:, None])
                    return (upper >= least[i]) & (lower <= most[i])

                i, j, got = pairs(a, rows, wanted, exact_in_double(a, rows))
                other = (a.labels[i] != rows.labels[j]) & (a.ids[i] != rows.ids[j])
                i, j, got = i[other], j[other], got[other]
                for n in range(POSITIVES):
                    inside = (got >= floor[i, n]) & (got <= high[own][i, n])
                    best.add(place[own[i[inside]], n], got[inside], rows.ids[j[inside]])
        where, found, negative = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(found), pa.array(negative)], ["place", "score", "vec_id"])

    return vectors.mapInArrow(run, "place bigint, score bigint, vec_id bigint")


def ranked(found: DataFrame, slot: str, few: int) -> DataFrame:
    """The best few of each slot, with their rank; a slot has `few` rows from each task at most."""
    rank = F.row_number().over(Window.partitionBy(slot).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= few)


def blocks_of(anchors: DataFrame, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of `at` (monotonically increasing, by partition) that hold at most so many rows each."""
    counts = sorted(anchors.groupBy(F.shiftright("at", 33).alias("part")).count().toLocalIterator())
    low, held = None, 0
    for part, n in counts:
        first = part << 33
        while n:
            if low is None:
                low, held = first, 0
            take = min(n, most - held)
            held, first, n = held + take, first + take, n - take
            if held == most:
                yield low, first - 1
                low = None
    if low is not None:
        yield low, first - 1


SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(vectors: DataFrame, anchor: Column | None = None, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; `anchor` says which rows are anchors."""
    spark = vectors.sparkSession
    C.prepare(spark)
    own = prepared(vectors)
    longest = own.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], SCHEMA)
    width = padded(longest)
    table = C.written(summarised(own, width))
    anchors = C.checkpointed(table.where(F.col("vec_id") % ANCHOR == 0 if anchor is None else anchor).withColumn("at", F.monotonically_increasing_id()))
    into = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.parquet(into)
    for low, high in blocks_of(anchors, block):
        some = Rows.of(anchors.where(F.col("at").between(low, high)).select("vec_id", "label", "v", "summary").toArrow(), width)
        positives = ranked(best_of_label(table, some, width), "slot", POSITIVES).select("slot", "vec_id", "score").toArrow()  # a few for each anchor of the block
        slots, ids, scores = (np.asarray(positives.column(c)) for c in ("slot", "vec_id", "score"))
        if not len(slots):
            continue
        named = spark.createDataFrame(pa.table({"place": pa.array(np.arange(len(slots))), "anchor_id": pa.array(some.ids[slots]), "positive_id": pa.array(ids), "positive_score": pa.array(scores)}))
        found = ranked(best_of_others(table, some, slots, ids, scores, width), "place", NEGATIVES)
        found.join(named, "place").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(into)
    return spark.read.schema(SCHEMA).parquet(into)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
