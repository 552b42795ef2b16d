"""A vector index on files: coarse lists, product-quantised residuals, and searches that read only the lists they probe.

fit learns coarse centroids and, for each run of components of what is left once a vector's centroid is taken off, up to 256 codes, by k-means on a bounded
sample (SAMPLE rows by hash). write_index puts every vector into its list: Parquet partitioned by list, one byte for each run. search asks
in blocks of bounded size: a query's nearest lists are probed (partitions pruned by the scan), rows are scored from tables of products of
the query with codes, each task keeps the best few of a query, and these are scored again exactly against the vectors. Cosines throughout.

What a search may miss is measured, not assumed: `recall` compares with exact neighbours, which `retrieval.nearest_vectors` finds
without an index. Null vectors and vectors of length zero are not in the index and ask nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.session import checkpointed

#: Rows that centroids and codes are learned from, lists at most, and rounds of k-means.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 12
#: Components of a run that one byte stands for, and share of the lists that a search probes. Vectors that lie in clusters need a few hundredths; the
#: tables' vectors are nearly noise around few centres: of their 5 nearest 0.75 lie in 0.3 of the lists, 0.9 in half of them, 0.97 in 0.7.
RUN, PROBED = 4, 0.65
#: Of a query's approximately best rows, this many times k are scored exactly.
AGAIN = 8
#: Queries of one block.
BLOCK = 1024


@dataclass(frozen=True)
class Index:
    """What a search needs besides the lists: centroids (lists x width) and codes (runs x codes x RUN)."""

    centroids: np.ndarray
    codes: np.ndarray
    folder: str

    @property
    def width(self) -> int:
        return self.codes.shape[0] * RUN


def unit(vectors: list | pd.Series, width: int) -> np.ndarray:
    """Rows of length 1 (zero for a vector of length zero), filled up with zeros to the width."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of rows: seeded by every n-th row, an empty centre takes the row that is farthest from its own."""
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        far = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)
        own = far.argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        n = np.bincount(own, minlength=k)
        empty = np.flatnonzero(n == 0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if len(empty):
            centres[empty] = rows[np.argsort(far.min(1))[::-1][: len(empty)]]
    return centres


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of vectors that have a direction: no null in them, not all zero."""
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return own.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0))


def fit(vectors: DataFrame, folder: str, lists: int | None = None, sample: int = SAMPLE) -> Index | None:
    """Centroids and codes from a sample; None if there are no vectors. lists: by default the root of the number of vectors."""
    own = usable(vectors)
    n, width = own.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return None
    width = -(-width // RUN) * RUN
    learned = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    rows = unit(learned["embedding"], width)
    centroids = k_means(rows, min(len(rows), MOST_LISTS, lists or max(1, round(n**0.5))))
    left = rows - centroids[(-2 * rows @ centroids.T + (centroids * centroids).sum(1)).argmin(1)]
    codes = np.stack([k_means(left[:, i : i + RUN], min(256, len(rows))) for i in range(0, width, RUN)])
    return Index(centroids, codes, folder)


def write_index(vectors: DataFrame, index: Index) -> None:
    """The lists of all vectors, as Parquet partitioned by list: vec_id and one code for each run."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)  # bounded by MOST_LISTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            if batch.empty:
                continue
            rows = unit(batch["embedding"], own.width)
            near = (-2 * rows @ own.centroids.T + (own.centroids * own.centroids).sum(1)).argmin(1)
            left = rows - own.centroids[near]
            packed = np.empty((len(rows), len(own.codes)), np.uint8)
            for i, codes in enumerate(own.codes):
                part = left[:, i * RUN : (i + 1) * RUN]
                packed[:, i] = (-2 * part @ codes.T + (codes * codes).sum(1)).argmin(1)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "codes": [c.tobytes() for c in packed], "list": near.astype(np.int32)})

    coded = usable(vectors).mapInPandas(run, "vec_id bigint, codes binary, list int")
    coded.repartition(F.col("list"), F.pmod("vec_id", F.lit(4))).write.partitionBy("list").parquet(index.folder)  # a large list has four files


def _scored(rows: DataFrame, index: Index, ids: np.ndarray, asked: np.ndarray, probes: list[np.ndarray], keep: int) -> DataFrame:
    """(query, vec_id, score): of each batch of a list's rows the approximately best of each query that probes the list."""
    by_list: dict[int, np.ndarray] = {}
    for q, lists in enumerate(probes):
        for x in lists.tolist():
            by_list.setdefault(x, []).append(q)
    tables = np.einsum("qrd,rcd->qrc", asked.reshape(len(asked), -1, RUN), index.codes)
    shared = rows.sparkSession.sparkContext.broadcast(({k: np.array(v) for k, v in by_list.items()}, ids, tables, asked @ index.centroids.T))  # a block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        theirs, ids, tables, base = shared.value
        for batch in batches:
            for x, own in batch.groupby("list"):
                queries = theirs.get(int(x))
                if queries is None:
                    continue
                codes = np.frombuffer(b"".join(own["codes"]), np.uint8).reshape(len(own), -1)
                score = np.repeat(base[queries, int(x)][:, None], len(own), axis=1)
                for i in range(codes.shape[1]):
                    score += tables[queries, i][:, codes[:, i]]
                best = np.argpartition(-score, min(keep, len(own) - 1), axis=1)[:, :keep]
                yield pd.DataFrame({"query": np.repeat(ids[queries], best.shape[1]), "vec_id": own["vec_id"].to_numpy()[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    return rows.mapInPandas(run, "query bigint, vec_id bigint, score double")


def search(index: Index, vectors: DataFrame, queries: DataFrame, k: int = 5, probed: float = PROBED, again: int = AGAIN) -> DataFrame:
    """(query, vec_id, score, rank): about the k nearest vectors of each query (vec_id, embedding), itself left out, with exact cosines."""
    spark = vectors.sparkSession
    asked = checkpointed(usable(queries).withColumn("at", F.monotonically_increasing_id()))
    counts = asked.groupBy(F.shiftright("at", 33).alias("part")).count().collect()  # one row for each partition
    lists = spark.read.schema("vec_id bigint, codes binary, list int").parquet(index.folder)
    near, keep = None, k * again
    for part, n in counts:
        for first in range(part << 33, (part << 33) + n, BLOCK):
            block = asked.where(F.col("at").between(first, first + BLOCK - 1)).toPandas()
            rows = unit(block["embedding"], index.width)
            far = -2 * rows @ index.centroids.T + (index.centroids * index.centroids).sum(1)
            few = max(1, -(-len(index.centroids) * int(1000 * probed) // 1000))
            probes = list(np.argpartition(far, min(few, far.shape[1]) - 1, axis=1)[:, :few])
            wanted = np.unique(np.concatenate(probes)).tolist()
            read = lists if len(wanted) == len(index.centroids) else lists.where(F.col("list").isin(wanted))  # partitions that no query probes are not read
            found = _scored(read, index, block["vec_id"].to_numpy(), rows, probes, keep + 1)
            near = found if near is None else near.unionAll(found)
    if near is None:
        return spark.createDataFrame([], "query bigint, vec_id bigint, score double, rank int")
    first = near.where("query <> vec_id").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= keep).select("query", "vec_id")
    exact = first.join(usable(vectors), "vec_id").join(asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked")), "query")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    scored = exact.select("query", "vec_id", F.round(dot("embedding", "asked") / F.sqrt(dot("embedding", "embedding") * dot("asked", "asked")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many exact neighbours (query, vec_id) there are, and the share of them that a search found."""
    hits = exact.select("query", "vec_id").join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return hits.agg(F.count("*").alias("neighbours"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def open_index(spark: SparkSession, vectors: DataFrame, folder: str) -> Index | None:
    """Fits and writes an index of vectors into a folder that does not exist yet."""
    index = fit(vectors, folder)
    if index is not None:
        write_index(vectors, index)
    return index
