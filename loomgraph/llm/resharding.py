"""Minimum-cost-flow resharding.

Old shards supply their bytes, new ones take what their capacities allow, and a flow of least cost between them says how many bytes go from where
to where: nothing is paid for bytes that stay, NEAR for each byte that moves within a zone and FAR for one that leaves it. The network is sparse (each
zone has a hub through which moved bytes pass), so it grows with the number of shards, not with their pairs. It is solved on the driver, from
one number for each shard, by a primal-dual method: shortest distances give prices, and a blocking flow saturates all
ways of the least price at once. Few prices are possible, so few rounds are needed.

The flow turns into block transfers: each old shard's rows stand in one order, its first bytes stay, and each transfer takes the next
run of rows. A row goes where its middle byte falls, so a cut is off by half a row at most. The order is global (ranges by shard and order columns,
checkpointed without texts), and what each range holds before it is summed from one row for each range and shard, so a shard of any size is
dealt over as many tasks as it needs; the same sums number a new shard's rows without gaps.

`reshard` puts rows into shards; `rewrite` carries it out on files: the old table's files are the blocks, a file that goes to one shard
as a whole only changes its line in the manifest, and only files that a cut splits are read again and written.

Nulls: a null text has no bytes (size 1), a null doc_id is a row of its own. Repeated rows are rows of their own; rows equal in all columns are
interchangeable. Ties of the order are broken by text hash, doc_id and checksum. An empty table gives no rows. Columns but doc_id, text and
the old shard's are not read by `reshard`; `rewrite` keeps all columns whatever their names. A very long text is one row, and moves as a whole.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import common as C
from loomgraph.plans.session import shared_folder

SHARDS = 16
#: Shards that the documents come from: their sources, by hash.
OLD_SHARDS = 20
#: Price of a byte that moves within a zone, and of one that leaves it.
NEAR, FAR = 1, 4
ENDLESS = 1 << 62


class Network:
    """A flow network with costs; edge e and its reverse e ^ 1 stand side by side."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        e = len(self.to)
        self.to += [b, a]
        self.room += [room, 0]
        self.cost += [cost, -cost]
        self.out[a].append(e)
        self.out[b].append(e + 1)
        return e

    def flow(self, e: int) -> int:
        return self.room[e ^ 1]

    def _prices(self, source: int, price: list[int]) -> bool:
        """Adds the shortest distances (over reduced costs) to the prices; nodes out of reach get the greatest one."""
        far = [ENDLESS] * len(self.out)
        far[source], queue = 0, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in self.out[a]:
                if self.room[e] and (n := d + self.cost[e] + price[a] - price[self.to[e]]) < far[self.to[e]]:
                    far[self.to[e]] = n
                    heapq.heappush(queue, (n, self.to[e]))
        most = max(d for d in far if d < ENDLESS)
        for a, d in enumerate(far):
            price[a] += min(d, most)
        return far[-1] < ENDLESS

    def _levels(self, source: int, price: list[int]) -> list[int]:
        level = [-1] * len(self.out)
        level[source], layer = 0, [source]
        while layer:
            following = []
            for a in layer:
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] and level[b] < 0 and self.cost[e] + price[a] == price[b]:
                        level[b] = level[a] + 1
                        following.append(b)
            layer = following
        return level

    def solve(self, source: int) -> tuple[int, int]:
        """The most that can flow from source to the last node at the least cost: (flow, cost)."""
        sink, price, total = len(self.out) - 1, [0] * len(self.out), 0
        while self._prices(source, price):
            while (level := self._levels(source, price))[sink] >= 0:
                at, way = [0] * len(self.out), []
                while True:
                    a = self.to[way[-1]] if way else source
                    if a == sink:
                        least = min(self.room[e] for e in way)
                        for e in way:
                            self.room[e] -= least
                            self.room[e ^ 1] += least
                        total += least
                        way = way[: next(i for i, e in enumerate(way) if not self.room[e])]
                        continue
                    while at[a] < len(self.out[a]):
                        e = self.out[a][at[a]]
                        b = self.to[e]
                        if self.room[e] and level[b] == level[a] + 1 and self.cost[e] + price[a] == price[b]:
                            way.append(e)
                            break
                        at[a] += 1
                    else:
                        if not way:
                            break
                        at[self.to[way.pop() ^ 1]] += 1
        return total, sum(self.flow(e) * self.cost[e] for e in range(0, len(self.to), 2))


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most and add up to the total."""
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def transfers(sizes: Sequence[int], capacities: Sequence[int], old_zones: Sequence[int] | None = None, new_zones: Sequence[int] | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """((old, new, bytes) in the order of old, what stays first; cost) of a flow of least cost; shard j goes on in shard j."""
    n, m = len(sizes), len(capacities)
    if sum(sizes) > sum(capacities):
        raise ValueError(f"{sum(sizes)} bytes do not fit into {sum(capacities)}")
    old_zones, new_zones = old_zones or [0] * n, new_zones or [0] * m
    zones = sorted({*old_zones, *new_zones})
    hub = {z: 1 + n + m + k for k, z in enumerate(zones)}
    core, sink = 1 + n + m + len(zones), 2 + n + m + len(zones)
    net = Network(sink + 1)
    for i, size in enumerate(sizes):
        net.edge(0, 1 + i, size, 0)
    for j, room in enumerate(capacities):
        net.edge(1 + n + j, sink, room, 0)
    stays = {i: net.edge(1 + i, 1 + n + i, ENDLESS, 0) for i in range(min(n, m))}
    gives = [net.edge(1 + i, hub[z], ENDLESS, NEAR) for i, z in enumerate(old_zones)]
    takes = [net.edge(hub[z], 1 + n + j, ENDLESS, 0) for j, z in enumerate(new_zones)]
    leaves = {z: net.edge(hub[z], core, ENDLESS, FAR - NEAR) for z in zones}
    far_takes = [net.edge(core, 1 + n + j, ENDLESS, 0) for j in range(m)]
    total, cost = net.solve(0)
    if total < sum(sizes):
        raise RuntimeError("the flow does not carry all bytes")

    moved: dict[tuple[int, int], int] = {}

    def deal(supply: list[list[int]], demand: list[list[int]]) -> None:
        """What flows through a hub, in the order of shards; what is left of supply stays in it."""
        at = 0
        for j, wanted in demand:
            while wanted:
                if not supply[at][1]:
                    at += 1
                    continue
                part = min(wanted, supply[at][1])
                moved[supply[at][0], j] = moved.get((supply[at][0], j), 0) + part
                supply[at][1] -= part
                wanted -= part

    leaving: list[list[int]] = []
    for z in zones:
        supply = [[i, net.flow(e)] for i, e in enumerate(gives) if old_zones[i] == z]
        deal(supply, [[j, net.flow(e)] for j, e in enumerate(takes) if new_zones[j] == z])
        leaving += [s for s in supply if s[1]]
        assert sum(s[1] for s in supply) == net.flow(leaves[z])
    deal(leaving, [[j, net.flow(e)] for j, e in enumerate(far_takes)])
    kept = [(i, i, net.flow(e)) for i, e in stays.items() if net.flow(e)]
    ways = sorted(moved.items())
    return sorted([*kept, *((i, j, b) for (i, j), b in ways)], key=lambda t: (t[0], t[0] != t[1], t[1])), cost


class Plan:
    """Where rows go: the cuts of each old shard, and what every range of the ordered table holds before it."""

    def __init__(self, moves: list[tuple[int, int, int]], before: dict[tuple[int, int], int]):
        self.before = before
        self.cuts: dict[int, np.ndarray] = {}
        self.shards: dict[int, np.ndarray] = {}
        for old in {m[0] for m in moves}:
            own = [m for m in moves if m[0] == old]
            self.cuts[old], self.shards[old] = np.cumsum([b for _, _, b in own])[:-1], np.array([j for _, j, _ in own], np.int32)

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Each batch of one range, its rows' new shards, and how many rows of their shard the range had before each."""
        passed: dict[int, int] = {}
        held: dict[int, int] = {}
        for batch in batches:
            part, old, size = (batch.column(c).to_numpy() for c in ("part", "old", "size"))
            shard, nth = np.zeros(len(old), np.int32), np.zeros(len(old), np.int64)
            for o in np.unique(old).tolist():
                rows = np.flatnonzero(old == o)
                start = self.before[int(part[rows[0]]), o] + passed.get(o, 0) + np.cumsum(size[rows]) - size[rows]
                shard[rows] = self.shards[o][np.searchsorted(2 * self.cuts[o], 2 * start + size[rows], side="right")]
                passed[o] = passed.get(o, 0) + int(size[rows].sum())
            for s in np.unique(shard).tolist():
                rows = np.flatnonzero(shard == s)
                nth[rows] = held.get(s, 0) + np.arange(len(rows))
                held[s] = held.get(s, 0) + len(rows)
            yield batch, shard, nth


def ordered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (old, size and others) in ranges by old shard and order, checkpointed, with the number of their range as `part`."""
    by = [F.col("old"), *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return C.checkpointed(dealt.withColumn("part", F.spark_partition_id()))


def shards_of(rows: DataFrame, order: list[Column], capacities: Sequence[int] | int, **zones: Sequence[int]) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """rows (old int, size bigint and others) with shard and slot (gapless from 0 in each shard), and the transfers.

    capacities: bytes of each new shard, or the number of shards of equal size.
    """
    table = ordered(rows, order)
    sums = sorted(table.groupBy("old", "part").agg(F.sum("size").alias("size")).toLocalIterator())  # one row for each range, and for each shard in it
    before: dict[tuple[int, int], int] = {}
    sizes: dict[int, int] = {}
    for old, part, size in sums:
        before[part, old] = sizes.get(old, 0)
        sizes[old] = sizes.get(old, 0) + size
    totals = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    moves, _ = transfers(totals, even(sum(totals), capacities) if isinstance(capacities, int) else capacities, **zones)
    plan = Plan(moves, before)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], int] = {}
        for batch, shard, _ in plan.place(batches):
            for s, n in zip(*np.unique(shard, return_counts=True)):
                key = int(batch.column("part")[0].as_py()), int(s)
                held[key] = held.get(key, 0) + int(n)
        yield pa.RecordBatch.from_pydict({"part": [k[0] for k in held], "shard": [k[1] for k in held], "n": list(held.values())}, pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64())]))

    counts = sorted(table.select("part", "old", "size").mapInArrow(count, "part int, shard int, n bigint").toLocalIterator())
    first: dict[tuple[int, int], int] = {}
    rows_of: dict[int, int] = {}
    for part, shard, n in counts:
        first[part, shard] = rows_of.get(shard, 0)
        rows_of[shard] = rows_of.get(shard, 0) + n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard, nth in plan.place(batches):
            if not batch.num_rows:
                continue
            part, own = batch.column("part")[0].as_py(), np.unique(shard)
            slot = nth + np.array([first[part, s] for s in own.tolist()], np.int64)[np.searchsorted(own, shard)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(slot)], [*batch.schema.names, "shard", "slot"])

    schema = T.StructType([*table.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return table.mapInArrow(number, schema).drop("part"), moves


def old_shard(source: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS)).cast("int")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def reshard(docs: DataFrame, old: Column | None = None, capacities: Sequence[int] | int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the old shard of every document.

    The largest texts of a shard stay, so that cuts fall among small ones; equal texts stand side by side.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("mark"), (old_shard(F.col("source")) if old is None else old.cast("int")).alias("old"))
    out, _ = shards_of(own, [F.col("size").desc(), F.col("mark"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32")], capacities)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def written_shards(docs: DataFrame, shard: Column, folder: str) -> DataFrame:
    """docs as files of shards: `folder` gets the files, and the manifest is (shard, path)."""
    docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), shard.cast("int").alias("shard")).write.partitionBy("shard").parquet(folder)
    return manifest_of(docs.sparkSession, folder)


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.parquet(folder).select(F.col("shard"), F.col("_metadata.file_path").alias("path"))
    return C.checkpointed(found.distinct())


def rows_of(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(row, shard, path, line): the rows of the files of a manifest, one line for each file."""
    lines = {r["path"]: r["shard"] for r in manifest.toLocalIterator()}  # a manifest has a line for each file
    rows = spark.read.parquet(*sorted(lines)).select("row", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("line"))
    return rows.join(F.broadcast(manifest), "path")


def rewrite(spark: SparkSession, manifest: DataFrame, capacities: Sequence[int] | int, into: str | None = None, **zones: Sequence[int]) -> DataFrame:
    """The manifest of the table once resharded. Files that go to one shard as a whole stay where they are; the others' rows are written to `into`.

    The old files and the old manifest are left alone, so a failed run leaves the old table whole.
    """
    into = into or f"{shared_folder(spark)}/resharded-{uuid.uuid4().hex}"
    rows = rows_of(spark, manifest)
    own = rows.select(F.col("shard").alias("old"), text_size(F.col("row.text")).alias("size"), "path", "line")
    placed, _ = shards_of(own, [F.col("path"), F.col("line")], capacities, **zones)
    placed = C.checkpointed(placed.select("path", "line", F.col("shard").alias("new")))
    whole = placed.groupBy("path").agg(F.min("new").alias("shard"), F.max("new").alias("last"))
    kept = whole.where(F.col("shard") == F.col("last")).select("shard", "path")
    cut = C.checkpointed(whole.where("shard <> last").select("path"))
    if cut.isEmpty():
        return C.checkpointed(kept)
    split = sorted(r["path"] for r in cut.toLocalIterator())  # as many as there are cuts at most
    torn = spark.read.parquet(*split).select("row", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("line"))
    torn = torn.join(placed.join(F.broadcast(cut), "path"), ["path", "line"])
    torn.select("row", F.col("new").alias("shard")).write.partitionBy("shard").parquet(into)
    return C.checkpointed(kept.unionByName(manifest_of(spark, into)))
