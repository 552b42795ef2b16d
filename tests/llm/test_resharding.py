"""Resharding: the flow against brute force, the law and the numbering of shards, and files rewritten only where a cut needs it."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import docs, empty, hard

from loomgraph.llm import resharding as R


def least_cost(sizes, capacities, old_zones, new_zones):
    """The cheapest way by trying all, unit by unit."""
    best = {tuple(capacities): 0}
    for i, size in enumerate(sizes):
        following = {}
        for left, cost in best.items():
            for split in itertools.product(*[range(min(size, c) + 1) for c in left]):
                if sum(split) == size:
                    price = cost + sum(0 if i == j else b * (R.NEAR if old_zones[i] == new_zones[j] else R.FAR) for j, b in enumerate(split))
                    key = tuple(c - b for c, b in zip(left, split))
                    following[key] = min(price, following.get(key, 1 << 60))
        best = following
    return min(best.values())


@pytest.mark.parametrize(
    "sizes, capacities, old_zones, new_zones",
    [
        ([5, 0, 2], [3, 3, 1], [0, 0, 0], [0, 0, 0]),
        ([4, 3, 2, 1], [3, 3, 4], [0, 1, 0, 1], [1, 0, 1]),
        ([6, 1], [2, 2, 2, 2], [0, 1], [0, 1, 1, 0]),
        ([3, 3, 3], [0, 5, 5], [0, 1, 2], [0, 2, 1]),
        ([0, 0], [1, 1], [0, 0], [0, 0]),
        ([2, 7, 1], [4, 4, 4], [2, 0, 1], [0, 2, 2]),
    ],
)
def test_flow_costs_the_least(sizes, capacities, old_zones, new_zones):
    moves, cost = R.transfers(sizes, capacities, old_zones, new_zones)
    assert cost == least_cost(sizes, capacities, old_zones, new_zones)
    assert cost == sum(0 if i == j else b * (R.NEAR if old_zones[i] == new_zones[j] else R.FAR) for i, j, b in moves)
    for i, size in enumerate(sizes):
        assert sum(b for o, _, b in moves if o == i) == size
    for j, room in enumerate(capacities):
        assert sum(b for _, n, b in moves if n == j) <= room


def test_moved_bytes_are_those_over_capacity():
    sizes = [(i * 7919) % 1000 for i in range(300)]
    capacities = R.even(sum(sizes), 200)
    moves, cost = R.transfers(sizes, capacities)
    assert cost == sum(b for i, j, b in moves if i != j) == sum(max(s - c, 0) for s, c in itertools.zip_longest(sizes, capacities, fillvalue=0))
    with pytest.raises(ValueError):
        R.transfers([2], [1])


def check_law(rows, want):
    assert Counter(r["doc_id"] for r in rows) == Counter(want.keys()) if isinstance(want, dict) else True
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < R.SHARDS
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in shards.items()}


def test_shards_are_even_and_stay_where_they_can(spark):
    table = docs(spark)
    rows = R.reshard(table).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    sizes, total = check_law(rows, texts), sum(len(t.encode()) + 1 for t in texts.values())
    capacities, largest = R.even(total, R.SHARDS), max(r["size"] for r in rows)
    assert all(abs(sizes.get(j, 0) - c) <= largest for j, c in enumerate(capacities))
    old = Counter()
    for r in rows:
        old[r["old_shard"]] += r["size"]
    least = sum(s - min(s, capacities[i] if i < R.SHARDS else 0) for i, s in old.items())
    moved = sum(r["size"] for r in rows if r["shard"] != r["old_shard"])
    assert moved <= least + R.OLD_SHARDS * largest
    assert sorted(map(tuple, rows)) == sorted(map(tuple, R.reshard(table.repartition(7)).collect()))  # however the rows are dealt


def test_hard_inputs_and_no_rows(spark):
    table = hard(spark, 3)
    rows = R.reshard(table).collect()
    assert len(rows) == table.count()
    check_law(rows, None)
    assert R.reshard(empty(spark)).count() == 0
    copies = spark.range(1000).select("id", F.lit("the same text").alias("text"), F.lit("one").alias("source")).withColumnRenamed("id", "doc_id")
    sizes = check_law(R.reshard(copies).collect(), None)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 14


def test_only_torn_files_are_rewritten(spark, tmp_path):
    table = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.lit(1).alias("SHARD"), F.create_map(F.lit("k"), "id").alias("m"))
    old = R.written_shards(table.repartition(4), F.when(F.col("doc_id") < 400, 0).otherwise(1), f"file://{tmp_path}/old")
    before = {r["path"]: r["shard"] for r in old.collect()}
    new = R.rewrite(spark, old, 3, f"file://{tmp_path}/new")
    after = {r["path"]: r["shard"] for r in new.collect()}
    rows = R.rows_of(spark, new)
    assert sorted((r["doc_id"], r["text"]) for r in rows.select("row.doc_id", "row.text").collect()) == sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    sizes = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum(F.length("row.text") + 1).alias("n")).collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 50
    torn = set(before) - set(after)
    assert len(torn) <= 4 and all("/new/" in p for p in set(after) - set(before))  # cuts tear a file each, the others stay as they are
    assert {r["path"]: r["shard"] for r in old.collect()} == before
