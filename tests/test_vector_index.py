"""The vector index: recall against exact neighbours, pruned lists, and vectors that cannot be indexed."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from conftest import SMALL

from loomgraph.operators import retrieval
from loomgraph.operators import vector_index as V


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_every_twentieth_vector(spark, tmp_path, sf):
    vectors = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0")
    index = V.open_index(spark, vectors, f"file://{tmp_path}/index")
    found, exact = V.search(index, vectors, asked), retrieval.nearest_vectors(vectors, asked)
    row = V.recall(found, exact).first()
    assert row["neighbours"] == 5 * asked.count() and row["recall"] >= 0.9
    close = found.join(exact.withColumnRenamed("score", "want").select("query", "vec_id", "want"), ["query", "vec_id"])
    assert close.where("abs(score - want) > 2e-6").count() == 0 and found.where("query = vec_id").count() == 0


def test_all_lists_and_candidates_give_exact_neighbours(spark, tmp_path):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0")
    index = V.open_index(spark, vectors, f"file://{tmp_path}/index")
    found = V.search(index, vectors, asked, probed=1.0, again=100)
    exact = retrieval.nearest_vectors(vectors, asked)
    assert sorted((r["query"], r["vec_id"], r["rank"]) for r in found.collect()) == sorted((r["query"], r["vec_id"], r["rank"]) for r in exact.collect())


def test_a_search_reads_the_lists_it_probes_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(8)[i % 8] + rng.normal(scale=0.01, size=8)).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = V.fit(vectors, f"file://{tmp_path}/{uuid.uuid4().hex}", lists=8)
    V.write_index(vectors, index)
    lists = spark.read.parquet(index.folder)
    assert lists.count() == 400 and lists.select("list").distinct().count() == 8
    found = V.search(index, vectors, vectors.where("vec_id = 3"), probed=0.1)
    assert {r["vec_id"] % 8 for r in found.collect()} == {3}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_vectors_without_direction(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 0.0]), (5, [0.9, 0.1, 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = V.open_index(spark, vectors, f"file://{tmp_path}/index")
    assert [(r["query"], r["vec_id"]) for r in V.search(index, vectors, vectors).orderBy("query").collect()] == [(4, 5), (5, 4)]
    assert V.open_index(spark, vectors.limit(0), f"file://{tmp_path}/none") is None
    assert V.search(index, vectors, vectors.limit(0)).count() == 0
