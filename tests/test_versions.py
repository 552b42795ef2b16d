"""Versioned tables, refinement in steps, and incremental ingest."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import refine
from loomgraph.sources import ingest
from loomgraph.sources.versions import Versions

EDGE = "src string, dst string, type string, source string, weight double"
CLAIM = f"uid string, claim_type string, confidence double, confidence_decay double, valid_from date, valid_until date, last_verified date, related_entities array<string>, history array<{refine.ENTRY}>"


def tables(spark, root):
    edges = [("p1", "t1", "DISCUSSES", "x", None), ("p1", "t2", "MENTIONS", "x", None), ("p2", "t1", "DISCUSSES", "x", 1.0), ("p2", "t2", "CLAIMS", "x", None), ("p3", "t1", "WRITTEN_BY", "x", None), ("p3", "t2", "DISCUSSES", "x", None)]
    edges += [("t1", "t2", "USES", "extractor", None), ("t1", "t2", "USES", "extractor", 1.0), ("t1", "t2", "USES", "extractor", 5.0), ("t2", "t1", "USES", "rule", None), ("a", "b", "CONTRADICTS", "rule", None)]
    day = lambda s: None if s is None else __import__("datetime").date.fromisoformat(s)
    rows = [("a", "fact", 0.9, 0.1, "2024-01-01", None, None, ["X"]), ("b", "fact", 0.2, 0.1, "2026-01-01", None, None, ["x"]), ("c", "fact", 0.15, None, "2025-06-01", None, "2025-12-31", ["x", "X"]), ("d", "fact", 0.1, 0.0, "2024-01-01", None, None, ["y"]), ("e", "fact", 0.9, 0.1, "2020-01-01", "2021-01-01", None, ["x"])]
    claims = [(u, k, c, r, day(f), day(t), day(v), e, None) for u, k, c, r, f, t, v, e in rows]
    return Versions.create(spark, root, {"edges": spark.createDataFrame(edges, EDGE), "claims": spark.createDataFrame(claims, CLAIM)})


def test_refinement_in_steps(spark, tmp_path):
    own = tables(spark, f"file://{tmp_path}/v")
    assert tuple(refine.refine(own, "2026-01-01").first()) == (2, 1, 1, 1)  # the weight of 5 stays; a decays; a and c differ; d is old and weak
    assert own.current() == 3
    assert sorted(r["weight"] or 0 for r in own.read("edges").where("type = 'USES'").collect()) == [0, 2.0, 2.0, 5.0]
    claims = {r["uid"]: r for r in own.read("claims").collect()}
    assert claims["a"]["confidence"] == pytest.approx(0.729, abs=1e-3) and str(claims["a"]["last_verified"]) == "2026-01-01"
    assert [h["reason"] for h in claims["a"]["history"]] == ["initial baseline", "temporal decay"] and claims["a"]["history"][0]["confidence"] == 0.9
    assert len(claims["e"]["history"]) == 1 and own.read("claims", 1).where("history IS NOT NULL").count() == 0  # the first version is still there
    again = refine.refine(own, "2026-01-01").first()
    assert again["confidence_decayed"] == 0 and again["weights_updated"] == 0


def test_a_failed_step_leaves_the_version_before_it(spark, tmp_path):
    own = tables(spark, f"file://{tmp_path}/v")
    broken = own.read("claims").withColumn("confidence", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        own.publish({"edges": own.read("edges"), "claims": broken}, 1)
    assert own.current() == 1 and own.read("claims").count() == 5
    own.publish({"edges": own.read("edges").limit(1)}, 1)
    with pytest.raises(RuntimeError):
        own.publish({"edges": own.read("edges")}, 1)
    assert own.read("edges").count() == 1 and own.read("claims").count() == 5
    with pytest.raises(ValueError):
        own.read("claims", 7)


def test_recorded_changes_append(spark, tmp_path):
    claims = tables(spark, f"file://{tmp_path}/v").read("claims")
    one = refine.recorded(claims, spark.createDataFrame([("a", 0.5)], "uid string, new double"), "2026-02-01", "reviewed")
    two = refine.recorded(one, spark.createDataFrame([("a", 0.4)], "uid string, new double"), "2026-03-01", "reviewed again")
    row = two.where("uid = 'a'").first()
    assert [(str(h["date"]), h["confidence"], h["reason"]) for h in row["history"]] == [("2026-02-01", 0.5, "reviewed"), ("2026-03-01", 0.4, "reviewed again")] and row["confidence"] == 0.4
    assert two.where("uid <> 'a' AND history IS NOT NULL").count() == 0


def article(folder, name, title):
    with open(os.path.join(folder, name), "w") as f:
        f.write(f"---\ndate: 2026-03-01\ncategories: [a]\n---\n# {title}\n")


def test_a_second_run_reads_nothing_and_a_killed_batch_leaves_nothing_twice(spark, tmp_path):
    folder, into, state = str(tmp_path / "in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    os.makedirs(folder)
    article(folder, "2026-03-01-one.md", "One")
    article(folder, "2026-03-01-two.md", "Two")
    assert ingest.ingest(spark, folder, into, state) == 1
    assert ingest.ingest(spark, folder, into, state) == 0
    assert {r["title"] for r in ingest.ingested(spark, into).collect()} == {"One", "Two"}

    def killed(number):
        raise RuntimeError("killed once it had written")

    article(folder, "2026-03-02-three.md", "Three")
    article(folder, "2026-04-01-one.md", "One, told anew")
    with pytest.raises(Exception, match="killed"):
        ingest.ingest(spark, folder, into, state, after=killed)
    assert ingest.ingest(spark, folder, into, state) == 1
    rows = spark.read.parquet(into)
    assert rows.count() == 4 and rows.select("batch").distinct().count() == 2
    assert sorted(r["title"] for r in ingest.ingested(spark, into).collect()) == ["One, told anew", "Three", "Two"]
