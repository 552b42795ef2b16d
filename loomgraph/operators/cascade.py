"""Cascades of changes through bindings, as a semi-naive fixpoint: only what the last round derived first derives further."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.session import piled, together, written


#: Bindings up to which they are sent to the tasks, each of which follows roots of its own, and roots of a task about.
SENT, ROOTS = 1_000_000, 64


def _sent_cascade(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """As cascade, for so few bindings that each task holds all: no rounds of joins, and what roots have reached is only kept for one root at a time."""
    schema = "root string, target string, depth int, via string, action string"
    least = steps.groupBy("source", "target").agg(F.min(F.struct("action"))["action"].alias("action")).toPandas()
    if least.empty:
        return roots.select("root", F.col("root").alias("target"), F.lit(0).alias("depth"), F.col("root").alias("via"), F.col("root").alias("action")).limit(0)
    names, ends = np.unique(np.concatenate([least["source"].to_numpy(dtype=object), least["target"].to_numpy(dtype=object)]), return_inverse=True)
    kinds, kind = np.unique(least["action"].fillna("").to_numpy(dtype=object), return_inverse=True)
    source, target = ends[: len(least)].astype(np.int32), ends[len(least) :].astype(np.int32)
    order = np.argsort(source, kind="stable")  # numbers of names are in their order
    target, kind = target[order], np.where(least["action"].isna(), -1, kind)[order].astype(np.int32)
    begin = np.searchsorted(source[order], np.arange(len(names) + 1)).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, labels, does = {name: i for i, name in enumerate(names)}, pa.array(names.tolist(), pa.string()), pa.array(kinds.tolist(), pa.string())
        seen = np.zeros(len(names), bool)
        for root in (root for batch in batches for root in batch.column("root").to_pylist() if root in place):
            own, depth, told = place[root], 0, []
            at = np.array([own], np.int32)
            while len(at):
                depth += 1
                n = begin[at + 1] - begin[at]
                edge = np.repeat(begin[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                fresh = ~seen[target[edge]]
                edge, via = edge[fresh], np.repeat(at, n)[fresh]
                to, first = np.unique(target[edge], return_index=True)  # at is in order, so the first is the least via
                seen[to] = True
                told.append((to, np.full(len(to), depth, np.int32), via[first], kind[edge[first]]))
                at = to[to != own]
            to, depths, via, action = (np.concatenate(x) for x in zip(*told))
            seen[to] = False
            if len(to):
                columns = pa.array([root] * len(to), pa.string()), labels.take(pa.array(to)), pa.array(depths), labels.take(pa.array(via)), does.take(pa.array(action, mask=action < 0))
                yield pa.RecordBatch.from_arrays(list(columns), ["root", "target", "depth", "via", "action"])

    n = roots.count()
    return roots.repartition(max(1, -(-n // ROOTS)), "root").mapInArrow(run, schema)


def cascade(changes: DataFrame, bindings: DataFrame) -> DataFrame:
    """(root, target, depth, via, action) of everything that changes (name) reach through bindings (source, target, action).

    Each pair of root and target is derived once, in the round that reaches it first; via is the least of the names that reach it in that round, and
    action the least of the actions on that binding. A root that its own cascade reaches again is told once, and led no further: bindings that go
    round end there. Names of null are left out.
    """
    steps = written(bindings.where("source IS NOT NULL AND target IS NOT NULL").select("source", "target", "action").distinct())
    roots = changes.select(F.col("name").alias("root")).where("root IS NOT NULL").distinct()
    if steps.count() <= SENT:
        return _sent_cascade(roots, steps)
    new, seen, depth = written(roots.select("root", F.col("root").alias("at"))), [], 0
    while True:
        depth += 1
        reached = new.join(steps, F.col("at") == F.col("source")).groupBy("root", "target").agg(F.min(F.struct("at", "action")).alias("by"))
        if seen:
            reached = reached.join(together(seen).select("root", "target"), ["root", "target"], "left_anti")
        found = written(reached.select("root", "target", F.lit(depth).alias("depth"), F.col("by.at").alias("via"), F.col("by.action").alias("action")))
        if found.isEmpty():
            return together(seen) if seen else found
        seen = piled(seen, found)
        new = found.where("target <> root").select("root", F.col("target").alias("at"))


def circles(cascaded: DataFrame) -> DataFrame:
    """(root, length): roots that their own cascades reach again, and after how many bindings."""
    return cascaded.where("root = target").select("root", F.col("depth").alias("length"))


def stale(cascaded: DataFrame) -> DataFrame:
    """Targets that some cascade invalidates, with the number of its roots."""
    return cascaded.where("action = 'invalidate_downstream'").groupBy("target").agg(F.count_distinct("root").alias("roots"))
