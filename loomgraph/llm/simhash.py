"""SimHash near-dedup with multi-index hashing.

A text's words (A-Z lower-cased) form 3-word shingles, joined by one space; a bit of the fingerprint is 1 if it is set in over
half of the shingles' XXH64 values (seed 42). The hashes are computed in numpy for a chunk of texts at once.

Fingerprints within 3 bits agree within 1 bit in one of their two 32-bit halves. Each distinct fingerprint stands in a
table under both halves, and asks for every value in the ball of radius 1 about its halves; of two values that differ in
one bit, only the one without it asks, so a pair is found once a half. Answers are verified over all 64 bits inside
the join. Copies share a fingerprint and so take one row, however many they are.

Where more than CROWD distinct fingerprints share a half, comparing all of their pairs would grow with the square, so
such halves are asked finer: the key then also holds a 16-bit quarter of the other half, which one of its two
quarters matches within 1 bit, so only fingerprints alike in 48 bits, or nearly, meet. No pair is lost.

Nulls: a null text, or one without words, has the fingerprint 0, linked like any other. Fewer than 3 words are one
shingle. A null doc_id takes part and is never the least of its component unless alone (then it is null). Rows that share a doc_id
are documents of their own, each with its fingerprint; ties of fingerprints are links. An empty table gives no rows. near_dedup reads doc_id
and text only; one_of_each keeps all columns. A very long text is a chunk of its own, some 100 bytes of memory for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import common as C
from loomgraph.operators.components import connected_components

WORDS, SEED, DISTANCE = 3, 42, 3
#: Distinct fingerprints that share a half from which on it is indexed finer.
CROWD = 1000


def spaced(texts: C.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with one space between, lower-cased: the buffer, each word's start and end, words before each document."""
    starts, ends, firsts = C.words(texts)
    size = ends - starts + 1
    end = np.cumsum(size) - 1
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    out[C.ragged(end - size + 1, size - 1)] = C.LOWER[texts.data[C.ragged(starts, size - 1)]]
    return out, end - size + 1, end, firsts


def fingerprints_of(texts: C.Texts) -> np.ndarray:
    data, starts, ends, firsts = spaced(texts)
    count = np.diff(firsts)
    n_shingles = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    first = C.ragged(firsts[:-1], n_shingles)
    last = np.minimum(first + WORDS - 1, np.repeat(firsts[1:], n_shingles) - 1)
    hashes = C.span_hashes(data, starts[first], ends[last], SEED, below=32)
    out = np.zeros(texts.n, np.uint64)
    some = np.flatnonzero(n_shingles)
    if len(some):
        begin = np.cumsum(n_shingles[some]) - n_shingles[some]
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        over = 2 * np.add.reduceat(bits, begin, axis=0, dtype=np.int64) > n_shingles[some][:, None]
        out[some] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed number) of every text."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fingerprints_of(C.Texts.of(batch.column("text"))).view(np.int64))}

    return C.map_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id bigint, fp bigint", work, most=C.SMALL_CHUNK_BYTES)


def half(fp: Column, which: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if which == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def ball(value: Column, bits: int) -> Column:
    """The value, and it with each of its missing bits: as (key, whether nothing changed)."""
    powers = F.array(*[F.lit(1 << i) for i in range(bits)])
    added = F.filter(F.transform(powers, lambda p: F.when(value.bitwiseAND(p) == 0, value.bitwiseOR(p))), lambda x: x.isNotNull())
    return F.concat(F.array(F.struct(value.alias("key"), F.lit(True).alias("same"))), F.transform(added, lambda x: F.struct(x.alias("key"), F.lit(False).alias("same"))))


def quarters(fp: Column, which: Column, ball_of: Column | None = None) -> Column:
    """The two quarters of the half that is not `which`, as (quarter, part); with ball_of, all values within 1 bit of each."""
    other = F.when(which == 0, half(fp, 1)).otherwise(half(fp, 0))
    parts = []
    for i in (0, 1):
        value = F.shiftrightunsigned(other, 16) if i else other.bitwiseAND(F.lit(0xFFFF))
        near = F.transform(F.array(*[F.lit(m).cast("bigint") for m in ([0] if ball_of is None else [0, *(1 << k for k in range(16))])]), lambda m, value=value: value.bitwiseXOR(m))
        parts.append(F.transform(near, lambda x, i=i: F.struct(F.lit(i).cast("tinyint").alias("quarter"), x.alias("part"))))
    return F.concat(*parts)


def near_pairs(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (src, dst) of distinct fingerprints within 3 bits, some of them twice."""
    fp = F.col("fp")
    halves = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("half"), half(fp, i).alias("value")) for i in (0, 1)])
    table = distinct.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", F.col("h.value").alias("key"))
    asks = table.select("fp", "half", F.explode(ball(F.col("key"), 32)).alias("b")).select(F.col("fp").alias("src"), "half", "b.key", "b.same")
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("fp"))) <= DISTANCE
    once = (~F.col("same")) | (F.col("src") < F.col("fp"))
    crowded = C.checkpointed(table.groupBy("half", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("half", "key"))
    if crowded.isEmpty():
        return asks.join(table, ["half", "key"]).where(close & once).select("src", F.col("fp").alias("dst"))
    plain = asks.join(table.join(crowded, ["half", "key"], "left_anti"), ["half", "key"]).where(close & once)
    fine_table = table.join(crowded, ["half", "key"], "left_semi").select("*", F.explode(quarters(fp, F.col("half"))).alias("q"))
    fine_asks = asks.join(crowded, ["half", "key"], "left_semi").select("*", F.explode(quarters(F.col("src"), F.col("half"), F.col("src"))).alias("q"))
    fine = fine_asks.join(fine_table, ["half", "key", "q"]).where(close & once)
    return plain.select("src", F.col("fp").alias("dst")).unionAll(fine.select("src", F.col("fp").alias("dst")))


def components_of(own: DataFrame) -> DataFrame:
    """(fp, component, least): the component of every fingerprint of own(doc_id, fp), and the fingerprint's least doc_id."""
    distinct = C.checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(near_pairs(distinct.select("fp")))
    return distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of every document."""
    own = C.checkpointed(fingerprints(docs))
    grouped = components_of(own)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = grouped.join(least, "component").select("fp", "component_id")
    return own.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _hashable(field: T.StructField) -> Column:
    """The column, as text if it holds maps, which Spark does not hash (entries in another order then make another row)."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, of each component one: of least doc_id (null last), and of rows that share it, of least hash over all columns.

    Rows are told apart by two 64-bit hashes over all columns, not by doc_id, so a row of its own stays though
    another row of its id is a copy. Of rows that are equal in all columns one stays.
    """
    every = [x for f in docs.schema.fields for x in (_hashable(f), F.col(f"`{f.name}`").isNull())]
    one, two = F.xxhash64(*every), F.xxhash64(F.lit(1), *every)

    def work(batch: pa.RecordBatch) -> dict:
        marks = fingerprints_of(C.Texts.of(batch.column("text"))).view(np.int64)
        return {name: batch.column(name) for name in ("doc_id", "one", "two")} | {"fp": pa.array(marks)}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), one.alias("one"), two.alias("two"), "text")
    own = C.checkpointed(C.map_texts(rows, "doc_id bigint, one bigint, two bigint, fp bigint", work, most=C.SMALL_CHUNK_BYTES))
    counted = own.groupBy("fp", "doc_id", "one", "two").agg(F.count("*").alias("n"))
    first = counted.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "one", "two", "n")).alias("w"))  # so no join meets all copies of a text
    first = first.join(components_of(own).select("fp", "component"), "fp").groupBy("component").agg(F.min("w").alias("w"))
    kept = C.checkpointed(first.select("w.one", "w.two", "w.n"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), one.alias("one"), two.alias("two")).join(kept, ["one", "two"])
    return whole.where("n = 1").unionByName(whole.where("n > 1").dropDuplicates(["one", "two"])).select("row.*")
