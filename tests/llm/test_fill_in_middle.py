"""Fill-in-middle against SQL and plain strings, and round trips."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import HARD, SMALL, docs, empty, hard

from compare import rows, same
from loomgraph.llm import common as C
from loomgraph.llm import fill_in_middle as M
from loomgraph.llm import queries

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    tokens, sha = TOKEN.findall(text or ""), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sha[8 * k : 8 * k + 8], 16) for k in range(4))
    text, n = text or "", len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_query_matches_sql(spark, duck):
    got = queries.QUERIES["op13_fill_in_middle"](spark, SMALL).toPandas()
    assert same(rows(got), rows(duck.execute(M.ORACLE_SQL).df()))
    assert {"plain", "psm", "spm"} == set(got["form"])


TRICKY = ["<", "<S", "<P", "a<M", "x<P>y", "<S>", "<M>", "é<日本", "<<<<>>>>", "A" * 200_000 + "é", "日" * 100_000]


def test_against_plain_strings_and_back(spark):
    texts = [*HARD, *TRICKY] * 6
    table = spark.createDataFrame([(i if i % 11 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r["row"]["n"]: r for r in M.transform(table).collect()}
    for i, t in enumerate(texts):
        n, form, _, _, output = plainly(i if i % 11 else None, t)
        assert (got[i]["form"], got[i]["output"]) == (form, output)
    assert {r["row"]["n"]: r["text"] for r in M.restore(M.transform(table)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    digests = sorted(M.digests(table).drop("doc_id").collect(), key=str)
    want = []
    for i, t in enumerate(texts):
        n, form, prefix, middle, output = plainly(i if i % 11 else None, t)
        want.append((n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r) for r in digests), key=str) == sorted(want, key=str)


def test_hard_inputs(spark):
    assert M.digests(hard(spark)).count() == hard(spark).count()
    clash = hard(spark).withColumn("FORM", F.lit(1)).withColumn("output", F.create_map(F.lit("k"), F.lit(2))).withColumn("sha", F.lit("s"))
    back = M.restore(M.transform(clash))
    assert back.count() == clash.count() and back.select("row.*").columns == clash.columns
    assert M.digests(empty(spark)).count() == 0 and M.restore(M.transform(empty(spark))).count() == 0


def test_pieces():
    texts = C.Texts.of(pa.array(["one two"]))
    buffers = (memoryview(np.ascontiguousarray(texts.data)).cast("B"),)
    whole = M.PieceTable(buffers, ((0, 0, 7),))
    table = whole.cut(3).cut(7)
    assert table.pieces == ((0, 0, 3), (0, 3, 4), (0, 7, 0))
    assert table.arranged((2, 0, 1)).restored((2, 0, 1)) == table
    with pytest.raises(ValueError):
        whole.cut(8)
    with pytest.raises(ValueError):
        M.read_output(b"<P>a<S>b", "psm")
    with pytest.raises(ValueError):
        M.read_output(b"a<P>b<S>c<M>d", "psm")
