"""Small inputs that show what only large tables would: sides of joins that go to every task, long texts."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from compare import rows, same
from conftest import SMALL
from pyspark.sql import functions as F

from loomgraph.operators import cascade, communities, containment, context, dedup, grading, match, modularity, resolver, retrieval
from loomgraph.plans import registry
from loomgraph.plans.bindings import Graph
from loomgraph.plans.session import written


def joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_of_names_are_dealt_out_not_broadcast(spark):
    names = written(spark.createDataFrame([("T", f"Customer#{i:09d}") for i in range(20)], "label string, n string"))
    plan = joins(dedup.close_by_edits(names))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_short_names_of_one_length_are_neither_told_apart_nor_written(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"p{i}", "P", f"Customer#{i:09d}") for i in range(150)], "uid string, label string, name string")
    sizes, plain = [], dedup.checkpointed
    monkeypatch.setattr(dedup, "checkpointed", lambda df: sizes.append((t := plain(df)).count()) or t)
    digits = [f"{i:03d}" for i in range(150)]
    alike = lambda a, b: sum(x != y for x, y in zip(a, b)) <= 2 or any(a[:i] + a[i + 1 :] == b[:j] + b[j + 1 :] for i in range(3) for j in range(3))
    want = {(f"customer#000000{a}", f"customer#000000{b}") for a in digits for b in digits if a < b and alike(a, b)}
    got = [(r["x"], r["y"]) for r in dedup.similar_names(nodes).collect()]
    assert set(got) >= want and len(got) == len(set(got)) > 5_000
    assert max(sizes) < len(got) / 2  # before, all pairs
    monkeypatch.setattr(dedup, "LENGTHS", 0)
    assert sorted((r["x"], r["y"]) for r in dedup.similar_names(nodes).collect()) == sorted(got)


def test_members_of_communities_are_dealt_out_not_broadcast(spark):
    pairs = written(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, weight double"))
    members = written(spark.createDataFrame([(0, u, "x") for u in "abc"], "tier int, uid string, community string"))
    plan = joins(modularity.quality(pairs, members))
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_html_lines_are_those_of_the_cut_text(spark, tmp_path):
    html = "<p>" + "</p><p>".join(f"a line of some words with number {i}" for i in range(3000)) + "</p>"
    spark.createDataFrame([(1, "u", html), (2, "u", "<p>short</p>"), (3, "u", "<p>a line of more than twenty characters</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for other in ("part", "supplier", "customer", "nation", "region", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {other} AS SELECT * FROM read_parquet('{SMALL}/{other}.parquet')")
    got = registry.QUERIES["html_to_text"](spark, str(tmp_path)).toPandas()
    want = con.execute(registry.ORACLE_SQL["html_to_text"]).df()
    assert rows(got) == rows(want) and same(rows(got), rows(want))
    assert dict(zip(got["page_id"], got["n_lines"]))[1] < 3000


def test_every_document_of_a_passage_has_a_row(spark, tmp_path):
    import __spark_entry__ as entry

    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    rows = [(i, " ".join(words(f"before{i}x", 30) + words("shared", 60) + words(f"after{i}x", 30))) for i in range(1, 7)]
    rows += [(7, " ".join(words("other", 200))), (8, rows[3][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["op2_compact_windows"](spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got if r["kind"] == "passage"} == {1, 2, 3, 4, 5, 6}
    assert {(r["doc_id"], r["match_doc_id"]) for r in got if r["kind"] == "copy"} == {(8, 4), (4, 4)}
    assert all((r["first_word"], r["last_word"], r["match_first_word"]) == (30, 89, 30) for r in got if r["kind"] == "passage")


def test_words_are_found_without_a_row_for_each_piece_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(containment, "CHARACTERS", 5)  # several blocks of words
    texts = written(spark.createDataFrame([(1, "abc abd"), (2, "xabcx"), (2, "zz"), (3, None), (4, "")], "uid int, text string"))
    words = spark.createDataFrame([("abc",), ("bd",), ("zz",), ("nowhere",), ("",), (None,), ("abc",)], "word string")
    found = containment.contained(words, texts)
    assert sorted(tuple(r) for r in found.collect()) == [("abc", 1), ("abc", 2), ("bd", 1), ("zz", 2)]
    assert "Generate" not in joins(found)
    assert sorted(r["word"] for r in containment.standing(words, texts).collect()) == ["abc", "bd", "zz"]


def test_grades_shuffle_no_texts_of_names(spark):
    answers = spark.createDataFrame([("q", "easy", "Alpha and Beta say", ["Alpha"], ["say"])], "question string, difficulty string, answer string, entities array<string>, topics array<string>")
    grades = grading.graded(answers, written(spark.createDataFrame([("the alpha node",), ("other",)], "name string")))
    assert [(r["n_cited"], r["n_grounded"]) for r in grades.collect()] == [(2, 1)]
    assert "hashpartitioning(text" not in joins(grades) and "regexp_extract_all(text" not in joins(grades)


def test_nearest_vectors_of_a_task_are_merged_over_its_batches(monkeypatch):
    monkeypatch.setattr(retrieval, "SCORES", 50)
    monkeypatch.setattr(retrieval, "ROWS", 16)
    made = np.round(np.random.default_rng(5).normal(size=(200, 3)), 1)
    asked = np.arange(0, 200, 20)
    unit = retrieval._unit(pd.Series(list(made)))
    batches = [pd.DataFrame({"vec_id": np.arange(i, 200, 4)[::-1], "embedding": list(made[i::4][::-1])}) for i in range(4)]
    out = list(retrieval._nearest(asked, unit[asked], 5)(iter(batches)))
    got = pd.concat(out)
    assert len(out) == 1 and len(got) == 50  # before, 5 rows of each query for every batch
    for q in asked:
        score = np.round(unit @ unit[q], 6)
        want = sorted((-score[v], v) for v in range(200) if v != q)[:5]
        assert sorted((-s, v) for v, s in got[got["query"] == q][["vec_id", "score"]].itertuples(index=False)) == want


def test_names_of_the_same_words_are_scored_once(spark, monkeypatch):
    names = ["red gear", "Gear red", "blue gear", "red wheel", "", "gear gear", "Order 7"]
    nodes = spark.createDataFrame([(f"n{i:03d}", names[i % len(names)]) for i in range(140)] + [("z", None)], "uid string, name string")
    mentions = spark.createDataFrame([("red gear",), ("wheel",), ("gear",), ("nothing",)], "mention string")
    scored = []
    monkeypatch.setattr(resolver, "bm25", lambda index, *rest: scored.append(index.select("key").distinct().count()) or retrieval.bm25(index, *rest))
    got = sorted(tuple(r) for r in resolver.full_text(mentions, nodes).collect())
    plain = nodes.where("name IS NOT NULL").select("uid", F.col("name").alias("text"))
    sizes = F.size(F.filter(F.split(F.lower("text"), resolver.TERM), lambda t: t != ""))
    totals = plain.select(sizes.alias("size")).agg(F.count("*").alias("n"), F.avg("size").alias("mean_size"))
    asked = mentions.select(F.col("mention").alias("query"), F.explode(F.split("mention", " ")).alias("term"))
    want = retrieval.bm25(retrieval.postings(plain, "uid"), totals, asked, "uid", resolver.BEST)
    assert got == sorted((r["query"], r["uid"], round(r["score"] / 2.2, 6)) for r in want.collect())
    assert scored == [5]  # bags with words, not nodes


def test_questions_of_the_same_mentions_are_resolved_once(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"t{i:02d}", "Technology", "red gear") for i in range(30)] + [("n", "Topic", "Gearland")], "uid string, label string, name string")
    mentions = spark.createDataFrame([(q, m) for q in range(40) for m in (("red gear", "land") if q % 2 else ("land", None, "red gear", "land"))] + [(99, "land")], "question int, mention string")
    sizes, plain = [], resolver.written
    monkeypatch.setattr(resolver, "written", lambda df: sizes.append((t := plain(df)).count()) or t)
    got = [tuple(r) for r in resolver.resolved(mentions, nodes).collect()]
    assert len(got) == 40 * 31 + 1 and {r[1:] for r in got if r[0] == 7} == {r[1:] for r in got if r[0] == 8}
    assert sorted(r[5] for r in got if r[0] == 7) == list(range(1, 32)) and (99, "n", "Topic", "Gearland", 8.0, 1) in got
    assert max(sizes) == 41  # before, 1,241: every node of every question


def test_sums_of_grades_do_not_grade_again(spark):
    answers = spark.createDataFrame([("q", "easy", "Alpha and Beta say", ["Alpha"], ["say"]), ("r", None, None, [], [])], "question string, difficulty string, answer string, entities array<string>, topics array<string>")
    sums = grading.summary(grading.graded(answers, spark.createDataFrame([("the alpha node",)], "name string")))
    assert "regexp_extract_all" not in joins(sums) and "contains" not in joins(sums).lower()
    assert sorted((r["difficulty"], r["n"], r["good"], r["no_answer"]) for r in sums.collect()) == [("easy", 1, 1, 0), ("overall", 2, 1, 1), ("unknown", 1, 0, 1)]


def test_rounds_of_a_cascade_are_few_tables(spark):
    bindings = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", "notify") for i in range(20)], "source string, target string, action string")
    got = cascade.cascade(spark.createDataFrame([("n00",)], "name string"), bindings)
    assert joins(got).count("Scan parquet") < 10  # before, one for each of 20 rounds
    assert sorted((r["target"], r["depth"]) for r in got.collect()) == [(f"n{i:02d}", i) for i in range(1, 21)]


def test_lines_of_shared_nodes_are_looked_up_once_they_fit(spark):
    nodes = [("a", "Technology", "A", None, 0.0), ("b", "Technology", "B", None, 0.0), ("o", "Organization", "Org", None, 0.0), ("odd", "Unknown", "Odd", None, 0.0)]
    nodes += [(f"c{i}", "Claim", None, f"claim {i} " + "x" * (40 * i), i / 20) for i in range(1, 20)] + [("big", "Claim", None, "y" * 5000, 0.99), ("b", "Technology", "A second", None, 0.0)]
    nodes = spark.createDataFrame(nodes, "uid string, label string, name string, content string, confidence double")
    edges = [("a", "o", "a", "DEVELOPS", 0.7), ("a", "a", "b", "DEPENDS_ON", 0.6), ("b", "a", "b", "DEPENDS_ON", 0.6), ("a", "a", "a", "DEPENDS_ON", None), ("a", "gone", "a", "DISCUSSES", 0.8), ("b", "big", "b", "CLAIMS", 0.9), ("no seed", "a", "b", "DEPENDS_ON", 0.1)]
    edges = spark.createDataFrame(edges + [("a", "o", f"c{i}", "CLAIMS", 0.9) for i in range(1, 20)], "seed string, src string, dst string, type string, confidence double")
    seeds = spark.createDataFrame([("a",), ("b",), ("odd",)], "seed string")
    got = dict(tuple(r) for r in context.around(seeds, edges, nodes).collect())
    own = edges.join(seeds, "seed")
    members = own.select("seed", F.explode(F.array("seed", "src", "dst")).alias("uid")).unionByName(seeds.withColumn("uid", F.col("seed"))).distinct()
    want = context.context_texts(members.join(nodes, "uid"), own)
    assert got == dict(tuple(r) for r in want.collect()) and len(got) == 3
    assert "claim 19" in got["a"] and "y" * 10 not in got["b"] and got["odd"] == context.TITLE


def test_contexts_shuffle_no_text_for_each_seed(spark):
    plan = joins(registry.QUERIES["context_texts"](spark, SMALL))
    assert plan.count("Scan parquet") < 10  # before, every table was read once for each step


def test_neighbours_of_few_kinds_carry_no_texts(spark):
    plan = joins(registry.QUERIES["related_entities"](spark, SMALL))
    assert "documents.parquet" not in plan and "orders.parquet" not in plan  # before, the texts of all claims were shuffled for their names


def test_neighbours_are_those_of_both_ways(spark):
    edges = [("a", "b", "T"), ("b", "a", "T"), ("a", "b", "T"), ("a", "b", "U"), ("c", "c", "T"), ("d", "a", "T"), (None, "a", "T"), ("a", None, "T"), ("d", "gone", "T"), (None, None, "T")]
    edges = spark.createDataFrame(edges, "src string, dst string, type string")
    nodes = spark.createDataFrame([(u, u.upper()) for u in "abcd"], "uid string, name string")
    want = match.both_ways(edges).distinct().join(nodes.withColumnRenamed("uid", "dst"), "dst").select(F.col("src").alias("uid"), "type", F.col("dst").alias("neighbour"), "name")
    got = match.neighbours(nodes, edges)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(got) == key(want) and len(key(got)) == 9


def test_neighbours_are_over_edges_of_all_types(spark):
    got = registry.QUERIES["related_entities"](spark, SMALL).select("type").distinct()
    assert {r["type"] for r in got.collect()} == {r["type"] for r in Graph(spark, SMALL).edges.select("type").distinct().collect()}  # before, two of nine


def test_neighbours_are_named_once_the_first_are_known(spark):
    edges = spark.createDataFrame([("hub", f"n{i:02d}", "T") for i in range(30)] + [("hub", "gone", "T"), ("hub", "a0", "U")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("hub", "Hub"), ("a0", "A")] + [(f"n{i:02d}", None if i == 3 else f"N{i}") for i in range(1, 30)], "uid string, name string")
    got = match.neighbours(nodes, edges)
    assert sorted(tuple(r)[2] for r in got.where("uid = 'hub'").collect()) == [f"n{i:02d}" for i in range(1, 21)]


def test_links_of_levels_tell_members_apart_once(spark):
    lower = written(spark.createDataFrame([("t1", "x"), ("t2", "x"), ("t3", "y"), ("t1", "x")], "uid string, community string"))
    upper = written(spark.createDataFrame([("n1", "r"), ("n2", "r")], "uid string, community string"))
    discusses = written(spark.createDataFrame([("a", "t1"), ("a", "t1"), ("a", "t2"), ("b", "t1"), ("b", "t3")], "src string, dst string"))
    tagged = written(spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n2")], "src string, dst string"))
    links = communities.cross_level_links(lower, discusses, tagged, upper)
    assert sorted(map(tuple, links.collect())) == [("x", "r", 2), ("y", "r", 1)]
    assert links._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 6  # before, 8
