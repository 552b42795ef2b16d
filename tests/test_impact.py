"""Operators of impact, two-level communities, loads and question entities on hand-made rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import communities, impact, loading, retrieval
from loomgraph.plans.registry import ORACLE_SQL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_question_entities(spark):
    asked = spark.createDataFrame(
        [
            ("What does Graph Store and graph store do for RAG?", ["Kite", "RAG"]),
            ("환각 문제를 왜 다루나", None),
            ("plain words only, nothing else here", None),
            ("Mamba? yes, tell more of it", None),
            ("", None),
            (None, ["x"]),
        ],
        "q string, added array<string>",
    )
    got = [r[0] for r in asked.select(T.question_entities(F.col("q"), F.col("added"))).collect()]
    assert got[0] == ["RAG", "Kite", "Graph Store"]
    assert got[1] == ["RLHF", "Constitutional AI", "RAG", "환각", "문제를", "다루나"]
    assert got[2] == ["plain words only, nothing else here"]
    assert got[3] == ["Mamba", "tell more of it"]
    assert got[4] == [""] and got[5] == []


def test_words_tones_and_figures(spark):
    one = spark.range(1)
    first = lambda *c: tuple(one.select(*c).first())
    assert first(T.relevant(F.lit("A GPU"), F.lit(None)), T.relevant(F.lit("LLM news"), F.lit(None)), T.relevant(F.lit(None), F.lit(None))) == (False, True, False)
    assert first(T.modules(F.lit("Graph feed")), T.modules(F.lit(None))) == (["brain", "brain/crawler"], ["general"])
    assert first(T.tone(F.lit(0.3)), T.intensity(F.lit(0.41))) == (T.TONES["neutral"], T.INTENSITIES["sure"])
    bad = F.lit("위기")
    assert first(T.quote_fits(bad, T.tone(F.lit(0.5))), T.quote_fits(F.concat(bad, F.lit("기회")), T.tone(F.lit(0.5))), T.quote_fits(F.lit(None), T.tone(F.lit(-1.0)))) == (False, True, True)
    assert first(T.clean_name(F.lit("_a_b ")), T.percent(F.lit(0.125)), T.fixed(F.lit(0.5))) == ("a b", "12%", "0.5000")


def test_holders_and_expansion(spark):
    texts = spark.createDataFrame([("t1", "Alpha beta"), ("t2", "ALPHABET"), ("t3", None), ("t4", "")], "uid string, text string")
    words = spark.createDataFrame([("alpha",), ("Alpha",), ("bet",), ("zz",), ("",), (None,)], "word string")
    assert rows(retrieval.holders(texts, words)) == [("alpha", "t1"), ("alpha", "t2"), ("bet", "t1"), ("bet", "t2")]
    assert rows(retrieval.holders(texts, words.limit(0))) == []
    mentions = spark.createDataFrame([("t1", "x"), ("t1", "y"), ("t2", "y"), ("t2", "y"), ("t3", "z")], "src string, dst string")
    phrases = words.withColumnRenamed("word", "phrase")
    assert rows(retrieval.expand_concepts(phrases, texts, mentions, most=1, k=1)) == [("alpha", "x", 1, 1), ("bet", "x", 1, 1)]
    assert rows(retrieval.expand_concepts(phrases, texts, mentions))[0] == ("alpha", "x", 1, 2)


def test_impact_listing(spark):
    nodes = spark.createDataFrame([("a", "T", "A"), ("b", "T", "B"), ("c", "P", "C"), ("d", "P", "D")], "uid string, label string, name string")
    edges = spark.createDataFrame([("a", "b", "USES", 0.5), ("b", "c", "USES", 0.4), ("c", "d", "HAS", 0.3)], "src string, dst string, type string, confidence double")
    claimed = spark.createDataFrame([("c", "claim")], "src string, dst string")
    members = spark.createDataFrame([("a", "g"), ("b", "g"), ("b", "g")], "uid string, community string")
    seeds = spark.createDataFrame([("a",), ("zz",), ("a",)], "uid string")
    two = {tuple(r) for r in impact.listing(seeds, nodes, edges, claimed, members, depth=2).collect()}
    assert two == {
        ("a", "direct", "USES", "T", "B", 0.5),
        ("a", "indirect", None, "P", "C", None),
        ("a", "claim", None, "Claim", "claim", 2.0),
        ("a", "community", None, "Community", "g", 1.0),
    }
    three = {tuple(r) for r in impact.listing(seeds, nodes, edges, claimed, members).collect()}
    assert three - two == {("a", "indirect", None, "P", "D", None)}
    assert not {r for r in impact.listing(seeds, nodes, edges, claimed, members, depth=1).collect() if r["part"] == "indirect"}


def test_communities_of_two_levels(spark):
    lower = spark.createDataFrame([("t1", "x"), ("t2", "x"), ("t3", "y")], "uid string, community string")
    upper = spark.createDataFrame([("p1", "n"), ("p2", "m")], "uid string, community string")
    discusses = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t1"), ("c", "t3")], "src string, dst string")
    tagged = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("c", "p2"), ("c", "p3")], "src string, dst string")
    links = communities.cross_level_links(lower, discusses, tagged, upper)
    assert rows(links) == [("x", "n", 2), ("y", "m", 1)]
    assert rows(communities.meta_communities(links)) == [("m", 2, "Meta: y + m", 2), ("n", 2, "Meta: x + n", 2), ("x", 1, "Meta: x + n", 2), ("y", 1, "Meta: y + m", 2)]
    assert rows(communities.meta_communities(links.limit(0))) == []
    mentions = spark.createDataFrame([("a", "o"), ("z", "q")], "src string, dst string")
    got = rows(communities.enriched_members(lower, discusses, mentions, tagged, upper.select("uid").where("uid = 'p1'")))
    assert got == [("a", "x"), ("o", "x"), ("p2", "y"), ("p3", "y"), ("t1", "x"), ("t2", "x"), ("t3", "y")]


def test_labels_backlogs_and_gates(spark):
    entities = spark.createDataFrame([(1, "k"), (2, "s"), (3, "new"), (4, None)], "uid int, type string")
    types = spark.createDataFrame([("k", "Event"), ("s", "Secret"), ("Actor", "Actor")], "type string, category string")
    assert rows(loading.labelled(entities, types)) == [(1, "Event"), (3, "Actor"), (4, "Actor")]
    assert rows(loading.labelled(entities, types.where("type <> 'Actor'"))) == [(1, "Event")]
    articles = spark.createDataFrame([(1, "x" * 101, "s"), (2, "x" * 100, "s" * 31), (3, None, "s" * 30), (4, "y" * 200, None)], "uid int, full string, summary string")
    edges = spark.createDataFrame([(4, i) for i in range(10, 16)] + [(1, 1)], "src int, dst int")
    assert rows(loading.to_read_again(articles, edges)) == [(1, "x" * 101, 1), (2, "s" * 31, 0)]
    long = " filler" * 20
    papers = spark.createDataFrame([("p", "2401.001", "cites 2402.002 and 2401.001" + long), ("q", "2402.002", "short 2401.001"), ("r", "2402.002", "of 2401.001" + long), ("s", None, None)], "uid string, id string, content string")
    assert rows(loading.cited_ids(papers)) == [("p", "r", 0.9), ("r", "p", 0.9)]
    claims = spark.createDataFrame([("a",), ("b",), ("c",)], "uid string")
    times = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", None)], "uid string, extracted_at string")
    assert rows(loading.evidence_migration(claims, claims.limit(1), times)) == [(3, 1, 2, 1, 1)]
    found = spark.createDataFrame([(1, 10, 7), (2, 10, 6), (3, 0, 0), (4, 2, 0)], "uid int, entities int, relations int")
    assert [r["again"] for r in loading.second_pass(found).orderBy("uid").collect()] == [False, True, False, True]
    assert rows(loading.extremes(found, "entities", "uid", 1)) == [("bottom", 3, 0), ("top", 1, 10)]


def test_a_task_hands_on_only_the_first_texts_of_a_word(monkeypatch):
    texts = [(f"t{(i * 37) % 100:02d}", "alpha beta" if i % 2 else "beta") for i in range(100)]
    batches = [pd.DataFrame(texts[i : i + 10], columns=["uid", "text"]) for i in range(0, 100, 10)]
    least = lambda word, k: sorted(uid for uid, text in texts if word in text)[:k]
    want = {(word, uid) for word in ("alpha", "beta", "eta") for uid in least(word, 3)}
    run = lambda: [tuple(r) for got in retrieval._holding(["alpha", "beta", "eta", "nowhere"], 3)(iter(batches)) for r in got.itertuples(index=False)]
    assert len(run()) == 9 and set(run()) == want  # before, 250 rows
    monkeypatch.setattr(retrieval, "HELD", 5)
    assert set(run()) >= want


def test_concepts_are_expanded_over_all_texts(spark):
    texts = spark.createDataFrame([(f"t{i:02d}", "alpha") for i in range(60)], "uid string, text string").repartition(3)
    mentions = spark.createDataFrame([(f"t{i:02d}", "early" if i < 25 else "late") for i in range(60)], "src string, dst string")
    phrases = spark.createDataFrame([("Alpha",)], "phrase string")
    assert rows(retrieval.expand_concepts(phrases, texts, mentions)) == [("alpha", "early", 25, 2), ("alpha", "late", 35, 1)]  # before, of the first 40 texts: 25 and 15
    assert "k <= 40" not in ORACLE_SQL["concepts_expanded"] and "k <= 40" in ORACLE_SQL["question_entities"]


def test_first_texts_of_words_are_those_of_all(spark):
    texts = spark.createDataFrame([(f"t{i:03d}", f"Alpha{'' if i % 3 else ' beta'}") for i in range(200)] + [("t000", "beta"), (None, "x")], "uid string, text string").repartition(5)
    words = spark.createDataFrame([("alpha",), ("Beta",), (None,), ("none",)], "word string")
    got = sorted(tuple(r) for r in retrieval.holders(texts, words, 40).collect())
    assert got == [("alpha", f"t{i:03d}") for i in range(40)] + [("beta", f"t{i:03d}") for i in range(0, 120, 3)]
