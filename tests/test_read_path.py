"""Words in texts, names resolved, contexts, graded answers and mentions against plain Python and hand-made rows."""

from __future__ import annotations

import math
import random
import re

from loomgraph.operators import context, grading, resolver
from loomgraph.operators.containment import contained


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_contained_finds_every_pair(spark):
    random.seed(4)
    letters = ["a", "b", "c", "é", "\n", " ", "가", "😀", "."]
    texts = [(i, "".join(random.choices(letters, k=random.choice([0, 1, 2, 5, 40])))) for i in range(60)] + [(60, None), (61, "ab" * 5000 + "xyz"), (7, "again abc")]
    words = ["".join(random.choices(letters, k=random.randrange(1, 6))) for _ in range(120)] + ["", None, "xyz", "bxy", "ab", "😀a", "ab" * 40, "nowhere"]
    got = rows(contained(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(texts, "uid int, text string")))
    want = sorted({(w, i) for w in words if w for i, t in texts if t and w in t})
    assert got == want and {"xyz", "ab" * 40} <= {w for w, _ in got}


def test_contained_of_nothing(spark):
    none, some = spark.createDataFrame([], "word string"), spark.createDataFrame([("a",)], "word string")
    texts = spark.createDataFrame([(1, "a")], "uid int, text string")
    assert rows(contained(none, texts)) == [] and rows(contained(some, texts.limit(0))) == [] and rows(contained(some, texts)) == [("a", 1)]


def plain_resolver(mentions, nodes):
    terms = lambda s: [t for t in re.split(r"[\W_]+", s.lower()) if t]
    named = [n for n in nodes if n[2] is not None]
    sizes = {u: len(terms(n)) for u, _, n in named}
    mean, out = sum(sizes.values()) / len(sizes), []
    for question in sorted({q for q, m in mentions if m}):
        asked, best = [m for q, m in mentions if q == question and m], {}
        for m in asked:
            scores = {}
            for t in set(terms(m)):
                held = {u: terms(n).count(t) for u, _, n in named if t in terms(n)}
                for u, tf in held.items():
                    idf = math.log(1 + (len(named) - len(held) + 0.5) / (len(held) + 0.5))
                    scores[u] = scores.get(u, 0) + idf * tf / (tf + 1.2 * (0.25 + 0.75 * sizes[u] / mean))
            hits = sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5]
            hits += [(u, 10.0) for u, label, n in named if label == "Technology" and n.lower() == m.lower()]
            hits += [(u, 8.0) for u, label, n in named if label == "Topic" and m.lower() in n.lower()]
            for u, s in hits:
                best[u] = max(best.get(u, 0), s)
        if len(best) < 2:
            for word in {w for m in asked for w in m.lower().split() if len(w) > 2}:
                for u in sorted(u for u, label, n in named if label == "Topic" and word in n.lower())[:5]:
                    best.setdefault(u, 6.0)
        ranked = sorted(best.items(), key=lambda x: (-round(x[1], 5), x[0]))
        out += [(question, u, round(s, 5), i) for i, (u, s) in enumerate(ranked, 1)]
    return out


def test_resolver_against_a_plain_one(spark):
    nodes = [("t1", "Technology", "Red Graph"), ("t2", "Technology", "red graph"), ("t3", "Technology", "Blue Index"), ("p1", "Topic", "Graph Theory"), ("p2", "Topic", "Paragraphs"), ("x", "Person", None)]
    nodes += [(f"q{i}", "Topic", f"learning{i}") for i in range(7)] + [("o", "Organization", "Index Makers, graph graph")]
    mentions = [("a", "red graph"), ("a", "GRAPH"), ("b", "zz earn of"), ("c", "Paragraphs"), ("c", "makers"), ("d", None), ("d", ""), ("e", "nothing"), ("f", "theory zq arag"), ("f", "theory zq arag")]
    frame = spark.createDataFrame(nodes, "uid string, label string, name string")
    got = resolver.resolved(spark.createDataFrame(mentions, "question string, mention string"), frame)
    assert rows(got.selectExpr("question", "uid", "round(score, 5)", "rank")) == sorted(plain_resolver(mentions, nodes))
    assert {r["uid"]: r["score"] for r in got.where("question = 'b'").collect()} == {f"q{i}": 6.0 for i in range(5)}
    kept = {r["uid"]: r["score"] for r in got.where("question = 'f'").collect()}
    assert kept["p2"] == 6.0 and kept["p1"] < 6.0  # what full text found keeps its score


def test_grades_of_every_quality(spark):
    answers = [
        ("q1", "easy", "Uses NEO4J and Ray Serve for search", ["neo4j", "Ray", "serve"], ["Search"]),
        ("q2", "easy", "only Neo4j", ["neo4j", "ray"], ["search"]),
        ("q3", "hard", "about search", ["neo4j"], ["search"]),
        ("q4", "hard", "The Wrong Thing", ["neo4j"], ["search"]),
        ("q5", "hard", f"그것은 {grading.NOTHING}", ["neo4j"], ["search"]),
        ("q6", "hard", None, ["neo4j"], []),
        ("q7", None, "", [], None),
        ("q8", None, "", ["neo4j"], ["search"]),
    ]
    frame = spark.createDataFrame(answers, "question string, difficulty string, answer string, entities array<string>, topics array<string>")
    names = spark.createDataFrame([("the neo4j store",), ("ray serve",), (None,)], "name string")
    grades = grading.graded(frame, names)
    got = {r["question"]: (r["n_found"], r["recall"], r["on_topic"], r["n_cited"], r["n_grounded"], r["grounding_rate"], r["quality"]) for r in grades.collect()}
    assert got == {
        "q1": (3, 1.0, True, 2, 1, 0.5, "good"),  # "Uses NEO4J" is one name
        "q2": (1, 0.5, False, 1, 1, 1.0, "partial"),
        "q3": (0, 0.0, True, 0, 0, 1.0, "partial"),
        "q4": (0, 0.0, False, 1, 0, 0.0, "poor"),
        "q5": (0, 0.0, False, 0, 0, 1.0, "no_answer"),
        "q6": (0, 0.0, False, 0, 0, 0.0, "no_answer"),
        "q7": (0, 1.0, True, 0, 0, 1.0, "good"),
        "q8": (0, 0.0, False, 0, 0, 1.0, "no_answer"),
    }
    total = {r["difficulty"]: (r["n"], r["recall"], r["good"], r["no_answer"], r["good_rate"]) for r in grading.summary(grades).collect()}
    assert total == {"easy": (2, 0.75, 1, 0, 0.5), "hard": (4, 0.0, 0, 2, 0.0), "unknown": (2, 0.5, 1, 1, 0.5), "overall": (8, 0.3125, 2, 3, 0.25)}
    assert rows(grading.summary(grades.limit(0))) == []


def test_incidents_of_each_folder(spark):
    texts = ["dedup: 3 items mismatch", "Regression", "regression then fallback", None, "", *["fallback"] * 6]
    lines = spark.createDataFrame([("a", "f1" if i % 2 else "f0", i, t) for i, t in enumerate(texts)] + [("b", "f", 0, "fallback")], "folder string, file string, line int, text string")
    got = [(r["folder"], r["pattern"], r["file"], r["line"], r["rank"]) for r in grading.incidents(lines).orderBy("folder", "pattern", "rank").collect()]
    shown = [("f0", 2), ("f0", 6), ("f0", 8), ("f0", 10), ("f1", 5)]
    assert got == [("a", "dedup.*mismatch", "f0", 0, 1), *[("a", "fallback", f, n, i) for i, (f, n) in enumerate(shown, 1)], ("a", "regression", "f0", 2, 1), ("b", "fallback", "f", 0, 1)]


def test_mentions_choose_what_is_asked(spark):
    asked = spark.createDataFrame([("1", "Ann 과 Bob 의 관계"), ("2", "왜 Bob?"), ("3", "ann 비교"), ("4", "Bob, Ann, Cy"), ("5", None), ("6", "Cy 왜 Bob")], "question string, text string")
    entities = spark.createDataFrame([("e3", "Ann"), ("e1", "Bob"), ("e2", "Cy"), ("e0", "Cy"), ("e4", ""), ("e5", None)], "uid string, name string")
    got = {r["question"]: tuple(r)[1:] for r in grading.mentioned(asked, entities).collect()}
    assert got == {
        "1": ("relationship", 2, "relationship", "Bob", "Ann"),
        "2": ("causal", 1, "entity", "Bob", None),
        "3": ("comparison", 0, "overview", None, None),
        "4": ("entity", 3, "entity", "Cy", None),
        "5": ("entity", 0, "overview", None, None),
        "6": ("causal", 2, "causal_path", "Cy", "Bob"),
    }


NODES = "seed string, uid string, label string, name string, title string, relevance string, published_date string, summary string, url string, claim_type string, confidence double, content string, level int, member_count long, type string, affiliation string"
EDGES = "seed string, src string, dst string, type string, confidence double"


def node(spark, *given):
    columns = [c.split(" ")[0] for c in NODES.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in given], NODES)


def graph(spark):
    nodes = node(
        spark,
        {"seed": "s", "uid": "a1", "label": "Article", "title": "News", "relevance": "must-read", "published_date": "2025-01-02", "summary": "x" * 300, "url": "http://n"},
        {"seed": "s", "uid": "c1", "label": "Claim", "claim_type": "fact", "confidence": 0.5, "content": "low"},
        {"seed": "s", "uid": "c2", "label": "Claim", "claim_type": "guess", "confidence": 0.875, "content": "high"},
        {"seed": "s", "uid": "c3", "label": "Claim", "content": "none"},
        {"seed": "s", "uid": "m2", "label": "Community", "name": "Big", "level": 2, "member_count": 9},
        {"seed": "s", "uid": "m1", "label": "Community", "name": "Small", "level": 1, "member_count": 3, "summary": "few"},
        {"seed": "s", "uid": "t1", "label": "Technology", "name": "Spark", "type": "engine"},
        {"seed": "s", "uid": "t1", "label": "Technology", "name": "Spark", "type": "engine"},
        {"seed": "s", "uid": "p1", "label": "Person", "name": "Ann", "affiliation": "Lab"},
        {"seed": "s", "uid": "o1", "label": "Organization", "name": "Org"},
        {"seed": "s", "uid": "z1", "label": "Topic", "name": "graphs"},
        {"seed": "s", "uid": "z2", "label": "Topic", "name": "joins"},
        {"seed": "lone", "uid": "u", "label": "Other", "name": "?"},
    )
    edges = spark.createDataFrame(
        [
            ("s", "t1", "z1", "DEPENDS_ON", 0.9), ("s", "t1", "z2", "DEPENDS_ON", 0.94), ("s", "t1", "z1", "DEPENDS_ON", 0.2), ("s", "a1", "c1", "CLAIMS", None),
            ("s", "a1", "t1", "DISCUSSES", 0.8), ("s", "a1", "far", "MYSTERY", 0.1), ("s", None, "t1", "CLAIMS", 0.3), ("s", "z1", "z2", "SUBTOPIC_OF", 1.0),
        ],
        EDGES,
    )
    return nodes, edges


TEXT = f"""## 지식 그래프 컨텍스트

### 관련 기사
- **News** [must-read] (2025-01-02)
  요약: {"x" * 200}
  링크: http://n

### 핵심 주장 (Claims)
- [guess] (신뢰도: 0.88) high
- [사실] (신뢰도: 0.50) low
- [undefined] (신뢰도: ?) none

### 커뮤니티 (계층 분석)
- **Small** (C1, 3개 구성원)
  few
- **Big** (C2, 9개 구성원)

### 관련 기술
- **Spark** (engine)

### 관련 인물
- Ann @ Lab

### 관련 조직
- **Org** (undefined)

### 관련 토픽
graphs, joins

### ★ 인과 관계 (Causal)
- News —[CLAIMS]→ c1

### ★ 구조 관계 (Structural)
- Spark —[DEPENDS_ON]→ joins (0.9)
- Spark —[DEPENDS_ON]→ graphs (0.9)

### ☆ 계층 관계 (Hierarchy)
- graphs —[SUBTOPIC_OF]→ joins (1.0)

### ☆ 교차 관계 (Cross-space)
- News —[DISCUSSES]→ Spark (0.8)

### 기타 관계
- News —[MYSTERY]→ far (0.1)
"""


def test_context_is_the_whole_text_in_order(spark):
    got = {r["seed"]: r["context"] for r in context.with_empty(spark.createDataFrame([("s",), ("lone",), ("gone",)], "seed string"), context.context_texts(*graph(spark))).collect()}
    assert got == {"s": TEXT, "lone": context.TITLE, "gone": context.NOTHING}


def test_context_weights_and_room(spark):
    nodes, edges = graph(spark)
    weighted = context.context_texts(nodes, edges, {"hierarchy": 2.0, "causal": 0.1}).where("seed = 's'").first()["context"]
    marks = [line for line in weighted.split("\n") if line.startswith("### ") and "관계" in line]
    assert marks == ["### ★ 계층 관계 (Hierarchy)", "### ★ 구조 관계 (Structural)", "### ☆ 교차 관계 (Cross-space)", "### 인과 관계 (Causal)", "### 기타 관계"]
    line = "- [guess] (신뢰도: 0.88) high"
    tight = context.context_texts(nodes, edges, room=len(line) + 1).where("seed = 's'").first()["context"]
    assert f"{line}\n\n" in tight and "low" not in tight and "### 관련 기사" not in tight
    assert line not in context.context_texts(nodes, edges, room=len(line)).where("seed = 's'").first()["context"]


def test_room_of_a_hub_is_filled_to_the_last_line(spark):
    hub = spark.range(20_000).selectExpr("'s' AS seed", "concat('n', id) AS src", "'t1' AS dst", "'DISCUSSES' AS type", "CAST((id % 7) / 10 AS DOUBLE) AS confidence")
    seed = node(spark, {"seed": "s", "uid": "t1", "label": "Technology", "name": "T", "type": "x"})
    text = context.context_texts(seed, hub).first()["context"]
    lines = text.split("(Cross-space)\n")[1].strip("\n").split("\n")
    every = sorted((-(i % 7) / 10, f"- n{i} —[DISCUSSES]→ T ({(i % 7) / 10:.1f})") for i in range(20_000))
    used, want = 0, []
    for _, line in every:
        used += len(line) + 1
        if used > context.ROOM:
            break
        want.append(line)
    assert lines == want
