"""The ordered merge against a plain pass over all pairs, and the relations that follow it."""

from __future__ import annotations

import random

import pytest

from loomgraph.functions import text as T
from loomgraph.operators import dedup
from loomgraph.operators import ordered_dedup as O

ENTITY = "uid string, ord int, name string, type string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def plain(name):
    return name.lower().replace(" ", "").replace("_", "").strip()


def same(a, b):
    x, y = plain(a), plain(b)
    if x == y:
        return True
    if (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y), 1) > 0.7:
        return True
    return bool(x and y) and 1 - edits(x, y) / max(len(x), len(y)) >= 0.85


def one_after_the_other(entities):
    into = {}
    for i, (a, _, name, kind) in enumerate(entities):
        if a in into or name is None:
            continue
        for b, _, other, theirs in entities[i + 1 :]:
            if b in into or other is None or (kind and theirs and kind != theirs) or not same(name, other):
                continue
            if len(name) >= len(other):
                into[b] = a
            else:
                into[a] = b
    return into


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_a_plain_pass(spark, seed):
    random.seed(seed)
    words = ["data", "datas", "data base", "Database", "databases", "data_base", "graphite", "graphites", "graphite x", "grafhite", "long name of a thing", "long name of the thing", "long names of the things", "ab", "abc", "a b", ""]
    names = [random.choice(words) + random.choice(["", "", "s", " 1", " 12"]) for _ in range(90)]
    entities = [(f"u{(i * 37) % 101:03d}", i, n, random.choice(["A", "A", "B", "", None])) for i, n in enumerate(names)] + [("none", 500, None, "A")]
    got = {r["gone"]: r["keep"] for r in O.similar_merges(spark.createDataFrame(entities, ENTITY).repartition(3)).collect()}
    assert got == one_after_the_other(entities) and len(got) > 40


def test_aliases_come_first_and_relations_follow(spark):
    entities = spark.createDataFrame([("e1", 1, "미국", "Actor"), ("e2", 2, "US", "Actor"), ("e3", 3, "United States", "Place"), ("e4", 4, "한국은행", "Actor"), ("e5", 5, "삼성전자", "Actor"), ("e6", 6, "Samsung", "Actor"), ("e7", 7, "알파", "Actor"), ("e8", 8, "Alpha", "Actor"), ("e9", 9, "alphas one two", "Actor"), ("f1", 10, "alphas one two three", "Actor"), ("f2", 11, "alphas one twos", "Actor")], ENTITY)
    merges = O.ordered_merges(entities, {"알파": ["Alpha", "ALPHA"]})
    assert {(r["gone"], r["keep"], r["by"]) for r in merges.collect()} == {("e2", "e1", "alias"), ("e3", "e1", "alias"), ("e6", "e5", "alias"), ("e8", "e7", "alias"), ("e9", "f2", "similarity")}
    rows = [("e2", "e4", "INFLUENCES", 0.5, 0.4, 1), ("e3", "e4", "INFLUENCES", 0.25, 0.8, 2), ("e1", "e2", "INFLUENCES", 1.0, 1.0, 3), ("e9", "e8", "HAS", 1.0, 0.5, 4)]
    out = O.merged_relations(spark.createDataFrame(rows, "src string, dst string, type string, weight double, confidence double, chunk int"), merges)
    assert {tuple(r) for r in out.collect()} == {("e1", "e4", "INFLUENCES", 0.75, 0.6, 1), ("f2", "e7", "HAS", 1.0, 0.5, 4)}


def test_no_entities(spark):
    assert O.ordered_merges(spark.createDataFrame([], ENTITY)).count() == 0


def test_parallel_edges_that_no_merge_touches_stay(spark):
    edges = spark.createDataFrame([("x", "y", "R", 1.0), ("x", "y", "R", 2.0), ("g", "y", "S", 3.0), ("k", "y", "S", 4.0), ("k", "g", "S", 5.0), ("z", "z", "S", 6.0)], "src string, dst string, type string, weight double")
    merges = spark.createDataFrame([("g", "k")], "gone string, keep string")
    assert sorted(map(tuple, dedup.redirect(edges, merges).collect())) == [("k", "y", "S", 4.0), ("x", "y", "R", 1.0), ("x", "y", "R", 2.0), ("z", "z", "S", 6.0)]
    bare = dedup.redirect(edges.select("src", "dst", "type"), merges)
    assert sorted(map(tuple, bare.collect())) == [("k", "y", "S"), ("x", "y", "R"), ("x", "y", "R"), ("z", "z", "S")]


def similarity(a, b):
    aliases = {n: k for k, own in T.ALIASES.items() for n in (k, *own)}
    if aliases.get(a) and aliases.get(a) == aliases.get(b):
        return 0.95
    short, long = sorted((a, b), key=len)
    if short in long and len(short) >= 3 and len(long) - len(short) <= 3:
        return 0.9
    return 1 - edits(a, b) / max(len(a), len(b), 1)


def names_of(seed, n):
    random.seed(seed)
    out = set(T.ALIASES) | {x for own in T.ALIASES.values() for x in own}
    while len(out) < n:
        word = "".join(random.choice("ab") for _ in range(random.randrange(1, 26)))
        out |= {word, word + random.choice("abc"), random.choice("abc") + word[1:], word[: len(word) // 2] + word[len(word) // 2 + 1 :] + "a", word[::-1][:1] + word}
    return sorted(out)


def test_review_is_what_a_pass_in_order_of_score_leaves(spark):
    nodes = [(f"{label}{i}", label, name) for label, own in (("Technology", names_of(1, 260)), ("Person", names_of(2, 120)), ("Topic", ["only"])) for i, name in enumerate(own)]
    normal = lambda s: " ".join(s.lower().replace(".", "").replace("_", "").replace("-", "").split())
    pairs = []
    for label in ("Technology", "Person"):
        own = sorted({normal(n) for _, k, n in nodes if k == label})
        pairs += [(f"{label}:{a}", f"{label}:{b}", similarity(a, b)) for i, a in enumerate(own) for b in own[i + 1 :]]
    pairs = [p for p in pairs if p[2] >= 0.85]
    frame = spark.createDataFrame(nodes, "uid string, label string, name string").repartition(3)
    assert {(f"{r['label']}:{r['x']}", f"{r['label']}:{r['y']}") for r in dedup.similar_names(frame).collect()} == {p[:2] for p in pairs}
    gone, kept = set(), set()
    for a, b, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if score >= dedup.MERGE and not {a, b} & (gone | kept):
            gone.add(b)
            kept.add(a)
    got = {(r["a"], r["b"]): r["score"] for r in dedup.left_for_review(frame).collect()}
    assert got == pytest.approx({(a, b): s for a, b, s in pairs if not {a, b} & gone}) and len(gone) > 5 and len(got) > 300
