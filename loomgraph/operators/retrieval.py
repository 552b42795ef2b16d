"""Ranked retrieval over texts, names and vectors."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import looked_up
from loomgraph.operators.match import top_per
from loomgraph.plans.session import written

K1, B = 1.2, 0.75
#: Sizes up to which one side of a search is sent to all tasks: terms of queries, numbers in a block of query vectors,
#: characters in a block of cited names.
TERMS, NUMBERS, CHARACTERS = 1_000_000, 4_000_000, 16_000_000
#: Vectors, and scores of vectors with queries, that a task holds at a time.
ROWS, SCORES = 4_096, 2_000_000
#: Pairs of a word and a text that a task holds before it hands them on.
HELD = 1_000_000
#: The weights of the three ways of retrieval, and the bonus of what must be read.
LOCAL, GLOBAL, TEMPORAL, MUST_READ = 1.0, 1.3, 1.5, 0.2
EXACT_NAME, TOPIC_CONTAINS, KEYWORD_ONLY = 10.0, 8.0, 6.0


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, size): the inverted index of letters-and-digits terms."""
    terms = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    rows = texts.select(key, terms.alias("terms")).select(key, F.size("terms").alias("size"), F.explode("terms").alias("term"))
    return rows.groupBy(key, "term", "size").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, n_texts: DataFrame, queries: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(query, key, score, rank) from an index, one row (n, mean_size), and queries(query, term); a text of the index may stand for several (copies)."""
    wanted = queries.select("query", "term").distinct()
    hits = index.join(wanted.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg((F.sum("copies") if "copies" in index.columns else F.count("*")).alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(n_texts))  # one row of totals
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    # A frequent term has very many postings and may stand in many queries: few terms are broadcast, more are salted.
    total = looked_up(scored.select("term", key, weight.alias("w")), wanted, "term", wanted.count() <= TERMS).groupBy("query", key).agg(F.round(F.sum("w"), 6).alias("score"))
    return top_per(total, ["query"], [F.desc("score"), F.col(key)], k, rank="rank")


def centroid_neighbours(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(label, vec_id, score): the vectors of largest cosine with the mean of each label; there is one query vector for each label."""
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    query = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("q")).withColumnRenamed("label", "of")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e, q = F.col("embedding"), F.col("q")
    if query.count() > 10_000:
        raise ValueError("that many query vectors are no question; search them in blocks")
    near = vectors.crossJoin(F.broadcast(query)).select(F.col("of").alias("label"), "vec_id", F.round(dot(e, q) / F.sqrt(dot(e, e) * dot(q, q)), 6).alias("score"))
    return top_per(near, ["label"], [F.desc("score"), F.col("vec_id")], k)


def blocks(df: DataFrame, key: str, size: int, block: int) -> Iterator[DataFrame]:
    """df in parts by the hash of its key, each of about `block` of its whole size."""
    n = max(1, -(-size // block))
    for i in range(n):
        yield df if n == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query, vec_id, score, rank): the k vectors of largest cosine for each query vector, itself left out; least vec_id first of equals.

    Both are (vec_id, embedding) of one length. Queries go to the tasks in blocks of bounded size; each task keeps
    its own k best of each query, and these are merged. Null vectors and vectors of length zero match nothing.
    """
    plain = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    asked = queries.where("embedding IS NOT NULL").select("vec_id", "embedding")
    size, best = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0], None
    for part in blocks(asked, "vec_id", size, NUMBERS):
        block = part.toPandas()
        if block.empty:
            continue
        ids = block["vec_id"].to_numpy()
        near = plain.mapInPandas(_nearest(ids, _unit(block["embedding"]), k), "query long, vec_id long, score double")
        best = near if best is None else best.unionAll(near)
    if best is None:
        best = plain.select(F.col("vec_id").alias("query"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return top_per(best, ["query"], [F.desc("score"), F.col("vec_id")], k, rank="rank")


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)


def _nearest(ids: np.ndarray, asked: np.ndarray, k: int):
    """Of the task's vectors the k best of each asked one, over all batches; scores are held for SCORES pairs at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(ids), k), -np.inf)
        whose = np.zeros((len(ids), k), np.int64)
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                part = batch.iloc[low : low + ROWS]
                own = part["vec_id"].to_numpy()
                order = np.argsort(own, kind="stable")
                own, vectors = own[order], _unit(part["embedding"])[order]
                step = max(1, SCORES // len(own))
                for at in range(0, len(ids), step):
                    some = slice(at, at + step)
                    score = np.round(asked[some] @ vectors.T, 6)
                    score[(ids[some, None] == own[None, :]) | np.isnan(score)] = -np.inf
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    scores = np.concatenate([best[some], np.take_along_axis(score, top, 1)], axis=1)
                    owners = np.concatenate([whose[some], own[top]], axis=1)
                    first = np.lexsort((owners, -scores), axis=1)[:, :k]
                    best[some], whose[some] = np.take_along_axis(scores, first, 1), np.take_along_axis(owners, first, 1)
        rows, place = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"query": ids[rows], "vec_id": whose[rows, place], "score": best[rows, place]})

    return run


def three_ways(technologies: DataFrame, topics: DataFrame, articles: DataFrame, word: str, since: str) -> DataFrame:
    """(way, uid, name, score): names with the word, topics by use, and recent articles, each with its weight; highest first."""
    local = technologies.where(F.contains(F.lower("name"), F.lit(word))).orderBy("uid").limit(50).select(F.lit("local").alias("way"), "uid", "name", F.lit(LOCAL).alias("score"))
    wide = topics.orderBy(F.desc("n"), "uid").limit(5).select(F.lit("global").alias("way"), "uid", "name", F.lit(GLOBAL).alias("score"))
    bonus = F.when(F.col("relevance") == "must-read", F.lit(MUST_READ)).otherwise(F.lit(0.0))
    recent = articles.where(F.col("published_date") >= since).orderBy(F.desc("published_date"), "uid").limit(20)
    timed = recent.select(F.lit("temporal").alias("way"), "uid", F.col("title").alias("name"), F.round(F.lit(TEMPORAL) + bonus, 6).alias("score"))
    return local.unionByName(wide).unionByName(timed)


def resolve(mentions: DataFrame, technologies: DataFrame, topics: DataFrame) -> DataFrame:
    """(mention, uid, score): nodes for names that a question mentions: the same name, a topic's, or a shared word; the best score of each."""
    name = F.lower("name")
    exact = mentions.join(technologies.select("uid", name.alias("mention")), "mention").select("mention", "uid", F.lit(EXACT_NAME).alias("score"))
    topic = mentions.join(topics.select("uid", name.alias("mention")), "mention").select("mention", "uid", F.lit(TOPIC_CONTAINS).alias("score"))
    words = technologies.select("uid", F.explode(F.split(name, " ")).alias("word")).distinct()
    loose = mentions.select("mention", F.explode(F.split("mention", " ")).alias("word")).distinct().join(words, "word").select("mention", "uid", F.lit(KEYWORD_ONLY).alias("score"))
    return exact.unionAll(topic).unionAll(loose).groupBy("mention", "uid").agg(F.max("score").alias("score"))


def impact(nodes: DataFrame, edges: DataFrame, reach: DataFrame, claims: DataFrame, communities: DataFrame) -> DataFrame:
    """Impact score and level of each node: 2 a neighbour, 0.5 a node within two hops, 3 a claim, 5 a community, 10 a dependent; 100 at most."""
    ends = edges.select(F.col("src").alias("uid"), F.col("dst").alias("x")).unionAll(edges.select(F.col("dst").alias("uid"), F.col("src").alias("x")))
    counts = {
        "direct": ends.groupBy("uid").agg(F.count_distinct("x").alias("direct")),
        "two_hops": reach.groupBy("uid").agg(F.count("*").alias("two_hops")),
        "claims": claims.groupBy("uid").agg(F.count_distinct("claim").alias("claims")),
        "communities": communities.groupBy("uid").agg(F.count_distinct("community").alias("communities")),
        "dependents": edges.groupBy(F.col("dst").alias("uid")).agg(F.count_distinct("src").alias("dependents")),
    }
    out = nodes.select("uid")
    for name, count in counts.items():
        out = out.join(count, "uid", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    score = F.least(F.expr("2 * direct + 0.5D * two_hops + 3 * claims + 5 * communities + 10 * dependents"), F.lit(100.0))
    level = F.when(F.col("score") >= 70, "critical").when(F.col("score") >= 40, "high").when(F.col("score") >= 15, "medium").otherwise("low")
    return out.withColumn("score", F.round(score, 1)).withColumn("level", level)


def retrieval_scores(results: DataFrame) -> DataFrame:
    """Means by difficulty and over all of results(difficulty, expected, found: arrays): recall, and the counts by quality."""
    hit = F.size(F.filter("expected", lambda e: F.array_contains("found", e)))
    recall = F.when(F.size("expected") > 0, hit / F.size("expected")).otherwise(0.0)
    graded = results.select("difficulty", recall.alias("recall"))
    quality = lambda low, high: F.count_if((F.col("recall") >= low) & (F.col("recall") < high))
    out = graded.rollup("difficulty").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), quality(0.7, 2).alias("good"), quality(0.3, 0.7).alias("partial"), quality(-1, 0.3).alias("poor"))
    return out.withColumn("difficulty", F.coalesce("difficulty", F.lit("overall")))


def grounded(cited: DataFrame, names: DataFrame) -> DataFrame:
    """(key, n_cited, n_grounded) of cited(key, name): names that some node's name holds, in any case.

    Cited names go to the tasks in blocks of bounded size, as an automaton that finds all of them in one walk over a node's
    name; so the work is that of reading the nodes once a block. Null and empty names are not cited.
    """
    lowered = names.where("name IS NOT NULL").select(F.lower("name").alias("n"))
    own = cited.select("key", F.lower("name").alias("name")).where("name <> ''").distinct()
    asked, found = own.select("name").distinct(), None
    size = asked.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).first()[0]
    for part in blocks(asked, "name", size, CHARACTERS):
        block = [r["name"] for r in part.collect()]
        if block:
            held = lowered.mapInPandas(_held(block), "name string")
            found = held if found is None else found.unionAll(held)
    found = asked.limit(0) if found is None else found.distinct()
    marked = own.join(found.withColumn("hit", F.lit(1)), "name", "left")
    return marked.groupBy("key").agg(F.count("*").alias("n_cited"), F.count("hit").alias("n_grounded"))


def _held(wanted: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for name in wanted:
            finder.add_word(name, name)
        finder.make_automaton()
        found = set()
        for batch in batches:
            for text in batch["n"]:
                found.update(name for _, name in finder.iter(text))
        yield pd.DataFrame({"name": sorted(found)}, dtype="object")

    return run


def expand_concept(articles: DataFrame, mentions: DataFrame, word: str, most: int = 40, k: int = 3) -> DataFrame:
    """Entities that most often stand in the newest articles whose title has the word."""
    seeds = articles.where(F.contains(F.lower("title"), F.lit(word))).orderBy(F.desc("published_date"), "uid").limit(most).select(F.col("uid").alias("src"))
    return mentions.join(seeds, "src", "left_semi").groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(k)


def holders(texts: DataFrame, words: DataFrame, most: int | None = None) -> DataFrame:
    """(word, uid): the texts (uid, text) in which each of the words (word) stands, in any case; each once. With `most`, those of a word's
    least uids, of which each task hands on so many itself.

    As in `grounded`, words go to the tasks in blocks of bounded size and each text is walked once a block. Null texts hold
    nothing, null and empty words stand nowhere.
    """
    asked = written(words.select(F.lower("word").alias("word")).where("word <> ''").distinct())
    lowered = texts.where("text IS NOT NULL").select(F.col("uid").cast("string").alias("uid"), F.lower("text").alias("text"))
    size, found = asked.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0], None
    for part in blocks(asked, "word", size, CHARACTERS):
        block = [r["word"] for r in part.collect()]
        if block:
            held = lowered.mapInPandas(_holding(block, most), "word string, uid string")
            found = held if found is None else found.unionAll(held)
    # dealt out by text, so that what a text's words are joined with needs no other shuffle
    found = asked.select("word", F.col("word").alias("uid")).limit(0) if found is None else (found.repartition("uid") if most is None else found).distinct()
    return found if most is None else top_per(found, ["word"], [F.col("uid")], most)


def _holding(wanted: list[str], most: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for word in wanted:
            finder.add_word(word, word)
        finder.make_automaton()
        best, last, n = defaultdict(set), {}, 0
        for batch in batches:
            uids, words = [], []
            for uid, text in zip(batch["uid"], batch["text"]):
                held = {word for _, word in finder.iter(text)}
                if most is None:
                    words += held
                    uids += [uid] * len(held)
                    continue
                for word in held:
                    if word in last and uid >= last[word]:
                        continue
                    own = best[word]
                    n -= len(own)
                    own.add(uid)
                    if len(own) >= 2 * most:
                        least = heapq.nsmallest(most, own)
                        own, last[word] = set(least), least[-1]
                        best[word] = own
                    n += len(own)
                if n > HELD:
                    yield from _least(best, most)
                    best, n = defaultdict(set), 0
            yield pd.DataFrame({"word": words, "uid": uids}, dtype="object")
        yield from _least(best, most)

    return run


def _least(best: dict[str, set[str]], most: int) -> Iterator[pd.DataFrame]:
    rest = iter(best.items())
    while part := list(islice(rest, ROWS)):
        yield pd.DataFrame([(word, uid) for word, own in part for uid in heapq.nsmallest(most, own)], columns=["word", "uid"], dtype="object")


def expand_concepts(phrases: DataFrame, texts: DataFrame, mentions: DataFrame, most: int | None = None, k: int = 3) -> DataFrame:
    """(phrase, dst, n, rank): for each phrase of three characters or more the k entities that most often stand in the
    texts (uid, text) that have it; with `most`, in those of least uid, so many at most. mentions: (src, dst), each counted.
    """
    asked = phrases.select(F.trim(F.lower("phrase")).alias("word")).where("length(word) >= 3")
    seeds = holders(texts, asked, most).select("word", F.col("uid").alias("src"))
    counted = mentions.select("src", "dst").join(seeds, "src").groupBy(F.col("word").alias("phrase"), "dst").agg(F.count("*").alias("n"))
    return top_per(counted, ["phrase"], [F.desc("n"), F.col("dst")], k, rank="rank")


def ranked_context(edges: DataFrame, nodes: DataFrame, spaces: dict[str, float], k: int = 10) -> DataFrame:
    """Edges of a context by their space's weight and confidence, one for each (source name, type, target name)."""
    named = edges
    for end in ("src", "dst"):
        named = named.join(nodes.select(F.col("uid").alias(end), F.col("name").alias(f"{end}_name")), end)
    once = named.groupBy("src_name", "type", "dst_name").agg(F.max("confidence").alias("confidence"), F.first("space").alias("space"))
    weight = F.create_map(*[F.lit(x) for pair in spaces.items() for x in pair])[F.col("space")]
    order = Window.partitionBy("space").orderBy(F.desc("confidence"), "src_name", "type", "dst_name")
    return once.withColumn("weight", weight).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
