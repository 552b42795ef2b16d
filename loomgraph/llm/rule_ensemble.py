"""Quality classification by a sparse rule ensemble, compiled into column expressions.

Statistics of each text are column expressions. Boosted trees are fitted on the statistics of labelled documents; every path from a
root to a node is a rule, a conjunction of bounds on statistics. A logistic model with an L1 penalty weighs the rules
as 0/1 columns; those with a weight become one Spark expression, so scoring runs inside the JVM without a model object.

The fit reads a bounded sample of the labelled rows (by a hash of doc_id, `most` in expectation); statistics, trees and
weights are computed on executors by Spark's own library.

Nulls: a null text is empty; every text has a score. Labels that are null, or of null or held-out ids, teach nothing; of
several labels of one document the least counts. With no labels of one kind, every score is the share of label 1
(0.5 without labels). Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common as C

MOST_ROWS = 20_000
TREES, DEPTH, STEP, PENALTY, SEED = 8, 3, 0.3, 0.003, 17
SPACES = r"[\x20\x09-\x0D]+"

#: A rule: (statistic, lower bound or None, upper bound or None), ...: lower < value <= upper.
Rule = tuple[tuple[str, float | None, float | None], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Numbers of a text, all defined for every text."""
    whole = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(whole), F.lit(1)).cast("double")
    parts = F.filter(F.split(whole, SPACES), lambda w: w != "")
    n_words = F.size(parts).cast("double")
    lines = F.filter(F.split(whole, "\n"), lambda line: F.trim(line) != "")
    share = lambda pattern: F.regexp_count(whole, F.lit(pattern)) / chars
    over = lambda part, total: F.when(total > 0, part / total).otherwise(F.lit(0.0))
    return {
        "words": n_words,
        "chars_a_word": over(chars, n_words),
        "upper": share(r"\p{Lu}"),
        "symbols": share(r"[#*$%&|<>]"),
        "exclamations": share("!"),
        "digits": share(r"\p{Nd}"),
        "stops": share(r"[.?]"),
        "distinct_words": over(F.size(F.array_distinct(parts)), n_words),
        "distinct_lines": over(F.size(F.array_distinct(lines)), F.size(lines)),
        "lines_a_word": over(F.size(lines), n_words),
    }


def with_statistics(df: DataFrame, keep: list[Column | str]) -> DataFrame:
    """keep and a struct `stats`. The one-row generator keeps Spark from computing the statistics once for each rule."""
    stats = F.struct(*[c.cast("double").alias(k) for k, c in statistics(F.col("text")).items()])
    return df.select(*keep, F.explode(F.array(stats)).alias("stats"))


def paths(node, names: list[str], so_far: Rule = ()) -> list[Rule]:
    """The conjunctions that lead to every node below the root of a fitted tree."""
    found = [so_far] if so_far else []
    if node.getClass().getSimpleName() == "LeafNode":
        return found
    name, at = names[node.split().featureIndex()], float(node.split().threshold())
    return found + paths(node.leftChild(), names, (*so_far, (name, None, at))) + paths(node.rightChild(), names, (*so_far, (name, at, None)))


def simplified(rule: Rule) -> Rule:
    """One bound of each kind for each statistic, in order of names."""
    bounds: dict[str, tuple[float | None, float | None]] = {}
    for name, low, high in rule:
        was_low, was_high = bounds.get(name, (None, None))
        low = was_low if low is None else low if was_low is None else max(low, was_low)
        high = was_high if high is None else high if was_high is None else min(high, was_high)
        bounds[name] = (low, high)
    return tuple((name, *bounds[name]) for name in sorted(bounds))


def holds(rule: Rule, stats: str = "stats") -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        value = F.col(f"{stats}.{name}")
        out = out & (value > low if low is not None else F.lit(True)) & (value <= high if high is not None else F.lit(True))
    return out


class Ensemble:
    """Weighted rules and an intercept, or a constant score."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float, constant: float | None = None):
        self.rules, self.intercept, self.constant = rules, intercept, constant

    def score(self, stats: str = "stats") -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> Ensemble:
    known = labels.where(F.col(label).isNotNull() & C.trainable(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    n = known.count()
    chosen = C.hash_share(F.col("doc_id"), min(1.0, most / max(n, 1)))
    measured = with_statistics(docs.where(C.trainable(F.col("doc_id")) & chosen), ["doc_id"])
    rows = C.checkpointed(measured.join(known.where(chosen), "doc_id").select("label", "stats.*"))
    names = [c for c in rows.columns if c != "label"]
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (seen.get(0.0) and seen.get(1.0)):
        total = sum(seen.values())
        return Ensemble([], 0.0, seen.get(1.0, 0) / total if total else 0.5)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features").persist()
    boosted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(vectors)
    vectors.unpersist()
    rules = sorted({simplified(r) for tree in boosted.trees for r in paths(tree._call_java("rootNode"), names)}, key=str)
    flags = rows.select("label", F.struct(*names).alias("stats")).select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags).select("label", "features")
    weighed = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=100).fit(vectors)
    return Ensemble([(r, float(w)) for r, w in zip(rules, weighed.coefficients) if w], float(weighed.intercept))


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_statistics(docs, ["doc_id"]).select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def accepted(docs: DataFrame, model: Ensemble) -> DataFrame:
    """The rows of docs that the model predicts to be of quality."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return with_statistics(docs, [row]).where(model.score() >= 0.5).select("row.*")
