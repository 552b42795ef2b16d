"""Answers graded against what they should name, and names in questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators.containment import contained, standing
from loomgraph.operators.match import top_per
from loomgraph.operators.questions import question_type
from loomgraph.plans.session import written

#: Shares of expected names that a good and a partial answer have, and what an answer says that found nothing.
GOOD, PARTIAL, NOTHING = 0.8, 0.5, "찾을 수 없습니다"
#: Types of questions that compare two names; others ask for one.
OF_TWO = {"causal": "causal_path", "comparison": "comparison", "relationship": "relationship"}
#: Patterns of lines that may tell of an incident, and the lines shown for each.
INCIDENTS = [
    "hallucinat", "contradict", "dedup.*mismatch", "merge conflict", "unexpected entity", "invalid extraction", "recall drop", "regression", "empty response", "fallback",
]
SHOWN = 5


def incidents(lines: DataFrame, patterns: list[str] = INCIDENTS, k: int = SHOWN) -> DataFrame:
    """(folder, pattern, file, line, text, rank): the first k lines (folder, file, line, text) of each folder that each pattern finds, case kept.

    By file, then line. A line of several patterns stands under each; null texts match nothing.
    """
    found = F.array_compact(F.array(*[F.when(F.regexp_like("text", F.lit(p)), F.lit(p)) for p in patterns]))
    hits = lines.select("folder", F.explode(found).alias("pattern"), "file", "line", "text")
    return top_per(hits, ["folder", "pattern"], [F.col("file"), F.col("line"), F.col("text")], k, rank="rank")


def graded(answers: DataFrame, names: DataFrame) -> DataFrame:
    """Grades of answers (question, difficulty, answer, entities, topics: arrays of what is expected), one row each.

    Returns (question, difficulty, n_found, recall, on_topic, n_cited, n_grounded, grounding_rate, quality). Expected names and topics count
    if they stand in the answer in any case; nothing expected counts as all found. Cited are the names that the answer spells with
    capitals, grounded those that some name (names: name) holds in any case; no citation counts as grounded. A null answer is a
    failure: all zero, "no_answer". Null arrays are empty; question is a key.
    """
    lowered = F.lower("answer")
    full = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    hits = lambda c: F.size(F.filter(full(c), lambda e: F.contains(lowered, F.lower(e))))
    share = lambda a, b, none: F.when(b > 0, a / b).otherwise(F.lit(none))
    cited = answers.select("question", F.explode(T.cited_names(F.col("answer"))).alias("cited")).withColumn("word", F.lower("cited"))
    real = standing(cited, names.select(F.lower("name").alias("text")))
    counts = cited.join(real.withColumn("hit", F.lit(1)), "word", "left").groupBy("question").agg(F.count("*").alias("n_cited"), F.count("hit").alias("n_grounded"))
    there = F.col("answer").isNotNull()
    out = answers.withColumns({"n_found": F.when(there, hits("entities")).otherwise(0), "recall": F.when(there, share(hits("entities"), F.size(full("entities")), 1.0)).otherwise(0.0)})
    out = out.withColumn("on_topic", F.coalesce(there & ((hits("topics") > 0) | (F.size(full("topics")) == 0)), F.lit(False)))
    out = out.join(counts, "question", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_cited", "n_grounded")})
    quality = F.when(~there, "no_answer").when((F.col("recall") >= GOOD) & F.col("on_topic"), "good").when((F.col("recall") >= PARTIAL) | F.col("on_topic"), "partial")
    quality = quality.when((F.col("answer") != "") & ~F.contains("answer", F.lit(NOTHING)), "poor").otherwise("no_answer")
    grounding = F.when(there, share(F.col("n_grounded"), F.col("n_cited"), 1.0)).otherwise(0.0)
    return out.select("question", "difficulty", "n_found", F.round("recall", 6).alias("recall"), "on_topic", "n_cited", "n_grounded", F.round(grounding, 6).alias("grounding_rate"), quality.alias("quality"))


def summary(grades: DataFrame) -> DataFrame:
    """Means and counts of grades by difficulty and, as "overall", of all; a null difficulty is "unknown".

    Grades are written first: put into one plan with the sums, what finds names in an answer would run again for each of them and each row of the rollup.
    """
    of = lambda q: F.count_if(F.col("quality") == q)
    known = written(grades.select(F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), "recall", "grounding_rate", "quality"))
    out = known.rollup("difficulty").agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("grounding_rate"), 6).alias("grounding_rate"),
        *[of(q).alias(q) for q in ("good", "partial", "poor", "no_answer")], F.round(of("good") / F.count("*"), 6).alias("good_rate"),
    )
    return out.withColumn("difficulty", F.coalesce("difficulty", F.lit("overall"))).where("n > 0")


def mentioned(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question, type, n, plan, first, second): what questions (question, text) ask, by the names (uid, name) in them, case kept.

    n distinct names stand in the text. Questions of cause, comparison and relationship with two names or more ask about the two
    whose entities have the least uids; others with a name ask about that of the least uid, and without names for an overview (null names).
    A question without text is of type "entity"; question is a key.
    """
    first = entities.where("name <> ''").groupBy(F.col("name").alias("word")).agg(F.min("uid").alias("entity"))
    found = contained(first, questions.select(F.col("question").alias("uid"), "text")).join(first, "word")
    order = Window.partitionBy("uid").orderBy("entity", "word")
    ranked = found.withColumn("k", F.row_number().over(order)).groupBy(F.col("uid").alias("question"))
    names = ranked.agg(F.count("*").alias("n"), F.max(F.when(F.col("k") == 1, F.col("word"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("word"))).alias("second"))
    out = questions.select("question", question_type(F.coalesce("text", F.lit(""))).alias("type")).join(names, "question", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    two = F.create_map(*[F.lit(x) for pair in OF_TWO.items() for x in pair])[F.col("type")]
    plan = F.when((F.col("n") >= 2) & two.isNotNull(), two).when(F.col("n") >= 1, "entity").otherwise("overview")
    out = out.withColumn("plan", plan)
    return out.select("question", "type", "n", "plan", "first", F.when(F.col("plan").isin(*OF_TWO.values()), F.col("second")).alias("second"))
