"""Mixing sources to target weights, with DataFrame functions alone.

Targets: sources in code point order (null last) weigh 3, 1, 2 and again; together they get 150 % of all words, no
source more than twice its own words, and what is cut off goes to the others by weight (water filling: one ordered
window over the table of sources).

Selection (Efraimidis and Spirakis): a document with quality weight w gets the exponential key -ln(u) / w, u by a hash
of its id; the least keys are a weighted sample without replacement. A source's target is first filled with complete epochs,
then with the documents of least key whose middle word still fits in what remains. The order within a source is never
sorted whole: word sums of 1024 ranges of the key find the range in which the budget ends, which is parted again until it
has few entries (rows of one key, id and size are one entry); only these are sorted for their prefix sums. Of equal rows
at the end as many are taken as fit, by their place in the checkpointed table. Every row then compares itself with its source's cutoff.

Nulls: a null text has no words; a null source is a source; a null doc_id hashes as the empty text. Rows with one key are ordered by
doc_id (null last), then size, then their place; rows equal in these are interchangeable, so reruns give the same rows. Rows
without words are taken in every epoch of their source, and in its fraction if it has one and their key is low enough. A source
without words has the target 0 and gives no rows. An empty table gives no rows. mix reads doc_id, text and source only, mixed_rows keeps all columns.
Only the number of words of a text is kept, so very long texts cost no more than others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>!]"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, EPOCHS = 1.5, 2
RANGES = 1024
#: Entries of the range that is sorted, at most (if keys can part it further), and rounds of parting.
ENDING, ROUNDS = 100_000, 12
#: A table of sources of more rows is joined by shuffling instead of by broadcast.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Between 0 and 1: the more of a text is symbols, the less."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * symbols / F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)))


def exponential_key(doc_id: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def sized(docs: DataFrame, keep: Column | None = None) -> DataFrame:
    """doc_id, source, size, key and place (and `keep`) of every row, checkpointed, so that a row's place stays its own."""
    key = exponential_key(F.col("doc_id"), quality_weight(F.col("text")))
    kept = [] if keep is None else [keep]
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), key.alias("key"), *kept)
    return checkpointed(own.withColumn("place", F.monotonically_increasing_id()))


def entry() -> Column:
    """What orders the rows of a source; rows equal in it are interchangeable."""
    return F.struct("key", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), "size")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size): one row for each source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cyclic = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1)
    table = by_source.withColumn("weight", cyclic).withColumn("cap", F.lit(float(EPOCHS)) * F.col("source_size"))
    whole = Window.partitionBy()
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(SHARE) * F.sum("source_size").over(whole)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    table = table.withColumn("budget", budget).withColumn("full", level * F.col("weight") >= F.col("cap"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    share = rest / F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(whole) * F.col("weight")
    return table.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(share).alias("target"))


def same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ending_entries(own: DataFrame, goal: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(of, before, rest, low, e, size, n): the entries among which each source's rest ends, n rows each, their least key, and the words before them."""
    keys = own.groupBy("source").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    state = keys.join(hint(goal.select(F.col("source").alias("of"), "rest")), same_source("source", "of")).select("of", "rest", "low", "high", F.lit(0).cast("bigint").alias("before"))
    inside = F.col("key").between(F.col("low"), F.col("high"))
    for _ in range(ROUNDS):
        state = checkpointed(state)
        held = own.join(hint(state), same_source("source", "of")).where(inside)
        part = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))).otherwise(0).cast("int")
        # a range's own least and greatest key bound the next round, so no rounding can lose a row
        ranges = held.groupBy("of", "rest", "before", part.alias("range")).agg(F.sum("size").alias("words"), F.approx_count_distinct(entry()).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        so_far = F.sum("words").over(Window.partitionBy("of").orderBy("range")) - F.col("words")
        found = checkpointed(ranges.withColumn("upto", F.col("before") + so_far).where("upto <= rest AND upto + words > rest"))
        state = found.select("of", "rest", "low", "high", F.col("upto").alias("before"))
        if found.where((F.col("n") > ENDING) & (F.col("high") > F.col("low"))).isEmpty():
            break
    held = own.join(hint(checkpointed(state)), same_source("source", "of")).where(inside)
    return held.groupBy("of", "before", "rest", "low", entry().alias("e"), "size").agg(F.count("*").alias("n"))


def places_of(own: DataFrame, last: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(at, last_place): of the rows equal to each source's last entry, the place of the m-th. Rows are counted by partition, and numbered in one."""
    tied = own.join(hint(last), same_source("source", "of") & (entry() == F.col("last_entry"))).select("of", "m", "place", F.shiftright("place", 33).alias("partition"))
    counts = tied.groupBy("of", "m", "partition").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("of").orderBy("partition"))
    there = counts.withColumn("skip", upto - F.col("n")).where("skip < m AND skip + n >= m").select(F.col("of").alias("at"), F.col("partition").alias("in_partition"), "skip")
    inside = tied.join(hint(there), same_source("of", "at") & (F.col("partition") == F.col("in_partition")))
    number = F.row_number().over(Window.partitionBy("at").orderBy("place"))
    return inside.withColumn("number", number + F.col("skip")).where("number = m").select("at", F.col("place").alias("last_place"))


def cutoffs(own: DataFrame) -> DataFrame:
    """One row for each source: its target, complete epochs, and the last entry and place that the fraction takes."""
    goal = targets(own)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goal = checkpointed(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    hint = F.broadcast if goal.count() <= BROADCAST_SOURCES else lambda df: df
    so_far = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("of").orderBy("e").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    room = F.col("rest") - F.col("before") - (so_far - F.col("size") * F.col("n"))
    fit = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).when(room >= 0, F.col("n")).otherwise(0)
    ends = ending_entries(own, goal, hint).withColumn("m", F.least(F.greatest(fit, F.lit(0)), F.col("n")).cast("bigint"))
    last = ends.groupBy("of").agg(F.min("low").alias("low"), F.max(F.when(F.col("m") > 0, F.struct("e", "m"))).alias("l"))
    last = checkpointed(last.select("of", "low", F.col("l.e").alias("last_entry"), "l.m"))
    table = last.join(hint(places_of(own, last, hint)), same_source("of", "at"), "left").select("of", "low", "last_entry", "last_place")
    return checkpointed(goal.join(hint(table), same_source("source", "of"), "left").drop("of", "rest"))


def copies(own: DataFrame, cuts: DataFrame) -> DataFrame:
    """own with its source's source_size and target, and how many copies of each row the mix takes."""
    table = cuts.withColumnRenamed("source", "of")
    table = F.broadcast(table) if cuts.count() <= BROADCAST_SOURCES else table
    taken = F.coalesce(F.col("key") < F.col("low"), F.lit(False)) | (entry() < F.col("last_entry")) | ((entry() == F.col("last_entry")) & (F.col("place") <= F.col("last_place")))
    taken = taken & (F.col("target") > F.col("epochs") * F.col("source_size"))  # complete epochs alone leave no fraction, not even of rows without words
    return own.join(table, same_source("source", "of")).withColumn("copies", F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("bigint"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of a document that the mix takes, repeats counted)."""
    own = sized(docs)
    return copies(own, cutoffs(own)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    own = sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    repeated = copies(own, cutoffs(own.drop("row"))).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return repeated.select("row.*")


ORACLE_SQL = r"""
WITH own AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / (1.0::DOUBLE / (1.0::DOUBLE + 20.0::DOUBLE * coalesce(len(regexp_extract_all(text, '[#*$%&|<>!]')), 0) / greatest(coalesce(length(text), 0), 1))) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM own GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
  2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM sources),
leveled AS (SELECT *, ((budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) * weight >= cap AS "full" FROM weighed),
goals AS (SELECT source, source_size, CASE WHEN "full" THEN cap ELSE (budget - sum(CASE WHEN "full" THEN cap ELSE 0.0::DOUBLE END) OVER ())
  / sum(CASE WHEN "full" THEN 0.0::DOUBLE ELSE weight END) OVER () * weight END AS target FROM leveled),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM goals),
placed AS (SELECT o.doc_id, o.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(o.size) OVER (PARTITION BY o.source ORDER BY o.key, o.doc_id NULLS LAST, o.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
  FROM own o JOIN epochs e ON o.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN so_far - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""
