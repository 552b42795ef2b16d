"""Readers of articles, feeds, crawls, logs and snapshots, and writers of exports, all by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T


def articles(spark: SparkSession, path: str, since: str | None = None, prefix: str = "") -> DataFrame:
    """Markdown files with front matter: slug, date, relevance, categories, links, title, summary bullets. since: only files modified after."""
    reader = spark.read.option("modifiedAfter", since) if since else spark.read
    return parsed_articles(reader.text(path, wholetext=True).select(F.col("value").alias("raw"), F.input_file_name().alias("file")), prefix)


def parsed_articles(raw: DataFrame, prefix: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """Articles of (raw, file); keep: further columns to carry along."""
    head = F.regexp_extract("raw", r"(?s)^---\n(.*?)\n---", 1)
    body = F.regexp_replace("raw", r"(?s)^---\n.*?\n---\n?", "")
    field = lambda name: F.trim(F.regexp_extract(head, rf"(?m)^{name}:\s*(.*)$", 1))
    inline = F.regexp_replace(field("categories"), r"[\[\]\"']", "")
    heading = F.regexp_extract(body, r"(?m)^# (.+)$", 1)
    return raw.select(
        F.concat(F.lit(prefix), T.file_slug(F.col("file"))).alias("slug"),
        F.substring(field("date"), 1, 10).try_cast("date").alias("date"),
        F.regexp_replace(field("relevance"), r"[🔴🟡🔵\s]", "").alias("relevance"),
        F.filter(F.transform(F.split(inline, ","), lambda c: F.trim(c)), lambda c: c != "").alias("categories"),
        field("source").alias("source"),
        F.when(heading != "", heading).otherwise(F.substring_index("file", "/", -1)).alias("title"),
        F.slice(F.regexp_extract_all(body, F.lit(r"(?m)^[-*] (.+)$"), F.lit(1)), 1, 5).alias("bullets"),
        body.alias("content"),
        *keep,
    )


def after_first(parts: Column) -> Column:
    """All of an array but its first entry."""
    return T.bound(parts, lambda p: F.slice(p, F.lit(2), F.size(p)))


def feed_items(feeds: DataFrame, limit: int = 50) -> DataFrame:
    """Items of RSS and Atom texts (feed, xml): title, link, summary without markup (500 characters), date; a fair share of the limit for each feed."""
    items = feeds.select("feed", F.posexplode(after_first(F.split("xml", r"(?i)<(?:item|entry)[\s>]"))).alias("place", "x"))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    plain = lambda c: F.trim(F.regexp_replace(T.decode_numeric(c), "<[^>]+>", ""))
    some = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit(""))
    link = some(tag("link"), F.regexp_extract("x", r"""(?i)<link[^>]*href=["']([^"']+)""", 1))
    rows = items.select("feed", "place", plain(tag("title")).alias("title"), link.alias("link"), F.substring(plain(some(tag("description"), tag("summary"))), 1, 500).alias("summary"), some(tag("pubDate"), tag("published"), tag("updated")).alias("published"))
    n = max(1, feeds.select("feed").distinct().count())
    quota = min(50, -(-limit // n))
    ranked = rows.where("title <> '' AND link <> ''").withColumn("k", F.row_number().over(Window.partitionBy("feed").orderBy("place")))
    return ranked.where(F.col("k") <= quota).drop("k")


def arxiv_entries(feeds: DataFrame) -> DataFrame:
    """Entries of an Atom answer (feed, xml): bare id, title, abstract (1000 characters), ten authors at most, distinct categories."""
    x = F.col("x")
    one = lambda name: F.trim(F.regexp_replace(F.regexp_extract(x, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"\s+", " "))
    entries = feeds.select("feed", F.explode(after_first(F.split("xml", "<entry>"))).alias("x"))
    bare = F.regexp_replace(F.regexp_replace(one("id"), "^https?://arxiv.org/abs/", ""), r"v\d+$", "")
    authors = F.slice(F.regexp_extract_all(x, F.lit(r"(?s)<name>\s*(.*?)\s*</name>"), F.lit(1)), 1, 10)
    return entries.select("feed", bare.alias("arxiv_id"), one("title").alias("title"), F.substring(one("summary"), 1, 1000).alias("abstract"), authors.alias("authors"), F.array_distinct(F.regexp_extract_all(x, F.lit(r'<category[^>]*term="([^"]+)"'), F.lit(1))).alias("categories"))


def crawl_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of crawl files {"source": ..., "items": [...]}; item: the schema of one item."""
    return spark.read.schema(f"source string, items array<struct<{item}>>").json(path, multiLine=True).select("source", F.inline("items"))


def log(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines of a known schema; lines that do not parse are dropped unless strict."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def snapshot_changes(snapshots: DataFrame, part: str) -> DataFrame:
    """One kind of change (events, propagation, actions, ...) of snapshots(round, changes), a row each, with its round."""
    return snapshots.select("round", F.inline(f"changes.{part}"))


def json_block(answer: Column, schema: str) -> Column:
    """The first {...} block of a free answer, parsed; null if there is none."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)


def json_ld(nodes: DataFrame, edges: DataFrame, base: str) -> DataFrame:
    """(id, document): each node as linked data, the targets of a predicate in one array."""
    grouped = edges.groupBy(F.col("src").alias("uid"), "type").agg(F.array_sort(F.collect_list(F.concat(F.lit(base + "node/"), F.col("dst")))).alias("targets"))
    links = grouped.groupBy("uid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(base), F.col("type")).alias("p"), "targets")))).alias("links"))
    own = nodes.join(links, "uid", "left")
    document = F.to_json(F.struct(F.concat(F.lit(base + "node/"), F.col("uid")).alias("@id"), F.array(F.concat(F.lit(base), F.col("label"))).alias("@type"), F.col("name").alias("name"), F.col("links").alias("links")))
    return own.select(F.col("uid").alias("id"), document.alias("document"))


def write_csv(df: DataFrame, path: str) -> None:
    """Fixed columns, lists joined by semicolons, quotes doubled."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def write_rounds(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("round").json(path)


def write_months(evidence: DataFrame, path: str) -> None:
    """Appends entries (with a month) to cold storage, a folder for each month."""
    evidence.write.mode("append").partitionBy("month").parquet(path)
