"""A knowledge graph over the star schema, event and document tables.

Parts are technologies, suppliers organizations, customers persons, nations and regions topics, orders articles, and documents
claims. Every view is a plain DataFrame that Catalyst can prune and push down into; nothing is materialised here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that questions about "now" take for today.
AS_OF = "2025-06-30"


def uid(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), key.cast("string"))


def edge(src: Column, dst: Column, kind: str, confidence: Column | float = 0.7) -> list[Column]:
    value = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), value.cast("double").alias("confidence")]


@dataclass(frozen=True)
class Graph:
    """The tables of one folder, as graph views."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def technologies(self) -> DataFrame:
        return self.table("part").select(uid("tech", F.col("p_partkey")).alias("uid"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))

    @cached_property
    def organizations(self) -> DataFrame:
        return self.table("supplier").select(uid("org", F.col("s_suppkey")).alias("uid"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))

    @cached_property
    def persons(self) -> DataFrame:
        return self.table("customer").select(uid("person", F.col("c_custkey")).alias("uid"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))

    @cached_property
    def topics(self) -> DataFrame:
        nations = self.table("nation").select(uid("topic:n", F.col("n_nationkey")).alias("uid"), F.col("n_name").alias("name"))
        return nations.unionAll(self.table("region").select(uid("topic:r", F.col("r_regionkey")).alias("uid"), F.col("r_name").alias("name")))

    @cached_property
    def articles(self) -> DataFrame:
        rank = F.substring("o_orderpriority", 1, 1)
        relevance = F.when(rank == "1", "must-read").when(rank == "2", "recommended").otherwise("reference")
        return self.table("orders").select(uid("article", F.col("o_orderkey")).alias("uid"), F.col("o_orderkey").alias("key"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.to_date("o_orderdate").alias("published_date"), relevance.alias("relevance"))

    @cached_property
    def claims(self) -> DataFrame:
        """Three related entities each, which two to fifteen other claims share, whatever the number of documents."""
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        key = F.col("doc_id")
        day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 365).cast("int"))
        kind = F.element_at(F.array(*map(F.lit, ("fact", "opinion", "prediction", "comparison"))), (key % 4 + 1).cast("int"))
        confidence = F.round(F.lit(0.2) + F.lit(0.5) * F.coalesce(F.col("quality").cast("double"), F.lit(0.5)) + (F.col("n_chars") % 100) / F.lit(400.0), 4)
        return (
            self.table("documents")
            .join(labels, "doc_id", "left")
            .select(
                uid("claim", key).alias("uid"),
                key.alias("key"),
                F.col("text").alias("content"),
                kind.alias("claim_type"),
                confidence.alias("confidence"),
                F.when(key % 6 == 0, F.lit(0.3)).cast("double").alias("confidence_decay"),
                day.alias("valid_from"),
                F.when(key % 5 == 0, F.date_add(day, 90)).alias("valid_until"),
                F.when(key % 3 == 0, F.date_add(day, 30)).alias("last_verified"),
                F.when(key % 7 == 0, F.lit(True)).when(key % 7 < 5, F.lit(False)).alias("verified"),
                F.array(*[uid("tech", F.floor(key / n)) for n in (3, 5, 16)]).alias("related_entities"),
                F.col("source").alias("source"),
            )
        )

    @cached_property
    def discusses(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey").distinct()
        return lines.select(*edge(uid("article", F.col("l_orderkey")), uid("tech", F.col("l_partkey")), "DISCUSSES", 0.8))

    @cached_property
    def depends_on(self) -> DataFrame:
        key = F.col("key")
        thirds = self.technologies.where((key % 3 == 0) & (key > 0)).select(*edge(F.col("uid"), uid("tech", F.floor(key / 3)), "DEPENDS_ON", 0.9))
        return thirds.unionAll(self.technologies.where((key % 4 == 1) & (key > 1)).select(*edge(F.col("uid"), uid("tech", F.floor(key / 4)), "DEPENDS_ON", 0.6)))

    @cached_property
    def edges(self) -> DataFrame:
        orders, lines, key = self.table("orders"), self.table("lineitem"), F.col
        customers = self.table("customer")
        mentions = lines.select("l_orderkey", "l_suppkey").distinct().select(*edge(uid("article", key("l_orderkey")), uid("org", key("l_suppkey")), "MENTIONS", 0.5))
        develops = lines.select("l_suppkey", "l_partkey").distinct().select(*edge(uid("org", key("l_suppkey")), uid("tech", key("l_partkey")), "DEVELOPS", 0.7))
        written = orders.select(*edge(uid("article", key("o_orderkey")), uid("person", key("o_custkey")), "WRITTEN_BY", 1.0))
        member = customers.select(*edge(uid("person", key("c_custkey")), uid("topic:n", key("c_nationkey")), "AFFILIATED_WITH", 0.6))
        sub = self.table("nation").select(*edge(uid("topic:n", key("n_nationkey")), uid("topic:r", key("n_regionkey")), "SUBTOPIC_OF", 1.0))
        parts = [self.discusses, mentions, develops, written, member, sub, self.depends_on, self.tagged_with, self.about]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionAll(more)
        return out

    @cached_property
    def tagged_with(self) -> DataFrame:
        nation = self.table("customer").select("c_custkey", "c_nationkey")
        return self.table("orders").join(nation, F.col("o_custkey") == F.col("c_custkey")).select(*edge(uid("article", F.col("o_orderkey")), uid("topic:n", F.col("c_nationkey")), "TAGGED_WITH", 0.5))

    @cached_property
    def about(self) -> DataFrame:
        """Article to claim, one for each document."""
        return self.table("documents").select(*edge(uid("article", F.floor(F.col("doc_id") / 2)), uid("claim", F.col("doc_id")), "CLAIMS", 0.9))

    @cached_property
    def supports(self) -> DataFrame:
        """Claim to claim: every fact supports the claim before it, and that of half its key."""
        key = F.col("doc_id")
        facts = self.table("documents").where((key % 4 == 0) & (key > 3)).select("doc_id")
        near = facts.select(*edge(uid("claim", key), uid("claim", key - 1), "SUPPORTS", 0.6))
        return near.unionAll(facts.select(*edge(uid("claim", key), uid("claim", F.floor(key / 2)), "SUPPORTS", 0.5)))

    @cached_property
    def nodes(self) -> DataFrame:
        take = lambda df, label, name="name": df.select("uid", F.lit(label).alias("label"), F.col(name).alias("name"))
        return (
            take(self.technologies, "Technology")
            .unionAll(take(self.organizations, "Organization"))
            .unionAll(take(self.persons, "Person"))
            .unionAll(take(self.topics, "Topic"))
            .unionAll(take(self.articles, "Article", "title"))
            .unionAll(self.table("documents").select(uid("claim", F.col("doc_id")).alias("uid"), F.lit("Claim").alias("label"), F.col("text").alias("name")))
        )

    @cached_property
    def events(self) -> DataFrame:
        """Evidence entries: who, when, what and how much, with a sequence number to break ties."""
        return self.table("events").select("event_id", uid("user", F.col("user_id")).alias("uid"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


#: The same views for DuckDB, as common table expressions.
SQL_VIEWS = """
technologies AS (SELECT 'tech:' || p_partkey AS uid, p_partkey AS key, p_name AS name, lower(p_type) AS kind, p_brand AS brand, p_size AS size FROM part),
organizations AS (SELECT 'org:' || s_suppkey AS uid, s_suppkey AS key, s_name AS name FROM supplier),
persons AS (SELECT 'person:' || c_custkey AS uid, c_custkey AS key, c_name AS name FROM customer),
topics AS (SELECT 'topic:n:' || n_nationkey AS uid, n_name AS name FROM nation UNION ALL SELECT 'topic:r:' || r_regionkey, r_name FROM region),
articles AS (SELECT 'article:' || o_orderkey AS uid, o_orderkey AS key, 'Order ' || o_orderkey AS title, CAST(o_orderdate AS DATE) AS published_date,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'must-read' WHEN '2' THEN 'recommended' ELSE 'reference' END AS relevance FROM orders),
claims AS (SELECT 'claim:' || d.doc_id AS uid, d.doc_id AS key, d.text AS content, ['fact', 'opinion', 'prediction', 'comparison'][CAST(d.doc_id % 4 + 1 AS INT)] AS claim_type,
  round(0.2::DOUBLE + 0.5::DOUBLE * coalesce(CAST(q.quality AS DOUBLE), 0.5::DOUBLE) + (n_chars % 100) / 400.0::DOUBLE, 4) AS confidence,
  CASE WHEN d.doc_id % 6 = 0 THEN 0.3::DOUBLE END AS confidence_decay,
  DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT) AS valid_from,
  CASE WHEN d.doc_id % 5 = 0 THEN DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT) + 90 END AS valid_until,
  CASE WHEN d.doc_id % 3 = 0 THEN DATE '2024-01-01' + CAST(d.doc_id % 365 AS INT) + 30 END AS last_verified,
  CASE WHEN d.doc_id % 7 = 0 THEN TRUE WHEN d.doc_id % 7 < 5 THEN FALSE END AS verified,
  ['tech:' || (d.doc_id // 3), 'tech:' || (d.doc_id // 5), 'tech:' || (d.doc_id // 16)] AS related_entities, d.source AS source
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON d.doc_id = q.doc_id),
discusses AS (SELECT DISTINCT 'article:' || l_orderkey AS src, 'tech:' || l_partkey AS dst, 'DISCUSSES' AS type, 0.8::DOUBLE AS confidence FROM lineitem),
depends_on AS (SELECT uid AS src, 'tech:' || (key // 3) AS dst, 'DEPENDS_ON' AS type, 0.9::DOUBLE AS confidence FROM technologies WHERE key % 3 = 0 AND key > 0
  UNION ALL SELECT uid, 'tech:' || (key // 4), 'DEPENDS_ON', 0.6::DOUBLE FROM technologies WHERE key % 4 = 1 AND key > 1),
tagged_with AS (SELECT 'article:' || o_orderkey AS src, 'topic:n:' || c_nationkey AS dst, 'TAGGED_WITH' AS type, 0.5::DOUBLE AS confidence FROM orders JOIN customer ON o_custkey = c_custkey),
about AS (SELECT 'article:' || (doc_id // 2) AS src, 'claim:' || doc_id AS dst, 'CLAIMS' AS type, 0.9::DOUBLE AS confidence FROM documents),
supports AS (SELECT 'claim:' || doc_id AS src, 'claim:' || (doc_id - 1) AS dst, 'SUPPORTS' AS type, 0.6::DOUBLE AS confidence FROM documents WHERE doc_id % 4 = 0 AND doc_id > 3
  UNION ALL SELECT 'claim:' || doc_id, 'claim:' || (doc_id // 2), 'SUPPORTS', 0.5::DOUBLE FROM documents WHERE doc_id % 4 = 0 AND doc_id > 3),
edges AS (SELECT * FROM discusses
  UNION ALL SELECT DISTINCT 'article:' || l_orderkey, 'org:' || l_suppkey, 'MENTIONS', 0.5::DOUBLE FROM lineitem
  UNION ALL SELECT DISTINCT 'org:' || l_suppkey, 'tech:' || l_partkey, 'DEVELOPS', 0.7::DOUBLE FROM lineitem
  UNION ALL SELECT 'article:' || o_orderkey, 'person:' || o_custkey, 'WRITTEN_BY', 1.0::DOUBLE FROM orders
  UNION ALL SELECT 'person:' || c_custkey, 'topic:n:' || c_nationkey, 'AFFILIATED_WITH', 0.6::DOUBLE FROM customer
  UNION ALL SELECT 'topic:n:' || n_nationkey, 'topic:r:' || n_regionkey, 'SUBTOPIC_OF', 1.0::DOUBLE FROM nation
  UNION ALL SELECT * FROM depends_on UNION ALL SELECT * FROM tagged_with UNION ALL SELECT * FROM about),
nodes AS (SELECT uid, 'Technology' AS label, name FROM technologies UNION ALL SELECT uid, 'Organization', name FROM organizations UNION ALL SELECT uid, 'Person', name FROM persons
  UNION ALL SELECT uid, 'Topic', name FROM topics UNION ALL SELECT uid, 'Article', title FROM articles UNION ALL SELECT 'claim:' || doc_id, 'Claim', text FROM documents),
evidence AS (SELECT event_id, 'user:' || user_id AS uid, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
"""


def sql(body: str) -> str:
    """A query over the views; a body that starts with WITH adds common table expressions of its own."""
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + SQL_VIEWS + ", " + body[len("WITH RECURSIVE ") :]
    return "WITH " + SQL_VIEWS + (", " + body[len("WITH ") :] if body.startswith("WITH ") else " " + body)
