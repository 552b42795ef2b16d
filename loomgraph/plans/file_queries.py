"""Queries for chunks, segments, feeds in pages and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import segments as G
from loomgraph.operators import match
from loomgraph.operators import report_gate as RG
from loomgraph.plans.bindings import Graph
from loomgraph.plans.registry import query
from loomgraph.sources import files


@query()
def sentence_chunks(g: Graph) -> DataFrame:
    """No SQL oracle: packing depends on what came before; tested on small texts."""
    return G.chunked(g.table("documents")).select("doc_id", "chunk", "tokens", "start", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def markdown_segments(g: Graph) -> DataFrame:
    return G.segmented(g.table("documents"))


@query("""SELECT uid AS id, '{"@id":"https://example.org/node/' || uid || '","@type":["https://example.org/Technology"],"name":"' || name || '"' || CASE WHEN l.d IS NULL THEN '' ELSE ',"links":{"https://example.org/DEPENDS_ON":[' || l.d || ']}' END || '}' AS document
FROM technologies LEFT JOIN (SELECT src, string_agg('"https://example.org/node/' || dst || '"', ',' ORDER BY 'https://example.org/node/' || dst) AS d FROM depends_on GROUP BY src) l ON l.src = uid""")
def export_json_ld(g: Graph) -> DataFrame:
    return files.json_ld(g.nodes.where("label = 'Technology'"), g.depends_on, "https://example.org/")


@query(r"""WITH i AS (SELECT page_id, unnest(regexp_split_to_array(html, '<(?:li|LI)[\s>]')[2:]) AS x FROM pages)
SELECT page_id, count(*) AS items, count(*) FILTER (WHERE regexp_matches(x, 'href="[^"]+"')) AS linked FROM i GROUP BY page_id""")
def listed_links(g: Graph) -> DataFrame:
    """List items of each page, and those with a link, cut apart as feeds are."""
    items = g.table("pages").select("page_id", F.explode(files.after_first(F.split("html", r"<(?:li|LI)[\s>]"))).alias("x"))
    return items.groupBy("page_id").agg(F.count("*").alias("items"), F.count_if(F.regexp_like("x", F.lit('href="[^"]+"'))).alias("linked"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, trim(line, ' ') AS line, count(*) AS n FROM l GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS lines, count(*) FILTER (WHERE n > 1 AND line <> '') AS repeated, CAST(sum(CASE WHEN line = '' THEN n ELSE 0 END) AS BIGINT) AS blank, CAST(sum(n * length(line)) AS BIGINT) < 500 AS short FROM c GROUP BY doc_id""")
def report_gate(g: Graph) -> DataFrame:
    """What a report is checked for: lines, repeated and blank ones, and whether it is too short."""
    line = F.explode(F.split("text", "\n"))
    counted = g.table("documents").select("doc_id", line.alias("line")).groupBy("doc_id", F.trim("line").alias("line")).agg(F.count("*").alias("n"))
    blank = F.col("line") == ""
    return counted.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count_if((F.col("n") > 1) & ~blank).alias("repeated"), F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"), (F.sum(F.col("n") * F.length("line")) < 500).alias("short"))


WRITTEN = """w AS (SELECT doc_id AS report, CASE WHEN doc_id % 3 = 0 THEN text ELSE '# Report' || chr(10) || '## Executive Summary' || chr(10) || chr(10) || text || chr(10) || '## 인과 분석' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |'
  || CASE WHEN doc_id % 5 = 0 THEN ' 3 |' ELSE '' END || chr(10) || chr(10) || '## 구조 분석' || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '- N/A' || chr(10) END || '## 부록' || chr(10) || substr(text, 1, 40) END AS text FROM documents)"""


def _written(g: Graph) -> DataFrame:
    """Documents as reports, two thirds of them with headings, tables and lists around their text."""
    text, when, key = F.col("text"), F.when, F.col("doc_id")
    table = F.concat(F.lit("\n## 인과 분석\n| a | b |\n|---|---|\n| 1 | 2 |"), when(key % 5 == 0, " 3 |").otherwise(""))
    tail = F.concat(F.lit("\n\n## 구조 분석\n"), when(key % 7 == 0, "").otherwise("- N/A\n"), F.lit("## 부록\n"), F.substring(text, 1, 40))
    whole = F.concat(F.lit("# Report\n## Executive Summary\n\n"), text, table, tail)
    return g.table("documents").select(key.alias("report"), when(key % 3 == 0, text).otherwise(whole).alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""WITH {WRITTEN}, l0 AS (SELECT report, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM w WHERE text IS NOT NULL),
l1 AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare, starts_with(line, '## ') AS heading FROM l0),
l AS (SELECT *, CAST(sum(CAST(heading AS INT)) OVER o AS INT) AS section, last_value(CASE WHEN heading THEN bare END IGNORE NULLS) OVER o AS title FROM l1 WINDOW o AS (PARTITION BY report ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, lead(heading, 1) OVER o AS h1, lead(heading, 2) OVER o AS h2, lead(heading, 3) OVER o AS h3, lead(bare = '' OR starts_with(bare, {_quoted(RG.BASIS)}), 1) OVER o AS v1, lead(bare = '' OR starts_with(bare, {_quoted(RG.BASIS)}), 2) OVER o AS v2 FROM l WINDOW o AS (PARTITION BY report ORDER BY i)),
t0 AS (SELECT report, i, length(bare) - length(replace(bare, '|', '')) - 1 AS c, i - row_number() OVER (PARTITION BY report ORDER BY i) AS t FROM l WHERE starts_with(bare, '|') AND ends_with(bare, '|')),
t1 AS (SELECT *, first_value(c) OVER (PARTITION BY report, t ORDER BY i) AS f FROM t0), t2 AS (SELECT *, row_number() OVER (PARTITION BY report, t ORDER BY i) AS k FROM t1 WHERE c <> f),
s0 AS (SELECT *, lag(title) OVER (PARTITION BY report, bare ORDER BY i) AS before FROM l WHERE section > 0 AND NOT heading AND length(bare) > 20), s1 AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY i) AS k FROM s0 WHERE before <> title),
p0 AS (SELECT *, sum(CAST(line = '' AS INT)) OVER (PARTITION BY report, section ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM l WHERE section > 0),
p1 AS (SELECT report, section, p, any_value(title) AS title, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS text, bool_or(contains(line, '종합 해석') OR contains(line, '이해관계자 시각')) AS marked FROM p0 GROUP BY report, section, p),
p2 AS (SELECT report, section, any_value(title) AS title, bool_or(marked OR (length(text) > 80 AND substr(text, 1, 1) NOT IN ('|', '-', '#', '*', '>'))) AS "read" FROM p1 GROUP BY report, section),
p3 AS (SELECT report, greatest(count(*) - 4, 1) AS main, count(*) FILTER (WHERE NOT "read" AND NOT contains(title, '부록')) AS unread FROM p2 GROUP BY report),
n AS (SELECT report, section, title, count(*) FILTER (WHERE {" OR ".join(f"contains(line, {_quoted(m)})" for m in RG.MISSING)}) AS none, count(*) FILTER (WHERE {" OR ".join(f"contains(line, {_quoted(m)})" for m in RG.MISSING)} OR starts_with(bare, '|') OR starts_with(bare, '-')) AS data
  FROM l WHERE section > 0 AND NOT heading GROUP BY report, section, title)
SELECT report, 'missing section' AS "check", s AS detail FROM w, (SELECT unnest([{", ".join(map(_quoted, RG.SECTIONS))}]) AS s) WHERE NOT contains(coalesce(text, ''), s)
UNION ALL SELECT report, 'empty section', bare FROM v WHERE heading AND (h1 OR (v1 AND h2) OR (v1 AND v2 AND h3))
UNION ALL SELECT report, 'broken table', 'line ' || (i + 1) || ': ' || f || ' and ' || c || ' columns' FROM t2 WHERE k = 1
UNION ALL SELECT report, 'artifact', a FROM w, (SELECT unnest([{", ".join(map(_quoted, RG.ARTIFACTS))}]) AS a) WHERE text IS NOT NULL AND regexp_matches(text, a)
UNION ALL SELECT report, 'too short', CAST(length(coalesce(text, '')) AS VARCHAR) FROM w WHERE length(coalesce(text, '')) < 500
UNION ALL SELECT report, 'repeated sentence', substr(bare, 1, 50) || ': ' || before || ' and ' || title FROM s1 WHERE k = 1
UNION ALL SELECT report, 'uninterpreted', unread || ' of ' || main FROM p3 WHERE unread / main::DOUBLE > 0.6
UNION ALL SELECT report, 'without data', title FROM n WHERE data > 0 AND none / data::DOUBLE > 0.5 AND NOT contains(title, '부록')""")
def report_issues(g: Graph) -> DataFrame:
    """What the eight checks of a report find."""
    return RG.issues(_written(g))


INCIDENTS = {"code": "`", "comma": ",", "stop": "[.]"}


@query("""WITH h AS (SELECT 'code' AS incident, conv_id, turn FROM conversations WHERE regexp_matches(text, '`') UNION ALL SELECT 'comma', conv_id, turn FROM conversations WHERE regexp_matches(text, ',') UNION ALL SELECT 'stop', conv_id, turn FROM conversations WHERE regexp_matches(text, '[.]')),
r AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY conv_id, turn) AS k FROM h) SELECT incident, conv_id, turn, k FROM r WHERE k <= 5""")
def mined_incidents(g: Graph) -> DataFrame:
    """The first five turns of each pattern."""
    text = F.col("text")
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(k)) for k, p in INCIDENTS.items()])))
    hits = g.table("conversations").select(kinds.alias("incident"), "conv_id", "turn")
    return match.top_per(hits, ["incident"], [F.col("conv_id"), F.col("turn")], 5, rank="k")
