"""Queries on names, documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.plans.bindings import Graph
from loomgraph.plans.registry import query

joined = lambda c: F.array_join(c, "|")


def sql_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


SLUG = r"regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-+$', '')"


@query(f"SELECT uid, label, label || ':' || {SLUG.format('name')} AS slug FROM nodes WHERE label <> 'Claim'")
def uid_slugs(g: Graph) -> DataFrame:
    return g.nodes.where("label <> 'Claim'").select("uid", "label", F.concat("label", F.lit(":"), T.slug(F.col("name"))).alias("slug"))


@query("SELECT page_id, " + SLUG.format(r"regexp_replace(regexp_replace(split_part(url, '/', -1), '\.\w+$', ''), '^\d{4}-\d{2}-\d{2}-', '')") + " AS slug FROM pages")
def page_slugs(g: Graph) -> DataFrame:
    return g.table("pages").select("page_id", T.file_slug(F.col("url")).alias("slug"))


@query(r"""SELECT uid, trim(regexp_replace(regexp_replace(lower(name), '[._-]', '', 'g'), '\s+', ' ', 'g')) AS normal, translate(lower(name), ' _', '') AS bare FROM nodes WHERE label <> 'Claim'""")
def normal_names(g: Graph) -> DataFrame:
    return g.nodes.where("label <> 'Claim'").select("uid", T.normal_name(F.col("name")).alias("normal"), T.bare_name(F.col("name")).alias("bare"))


def _guard_sql() -> str:
    hidden = [f"CASE WHEN contains(html, chr({ord(c)})) THEN 'invisible_unicode_U+{ord(c):04x}' END" for c in T.INVISIBLE]
    found = ["CASE WHEN regexp_matches(html, '{}', 'i') THEN '{}' END".format(p.replace("'", "''"), k) for k, p in T.THREATS.items()]
    clean = "html"
    for c in T.INVISIBLE:
        clean = f"replace({clean}, chr({ord(c)}), '')"
    for p in T.THREATS.values():
        clean = "regexp_replace({}, '{}', '[REDACTED]', 'i')".format(clean, p.replace("'", "''"))
    return f"SELECT page_id, array_to_string(list_filter([{', '.join(hidden + found)}], lambda x: x IS NOT NULL), '|') AS threats, md5({clean}) AS cleaned FROM pages"


@query(_guard_sql())
def content_guard(g: Graph) -> DataFrame:
    html = F.col("html")
    return g.table("pages").select("page_id", joined(T.threats(html)).alias("threats"), F.md5(T.cleaned(html).cast("binary")).alias("cleaned"))


def _intent_sql() -> str:
    whens = " ".join("WHEN regexp_matches(text, '{}', 'i') THEN '{}'".format(p[4:].replace("(?![0-9A-Za-z_])", r"\b"), k) for k, p in T.INTENTS.items())
    hard = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(trim(text)), '{w}') THEN '{w}' END" for w in T.HARD_WORDS) + ")"
    return rf"""WITH q AS (SELECT conv_id, turn, text, CASE {whens} ELSE 'search' END AS intent, {hard} AS word, length(trim(text)) > 80 AS long,
len(regexp_extract_all(trim(text), '[,?.]')) > 1 AS clauses, length(text) * 10 > 1200 AS wide FROM conversations)
SELECT conv_id, turn, intent, CASE WHEN long OR word IS NOT NULL OR clauses OR wide THEN 'hard' ELSE 'easy' END AS tier,
array_to_string(list_filter([CASE WHEN long THEN 'long-question' ELSE 'short' END, CASE WHEN word IS NULL THEN 'no-hop-words' ELSE 'hop-word:' || word END,
CASE WHEN clauses THEN 'multi-clause' END, CASE WHEN wide THEN 'wide-context' END], lambda x: x IS NOT NULL), '|') AS reasons FROM q"""


@query(_intent_sql())
def question_complexity(g: Graph) -> DataFrame:
    """Intent, tier and reasons of every turn, a context of ten times its length supposed."""
    asked = g.table("conversations").withColumn("c", T.complexity(F.col("text"), F.length("text") * 10))
    return asked.select("conv_id", "turn", T.intent(F.col("text")).alias("intent"), "c.tier", joined(F.col("c.reasons")).alias("reasons"))


@query(rf"""WITH t AS (SELECT conv_id, turn, text, unnest(regexp_split_to_array(lower(text), '\s+')) AS raw, generate_subscripts(regexp_split_to_array(lower(text), '\s+'), 1) AS i FROM conversations),
k AS (SELECT *, regexp_replace(raw, '[^a-z0-9가-힣]', '', 'g') AS w FROM t),
r AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(w) DESC, i) AS n FROM k WHERE length(w) >= 2 AND w NOT IN {sql_list(T.KEYWORD_STOPS)})
SELECT c.conv_id, c.turn, coalesce(r.w, c.text) AS keyword FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn AND r.n = 1""")
def question_keyword(g: Graph) -> DataFrame:
    return g.table("conversations").select("conv_id", "turn", T.keyword(F.col("text")).alias("keyword"))


@query(rf"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\b[a-zA-Z][a-zA-Z-]{{3,}}\b') AS ws FROM conversations),
w AS (SELECT conv_id, turn, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS i FROM t),
d AS (SELECT conv_id, turn, w, min(i) AS i FROM w WHERE w NOT IN {sql_list(T.PHRASE_STOPS)} GROUP BY conv_id, turn, w),
r AS (SELECT conv_id, turn, w, i, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS n FROM d)
SELECT c.conv_id, c.turn, coalesce(string_agg(w, '|' ORDER BY i), '') AS phrases FROM conversations c LEFT JOIN r ON r.conv_id = c.conv_id AND r.turn = c.turn AND n <= 3 GROUP BY c.conv_id, c.turn""")
def concept_phrases(g: Graph) -> DataFrame:
    return g.table("conversations").select("conv_id", "turn", joined(T.concept_phrases(F.col("text"))).alias("phrases"))


@query(rf"""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b([A-Z][a-zA-Z0-9+.#-]+(?:\s[A-Z][a-zA-Z0-9+.#-]+)?)\b', 1), lambda t: t NOT IN {sql_list(T.QUERY_NOISE)}))), '|') AS tokens,
array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\b[A-Z][A-Za-z0-9-]{{1,}}(?:\s[A-Z][A-Za-z0-9-]+)*\b'), lambda t: lower(t) NOT IN ('the', 'a', 'an', 'and', 'or', 'is', 'was', 'in', 'on', 'for', 'to', 'by')))), '|') AS cited FROM benchmark""")
def capitalised_names(g: Graph) -> DataFrame:
    text = F.col("text")
    return g.table("benchmark").select("item_id", joined(F.array_sort(T.tech_tokens(text))).alias("tokens"), joined(F.array_sort(T.cited_names(text))).alias("cited"))


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_split_to_array(trim(text), '\s+') AS ws FROM conversations)
SELECT conv_id, turn, len(ws) AS n_words, CASE WHEN len(ws) > 3 THEN len(ws) - 2 ELSE 1 END AS n_windows, array_to_string(ws[1:3], ' ') AS first_window FROM w""")
def query_windows(g: Graph) -> DataFrame:
    spans = T.word_windows(F.col("text"))
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return g.table("conversations").select("conv_id", "turn", words.cast("bigint").alias("n_words"), F.size(spans).cast("bigint").alias("n_windows"), spans[0].alias("first_window"))


TAGS = {"license": ["license", "rights reserved"], "contact": ["@", "http"], "greeting": ["hello", "thanks"], "tables": [" | "]}


@query("SELECT doc_id, CASE WHEN len(t) = 0 THEN 'general' ELSE array_to_string(t, '|') END AS tags FROM (SELECT doc_id, list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in TAGS.items()) + "], lambda x: x IS NOT NULL) AS t FROM documents)")
def keyword_tags(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", joined(T.tags(F.col("text"), TAGS, "general")).alias("tags"))


@query("""SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens, greatest(len(regexp_extract_all(text, '[.?!。]')), 1) AS sentences,
CASE WHEN ceil(length(text) / 4) <= 3000 THEN 'low' WHEN ceil(length(text) / 4) <= 8000 THEN 'medium' ELSE 'high' END AS risk,
CAST(greatest(1, ceil(ceil(length(text) / 4) / 250)) AS BIGINT) AS chunks,
CAST(greatest(1, ceil(ceil(length(text) / 4) / 250)) * CASE WHEN ceil(length(text) / 4) > 8000 THEN 2 ELSE 1 END AS BIGINT) AS calls FROM documents""")
def preflight(g: Graph) -> DataFrame:
    return g.table("documents").select("doc_id", T.preflight(F.col("text")).alias("p")).select("doc_id", "p.*")


def _html_sql() -> str:
    out = "html"
    for tag in ("script", "style", "nav", "footer", "header", "aside", "noscript"):
        out = rf"regexp_replace({out}, '<{tag}[\s\S]*?</{tag}>', '', 'gi')"
    out = rf"regexp_replace({out}, '<!--[\s\S]*?-->', '', 'g')"
    part = r"""coalesce(nullif(regexp_extract(a, '<article[\s\S]*?</article>', 0, 'i'), ''), nullif(regexp_extract(a, '<main[\s\S]*?</main>', 0, 'i'), ''),
nullif(regexp_extract(a, '<div[^>]*class="[^"]*(?:content|article|post|entry|body)[^"]*"[\s\S]*?</div>', 0, 'i'), ''), a)"""
    text = r"regexp_replace(regexp_replace(b, '</?(p|div|br|h[1-6]|li|tr|blockquote|pre|section)[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g')"
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        text = f"replace({text}, '{name}', '{char}')"
    number = r"CASE WHEN regexp_matches(x, '^[xX][0-9a-fA-F]{1,6};') THEN chr(CAST('0x' || regexp_extract(x, '^[xX]([0-9a-fA-F]+);', 1) AS INT)) || substr(x, instr(x, ';') + 1) WHEN regexp_matches(x, '^[0-9]{1,7};') THEN chr(CAST(regexp_extract(x, '^([0-9]+);', 1) AS INT)) || substr(x, instr(x, ';') + 1) ELSE '&#' || x END"
    text = f"array_to_string(list_transform(string_split({text}, '&#'), lambda x, i: CASE WHEN i = 1 THEN x ELSE {number} END), '')"
    return rf"""WITH s AS (SELECT page_id, {out} AS a FROM pages), m AS (SELECT page_id, {part} AS b FROM s),
l AS (SELECT page_id, list_filter(list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20 OR regexp_matches(x, '^[#\-*]|^\d+\.')) AS ls FROM m),
t AS (SELECT page_id, substr(array_to_string(ls, chr(10)), 1, 50000) AS t FROM l)
SELECT page_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n_lines, md5(t) AS text_md5 FROM t"""


@query(_html_sql())
def html_to_text(g: Graph) -> DataFrame:
    """The text of each page, of 50,000 characters at most: its lines and checksum."""
    text = T.html_to_text(F.col("html"))
    return g.table("pages").select("page_id", text.alias("t")).select("page_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("bigint").alias("n_lines"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("""SELECT lower(name) AS name, count(*) AS n, array_to_string(list_sort(list_distinct(list(brand))), '; ') AS description, CAST(arg_min(size, key) FILTER (WHERE size <> 0) AS INT) AS size FROM technologies GROUP BY lower(name)""")
def merge_by_name(g: Graph) -> DataFrame:
    """Entities of one name: descriptions joined, the first number that is not zero."""
    size = F.min_by(F.when(F.col("size") != 0, F.col("size")), F.when(F.col("size") != 0, F.col("key")))
    return g.technologies.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("brand")), "; ").alias("description"), size.alias("size"))
