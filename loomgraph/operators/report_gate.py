"""Checks of written reports: sections, tables, artifacts, repetitions, interpretation and missing data.

A report's lines are rows. Sections are running counts of headings, tables and paragraphs are islands of lines between gaps, so every check is a window
or an aggregation over (report, line number); a report's own lines are all that a window holds.

Two checks go as far as their names say, where the published ones stop short: an empty section is found (the published loop ends at the next
heading before it looks at it), and a table that ends the report is looked at as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections that must be there, artifacts, marks of interpretation, and bounds.
SECTIONS = [
    "Executive Summary",
    "인과 분석",
    "구조 분석",
    "시스템 다이내믹스",
    "교차 분석 인사이트",
    "시나리오 분석",
    "핵심 엔티티 프로파일",
    "리스크 매트릭스",
    "전략적 권고사항",
    "부록",
]
ARTIFACTS = [r"```json", r'"[a-z_]+":\s*\{', r"\[object Object\]", r"undefined", r"None\b"]
BASIS, APPENDIX = "*분석 근거", "부록"
INTERPRETED = ["종합 해석", "이해관계자 시각"]
MISSING = ["N/A", "없습니다", "없음"]
SHORTEST, SENTENCE, PROSE, APPENDICES, UNREAD, ABSENT = 500, 20, 80, 4, 0.6, 0.5


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def lines_of(reports: DataFrame) -> DataFrame:
    """(report, i, line, bare, heading, section, title): every line, whether it is a heading, and the number and heading of its section (0: none yet)."""
    rows = reports.select("report", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).withColumn("bare", stripped(F.col("line")))
    order = Window.partitionBy("report").orderBy("i")
    rows = rows.withColumn("heading", F.startswith("line", F.lit("## "))).withColumn("section", F.sum(F.col("heading").cast("int")).over(order))
    return rows.withColumn("title", F.last(F.when(F.col("heading"), F.col("bare")), ignorenulls=True).over(order))


def _issue(rows: DataFrame, check: str, detail: Column) -> DataFrame:
    return rows.select("report", F.lit(check).alias("check"), detail.alias("detail"))


def missing_sections(reports: DataFrame) -> DataFrame:
    absent = F.filter(F.array(*[F.when(~F.contains(F.coalesce("text", F.lit("")), F.lit(s)), F.lit(s)) for s in SECTIONS]), lambda s: s.isNotNull())
    return _issue(reports.select("report", F.explode(absent).alias("s")), "missing section", F.col("s"))


def empty_sections(lines: DataFrame) -> DataFrame:
    """Headings that are followed by another one within three lines, with nothing but blank lines and notes on the basis between."""
    order = Window.partitionBy("report").orderBy("i")
    void = (F.col("bare") == "") | F.startswith("bare", F.lit(BASIS))
    ahead = [(F.lead("heading", k).over(order), F.lead(void, k).over(order)) for k in (1, 2, 3)]
    found = ahead[0][0] | (ahead[0][1] & ahead[1][0]) | (ahead[0][1] & ahead[1][1] & ahead[2][0])
    rows = lines.withColumn("found", F.coalesce(found, F.lit(False))).where("heading AND found")
    return _issue(rows, "empty section", F.col("bare"))


def broken_tables(lines: DataFrame) -> DataFrame:
    """The first row of each table that has another number of columns than its first one."""
    rows = lines.where(F.startswith("bare", F.lit("|")) & F.endswith("bare", F.lit("|"))).select("report", "i", (F.length("bare") - F.length(F.replace("bare", F.lit("|"), F.lit(""))) - 1).alias("columns"))
    island = rows.withColumn("table", F.col("i") - F.row_number().over(Window.partitionBy("report").orderBy("i")))
    order = Window.partitionBy("report", "table").orderBy("i")
    odd = island.withColumn("first", F.first("columns").over(order)).where("columns <> first").withColumn("k", F.row_number().over(order)).where("k = 1")
    return _issue(odd, "broken table", F.concat(F.lit("line "), (F.col("i") + 1).cast("string"), F.lit(": "), F.col("first").cast("string"), F.lit(" and "), F.col("columns").cast("string"), F.lit(" columns")))


def artifacts(reports: DataFrame) -> DataFrame:
    hits = F.filter(F.array(*[F.when(F.regexp_like("text", F.lit(p)), F.lit(p)) for p in ARTIFACTS]), lambda p: p.isNotNull())
    return _issue(reports.where("text IS NOT NULL").select("report", F.explode(hits).alias("p")), "artifact", F.col("p"))


def too_short(reports: DataFrame) -> DataFrame:
    size = F.coalesce(F.length("text"), F.lit(0))
    return _issue(reports.where(size < SHORTEST), "too short", size.cast("string"))


def repeated_sentences(lines: DataFrame) -> DataFrame:
    """The first line of over SENTENCE characters that stood last in a section of another heading."""
    long = lines.where((F.col("section") > 0) & ~F.col("heading") & (F.length("bare") > SENTENCE))
    before = F.lag("title").over(Window.partitionBy("report", "bare").orderBy("i"))
    again = long.withColumn("before", before).where("before <> title")
    first = again.groupBy("report").agg(F.min_by(F.struct("bare", "before", "title"), "i").alias("r"))
    return _issue(first, "repeated sentence", F.concat(F.substring("r.bare", 1, 50), F.lit(": "), F.col("r.before"), F.lit(" and "), F.col("r.title")))


def uninterpreted(lines: DataFrame) -> DataFrame:
    """Reports most of whose sections, but appendices, have neither a mark of interpretation nor a paragraph of prose."""
    order = Window.partitionBy("report", "section").orderBy("i")
    own = lines.where("section > 0").withColumn("paragraph", F.sum((F.col("line") == "").cast("int")).over(order))
    text = stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n"))
    marked = reduce(Column.__or__, [F.contains("line", F.lit(m)) for m in INTERPRETED])
    paragraphs = own.groupBy("report", "section", "paragraph").agg(F.first("title").alias("title"), text.alias("text"), F.bool_or(marked).alias("marked"))
    prose = (F.length("text") > PROSE) & ~F.substring("text", 1, 1).isin("|", "-", "#", "*", ">")
    sections = paragraphs.groupBy("report", "section").agg(F.bool_or(F.col("marked") | prose).alias("read"), F.first("title").alias("title"))
    unread = F.count_if(~F.col("read") & ~F.contains("title", F.lit(APPENDIX)))
    sums = sections.groupBy("report").agg(F.greatest(F.count("*") - APPENDICES, F.lit(1)).alias("main"), unread.alias("unread")).where(F.col("unread") / F.col("main") > UNREAD)
    return _issue(sums, "uninterpreted", F.concat(F.col("unread").cast("string"), F.lit(" of "), F.col("main").cast("string")))


def without_data(lines: DataFrame) -> DataFrame:
    """Sections, but appendices, most of whose lines of data say that there is none."""
    none = reduce(Column.__or__, [F.contains("line", F.lit(m)) for m in MISSING])
    data = none | F.startswith("bare", F.lit("|")) | F.startswith("bare", F.lit("-"))
    sums = lines.where("section > 0 AND NOT heading").groupBy("report", "section", "title").agg(F.count_if(none).alias("none"), F.count_if(data).alias("data"))
    return _issue(sums.where((F.col("data") > 0) & (F.col("none") / F.col("data") > ABSENT) & ~F.contains("title", F.lit(APPENDIX))), "without data", F.col("title"))


def issues(reports: DataFrame) -> DataFrame:
    """(report, check, detail): what the eight checks find in reports (report, text); a null text is an empty one."""
    lines = lines_of(reports)
    parts = [missing_sections(reports), empty_sections(lines), broken_tables(lines), artifacts(reports), too_short(reports), repeated_sentences(lines), uninterpreted(lines), without_data(lines)]
    return reduce(DataFrame.unionByName, parts)
