"""Readers, exports, segments and streams on small files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomgraph.functions import segments
from loomgraph.operators import repair
from loomgraph.sources import files
from loomgraph.streaming import evidence

ARTICLE = """---
date: 2026-03-01
relevance: 🔴 must
categories: [graphs, "search"]
source: https://example.org/a
---
# A title

## Summary
- first point
- second point
"""
RSS = """<rss><item><title><![CDATA[One &#38; only]]></title><link>https://x.org/1</link><description><b>bold</b> text</description></item>
<item><title>Two</title><link>https://x.org/2</link></item><item><title></title><link>https://x.org/3</link></item></rss>"""
ATOM = """<feed><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>A
  paper</title><summary> On graphs. </summary><author><name>Ann</name></author><author><name>Bo</name></author><category term="cs.DB"/><category term="cs.DB"/></entry></feed>"""


def test_articles_are_parsed(spark, tmp_path):
    (tmp_path / "2026-03-01-My Note.md").write_text(ARTICLE)
    row = files.articles(spark, f"file://{tmp_path}/*.md", prefix="p-").first()
    assert row["slug"].startswith("p-my") and str(row["date"]) == "2026-03-01" and row["relevance"] == "must"
    assert row["categories"] == ["graphs", "search"] and row["title"] == "A title" and row["bullets"] == ["first point", "second point"]


def test_feeds_give_a_share_each(spark):
    feeds = spark.createDataFrame([("a", RSS), ("b", RSS)], "feed string, xml string")
    got = files.feed_items(feeds, limit=2).orderBy("feed").collect()
    assert [(r["feed"], r["title"], r["link"], r["summary"]) for r in got] == [("a", "One & only", "https://x.org/1", "bold text"), ("b", "One & only", "https://x.org/1", "bold text")]


def test_atom_entries(spark):
    row = files.arxiv_entries(spark.createDataFrame([("a", ATOM)], "feed string, xml string")).first()
    assert (row["arxiv_id"], row["title"], row["abstract"], row["authors"], row["categories"]) == ("2401.00001", "A paper", "On graphs.", ["Ann", "Bo"], ["cs.DB"])


def test_crawls_logs_and_snapshots(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"source": "s", "items": [{"url": "u1"}, {"url": "u2"}]}))
    assert [tuple(r) for r in files.crawl_items(spark, f"file://{tmp_path}/c.json", "url string").collect()] == [("s", "u1"), ("s", "u2")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert files.log(spark, f"file://{tmp_path}/l.jsonl", "a int").where("a IS NOT NULL").count() == 2
    snaps = spark.sql("SELECT 3 AS round, named_struct('events', array(named_struct('uid', 'e', 'magnitude', 0.5))) AS changes")
    assert [tuple(r)[:2] for r in files.snapshot_changes(snaps, "events").collect()] == [(3, "e")]
    assert spark.range(1).select(files.json_block(F.lit('so: {"x": 4} done'), "x int").alias("j")).first()["j"]["x"] == 4


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 'say "hi"')], "uid string, tags array<string>, note string")
    files.write_csv(df, f"file://{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert "x;y" in text and '""hi""' in text
    nodes = spark.createDataFrame([("n1", "L", "one"), ("n2", "L", "two")], "uid string, label string, name string")
    edges = spark.createDataFrame([("n1", "n2", "T"), ("n1", "n1", "T")], "src string, dst string, type string")
    got = {r["id"]: json.loads(r["document"]) for r in files.json_ld(nodes, edges, "b/").collect()}
    assert got["n1"]["links"] == {"b/T": ["b/node/n1", "b/node/n2"]} and "links" not in got["n2"]


def test_chunks_overlap_and_keep_all_sentences(spark):
    text = " ".join(f"Sentence number {i} goes on a little." for i in range(40))
    rows = segments.chunked(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), 60, 15).collect()
    assert {r["doc_id"] for r in rows} == {1} and all(r["tokens"] <= 60 for r in rows)
    assert all(text[r["start"] : r["start"] + len(r["text"])] == r["text"] for r in rows)
    assert {i for r in rows for i in range(40) if f"number {i} " in r["text"]} == set(range(40))


def test_segments_know_their_heading(spark):
    text = "# Top\nintro text that is long enough to stand alone, surely it is\n\n## Sub\n- a\n- b\n| x | y |\n# Next\n"
    rows = segments.segmented(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("segment").collect()
    assert [(r["kind"], r["title"], r["parent"]) for r in rows][:4] == [("heading", "Top", -1), ("paragraph", "Top", 0), ("heading", "Sub", 0), ("list", "Sub", 2)]


def test_repair_resolves_names_in_order(spark):
    known = spark.createDataFrame([("Red Bolt",), ("red bolt",), ("Red Gear",)], "name string")
    asked = spark.createDataFrame([("Red Bolt",), ("RED GEAR",), ("red thing",), ("none",)], "name string")
    got = {r["name"]: (r["entity"], r["way"]) for r in repair.resolved_names(asked, known).collect()}
    assert got == {"Red Bolt": ("Red Bolt", 1), "RED GEAR": ("Red Gear", 2), "red thing": ("Red Bolt", 3)}


def test_streams(spark, tmp_path):
    rows = [(1, "u", "2024-01-01 10:00:00", "a", 1.0), (1, "u", "2024-01-01 10:00:00", "a", 1.0), (2, "u", "2024-01-01 12:00:00", "b", 2.0), (3, "u", "2024-01-09 00:00:00", "a", 3.0)]
    frame = spark.createDataFrame(rows, "event_id long, uid string, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(f"file://{tmp_path}/in")
    stream = evidence.incoming(spark, f"file://{tmp_path}/in", frame.schema)
    query = evidence.append_log(evidence.once_each(stream), f"file://{tmp_path}/log", f"file://{tmp_path}/ck")
    query.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 3
    again = evidence.append_log(evidence.once_each(evidence.incoming(spark, f"file://{tmp_path}/in", frame.schema)), f"file://{tmp_path}/log", f"file://{tmp_path}/ck")
    again.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 3
    told = evidence.windowed_trend(stream).writeStream.format("memory").queryName("trend").outputMode("complete").trigger(availableNow=True).start()
    told.awaitTermination(120)
    assert {(r["event_type"], r["n"]) for r in spark.table("trend").collect()} == {("a", 2), ("b", 1), ("a", 1)}
