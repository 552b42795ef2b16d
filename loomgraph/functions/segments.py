"""Chunks and segments of long texts: packing sentences and following headings is a walk over one text, done inside tasks in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CHUNKS = "doc_id bigint, chunk int, tokens int, start int, text string"
SEGMENTS = "doc_id bigint, segment int, kind string, title string, depth int, parent int, start int, length int"
SENTENCE = re.compile(r"(?<=[.?!。])\s+|\n+")
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")


def tokens_of(text: str) -> int:
    """A stand-in for a tokenizer: a quarter of the characters, rounded up."""
    return -(-len(text) // 4)


def pack(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(tokens, start, text) of chunks of whole sentences; each begins with the last sentences of the one before, up to the overlap."""
    held: list[tuple[str, int]] = []
    total = place = start = 0
    for sentence in filter(None, (s.strip() for s in SENTENCE.split(text))):
        cost = tokens_of(sentence)
        if held and total + cost > size:
            yield total, start, " ".join(s for s, _ in held)
            keep, kept = len(held), 0
            while keep and kept + held[keep - 1][1] <= overlap:
                keep -= 1
                kept += held[keep][1]
            held, total = held[keep:], kept
            start = place - sum(len(s) + 1 for s, _ in held)
        held.append((sentence, cost))
        total += cost
        place += len(sentence) + 1
    if held:
        yield total, start, " ".join(s for s, _ in held)


def kind_of(line: str) -> str:
    if HEADING.match(line):
        return "heading"
    if line.startswith("|") or " | " in line:
        return "table"
    return "list" if re.match(r"[-*+]\s|\d+[.)]\s", line) else "paragraph"


def parts(text: str, least: int = 50) -> list[list]:
    """[kind, title, depth, parent, start, length]: runs of lines of one kind under their heading; a short run joins the one before of its kind."""
    found: list[list] = []
    headings: list[tuple[int, int]] = []
    title, at = "", 0
    for line in text.split("\n"):
        stripped = line.strip()
        kind = kind_of(stripped) if stripped else ""
        if kind == "heading":
            depth, title = len(HEADING.match(stripped)[1]), HEADING.match(stripped)[2]
            headings = [h for h in headings if h[0] < depth]
            found.append(["heading", title, depth, headings[-1][1] if headings else -1, at, len(line)])
            headings.append((depth, len(found) - 1))
        elif kind:
            last = found[-1] if found else None
            near = last is not None and last[0] != "heading" and last[4] + last[5] + 1 == at
            if near and (last[0] == kind or len(line) < least and last[5] < least):
                last[5] = at + len(line) - last[4]
            else:
                found.append([kind, title, headings[-1][0] if headings else 0, headings[-1][1] if headings else -1, at, len(line)])
        at += len(line) + 1
    return found


def _rows(docs: DataFrame, schema: str, of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, k, *row) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()) for k, row in enumerate(of(t or ""))]
                yield pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in rows], types[j]) for j, n in enumerate(names)})

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def chunked(docs: DataFrame, size: int = 600, overlap: int = 100) -> DataFrame:
    return _rows(docs, CHUNKS, lambda t: pack(t, size, overlap))


def segmented(docs: DataFrame, least: int = 50) -> DataFrame:
    return _rows(docs, SEGMENTS, lambda t: parts(t, least))
