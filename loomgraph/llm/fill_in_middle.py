"""Fill-in-middle transformation by piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: the bytes of its chunk, as Arrow
holds them, and the sentinels. Two cuts split the one descriptor of a text into prefix, middle and suffix; an arrangement is a permutation
of these three and of the sentinels' descriptors, and its inverse restores the text. Digests are fed one descriptor after the
other, so no arranged text is built for them. Restoring reads nothing but the output's bytes and its form: the sentinels, which an arranged
text never held, part the output into descriptors again, and the inverse permutation puts these in order.

Cuts fall between tokens (`[A-Za-z]+|[^A-Za-z]`), whose starts numpy marks for a whole chunk of texts. Which cuts and which form a
document gets depends on its doc_id alone (the sha256 of seed and id), so reruns agree.

Nulls: a null text is empty and stays plain; a null doc_id hashes as the seed alone. Texts that hold a sentinel stay plain. Repeated rows
give repeated rows; no ties can arise. An empty table gives no rows. digests reads doc_id and text only; transform carries the input as one
struct, so no column's name can clash. A very long text is a chunk of its own, some 20 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import common as C

SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20
SENTINELS = (b"<P>", b"<S>", b"<M>")
MARKS = b"".join(SENTINELS)
TEXT, MARK = 0, 1
#: A document's descriptors once cut: prefix, middle, suffix, and the three sentinels; arrangements are permutations of these.
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)
ARRANGEMENTS = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, length) over buffers that are never changed."""

    buffers: tuple[memoryview, ...]
    pieces: tuple[tuple[int, int, int], ...]

    def cut(self, at: int) -> PieceTable:
        """Splits the descriptor that holds the document's byte `at`; a cut at an end gives an empty descriptor."""
        out, passed, open_ = [], 0, True
        for buffer, start, length in self.pieces:
            if open_ and at <= passed + length:
                out += [(buffer, start, at - passed), (buffer, start + at - passed, length - (at - passed))]
                open_ = False
            else:
                out.append((buffer, start, length))
            passed += length
        if open_:
            raise ValueError(f"no byte {at} in {passed} bytes")
        return PieceTable(self.buffers, tuple(out))

    def with_marks(self) -> PieceTable:
        ends = np.cumsum([0, *map(len, SENTINELS)]).tolist()
        return PieceTable(self.buffers, (*self.pieces, *((MARK, a, b - a) for a, b in zip(ends, ends[1:]))))

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.pieces[i] for i in order))

    def restored(self, order: tuple[int, ...]) -> PieceTable:
        """The descriptors before they were arranged in this order."""
        inverse = [0] * len(order)
        for place, i in enumerate(order):
            inverse[i] = place
        return self.arranged(tuple(inverse))

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def digest(self) -> str:
        sha = hashlib.sha256()
        for part in self.stream():
            sha.update(part)
        return sha.hexdigest()


def read_output(output: bytes | memoryview, form: str) -> PieceTable:
    """The text's descriptors over an output, found by its sentinels and put back in order; the form says how it was arranged."""
    view = memoryview(output)
    if form == "plain":
        return PieceTable((view,), ((TEXT, 0, len(view)),))
    order, raw = ARRANGEMENTS[form], bytes(view)
    pieces, at = [], 0
    for mark in (i for i in order if i >= P):
        found = raw.find(SENTINELS[mark - P], at)
        if found < 0 or (not pieces and found):
            raise ValueError(f"not a text in the form {form}")
        if pieces:
            pieces.append((TEXT, at, found - at))
        at = found + len(SENTINELS[mark - P])
        pieces.append((TEXT, found, at - found))
    table = PieceTable((view,), (*pieces, (TEXT, at, len(view) - at))).restored(order)
    return PieceTable(table.buffers, table.pieces[:P])


def token_starts(texts: C.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where each token starts in the bytes, and the number of tokens before each document (n + 1)."""
    data = texts.data
    start = (data & 0xC0) != 0x80
    letter = LETTER[data]
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, texts.offsets)


@dataclass(frozen=True)
class Arranged:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: PieceTable


def arrange(texts: C.Texts, hashes: list[str]) -> Iterator[Arranged]:
    """Each document of a chunk, cut and arranged as its hash says."""
    starts, firsts = token_starts(texts)
    points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    buffers = memoryview(np.ascontiguousarray(texts.data)).cast("B") if len(texts.data) else memoryview(b""), memoryview(MARKS)
    for i, sha in enumerate(hashes):
        begin, end = int(texts.offsets[i]), int(texts.offsets[i + 1])
        n = int(firsts[i + 1] - firsts[i])
        h1, h2, h3, h4 = (int(sha[8 * k : 8 * k + 8], 16) for k in range(4))
        whole = PieceTable(buffers, ((TEXT, begin, end - begin),))
        raw = texts.bytes_of(i)
        if not raw or h3 % 100 >= PLAIN_FROM or any(mark in raw for mark in SENTINELS):
            yield Arranged(n, "plain", None, None, whole)
            continue
        places = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (int(starts[firsts[i] + k]) if k < n else end for k in places)
        form = "spm" if h4 % 100 < SPM_BELOW else "psm"
        table = whole.cut(a - begin).cut(b - begin).with_marks().arranged(ARRANGEMENTS[form])
        yield Arranged(n, form, int(points[a] - points[begin]), int(points[b] - points[a]), table)


def seeded_hash(doc_id: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it."""

    def work(batch: pa.RecordBatch) -> dict:
        rows = list(arrange(C.Texts.of(batch.column("text")), batch.column("sha").to_pylist()))
        restored = [read_output(b"".join(r.output.stream()), r.form).digest() for r in rows]
        out = {"doc_id": batch.column("doc_id"), "n": pa.array([r.n for r in rows], pa.int64()), "form": pa.array([r.form for r in rows], pa.string())}
        out |= {name: pa.array([getattr(r, name) for r in rows], pa.int64()) for name in ("prefix_chars", "middle_chars")}
        return out | {"output_sha256": pa.array([r.output.digest() for r in rows], pa.string()), "restored_sha256": pa.array(restored, pa.string())}

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), seeded_hash(F.col("doc_id"), seed).alias("sha"), "text")
    return C.map_texts(own, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string", work)


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, form, output): each row of docs as a struct, and its text arranged (empty for a null text)."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), seeded_hash(F.col("doc_id"), seed).alias("sha"), F.col("text").alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(arrange(C.Texts.of(batch.column("text")), batch.column("sha").to_pylist()))
        texts = pa.array([b"".join(r.output.stream()).decode() for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array([r.form for r in rows], pa.string()), texts], ["row", "form", "output"])

    schema = T.StructType([own.schema["row"], T.StructField("form", T.StringType()), T.StructField("output", T.StringType())])
    return C.map_texts(own, schema, work)


def restore(arranged: DataFrame) -> DataFrame:
    """(row, text): the texts from (row, form, output), by output and form alone."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, forms = C.Texts.of(batch.column("output")), batch.column("form").to_pylist()
        found = [b"".join(read_output(texts.bytes_of(i), form).stream()).decode() for i, form in enumerate(forms)]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], ["row", "text"])

    schema = T.StructType([arranged.schema["row"], T.StructField("text", T.StringType())])
    return C.map_texts(arranged.select("row", "form", "output"), schema, work, text="output")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts FROM documents),
u AS (SELECT *, CAST(len(ts) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
v AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, coalesce(array_to_string(list_slice(ts, 1, a), ''), '') AS prefix, coalesce(array_to_string(list_slice(ts, a + 1, b), ''), '') AS middle, coalesce(array_to_string(list_slice(ts, b + 1, n), ''), '') AS suffix FROM v),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM w),
r AS (SELECT *, CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3) || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
  ELSE substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3) || substr(output, strpos(output, '<M>') + 3) || substr(output, 4, strpos(output, '<P>') - 4) END AS restored FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM r
"""
