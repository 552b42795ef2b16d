"""Repetition coverage: how many characters of a text stand inside n-grams and lines that it holds more than once.

Words are hashed as byte spans, n-grams as polynomials of their words' hashes, both in numpy over a chunk of documents;
n-grams of one document that share a hash are the same (64 bits). A character is covered if any of its word's n-grams
occurs twice or more in the text, the first included.

Nulls: a null text has no words and fails the base rule. A text below n words has no n-gram. Repeated rows give
repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import common as C

#: Largest share of a text's word characters inside repeated n-grams, by n (published limits for web text).
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of the non-empty lines, and of their characters, that repeat an earlier line.
LINES, LINE_CHARS = 0.30, 0.20
BASE_N = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    + ", ".join(f"cover_{n} double" for n in COVERAGE)
    + ", dup_line_share double, dup_line_chars double"
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.concatenate([[True], twice[1:] != twice[:-1]])]
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def covered(mask: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside any marked n-gram."""
    steps = np.zeros(total + 1, np.int32)
    at = np.flatnonzero(mask)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: C.Texts) -> dict[str, np.ndarray]:
    starts, ends, firsts = C.words(texts)
    word, doc_of = C.span_hashes(texts.data, starts, ends), np.repeat(np.arange(texts.n), np.diff(firsts))
    points = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[texts.data])])
    salt = C.mixed(np.arange(1, texts.n + 1, dtype=np.uint64))
    out = {"n_words": np.diff(firsts), "word_chars": C.sums(chars, firsts), "n_symbols": symbols[texts.offsets[1:]] - symbols[texts.offsets[:-1]]}
    share = lambda part, whole: part / np.maximum(whole, 1)
    for n in sorted({*COVERAGE, BASE_N}):
        gram, inside = C.shingles(word, firsts, n)
        inside_at = np.flatnonzero(inside)
        mask = np.zeros(len(gram), bool)
        mask[inside_at] = repeated(gram[inside_at] ^ salt[doc_of[inside_at]])
        words_in = covered(mask, n, len(word))
        if n == BASE_N:
            out["n_repeat_words"] = C.sums(words_in, firsts)
        if n in COVERAGE:
            out[f"cover_{n}"] = share(C.sums(chars * words_in, firsts), out["word_chars"])
    begin, end, line_firsts = C.lines(texts)
    before = np.concatenate([[0], np.cumsum(~C.SPACE[texts.data])])
    solid = before[end] > before[begin]
    own = np.repeat(np.arange(texts.n), np.diff(line_firsts))
    key = C.span_hashes(texts.data, begin, end) ^ salt[own]
    at = np.flatnonzero(solid)
    later = np.zeros(len(key), bool)
    order = at[np.argsort(key[at], kind="stable")]
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    width = points[end] - points[begin]
    out["n_dup_lines"] = C.sums(later, line_firsts)
    out["dup_line_share"] = share(out["n_dup_lines"], C.sums(solid, line_firsts))
    out["dup_line_chars"] = share(C.sums(width * later, line_firsts), C.sums(width * solid, line_firsts))
    return out


def verdict(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    good = (m["dup_line_share"] <= LINES) & (m["dup_line_chars"] <= LINE_CHARS)
    for n, most in COVERAGE.items():
        good &= m[f"cover_{n}"] <= most
    return m | {"base_failed": failed, "kept": ~failed & good}


def repetition(docs: DataFrame) -> DataFrame:
    """Measures and verdict for every text of docs(doc_id, text)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")[1:]]

    def work(batch: pa.RecordBatch) -> dict:
        found = verdict(measure(C.Texts.of(batch.column("text"))))
        return {"doc_id": batch.column("doc_id")} | {k: pa.array(found[k]) for k in names}

    return C.map_texts(docs.select("doc_id", "text"), SCHEMA, work)
