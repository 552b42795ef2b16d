"""Which texts hold which words: words go to the tasks in blocks of bounded size, and each text is walked once a block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from loomgraph.operators.retrieval import blocks
from loomgraph.plans.session import written

#: Characters of the words of a block.
CHARACTERS = 4_000_000


def _walked(words: DataFrame, texts: DataFrame, work: Callable, schema: StructType) -> DataFrame:
    """What work (of an automaton of a block's words) makes of the texts, for all blocks."""
    asked = written(words.select(F.col("word").cast("string").alias("word")).where("word <> ''").distinct())
    size, found = asked.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0], None
    for part in blocks(asked, "word", size, CHARACTERS):
        block = [r["word"] for r in part.collect()]
        if block:
            held = texts.mapInPandas(_with(block, work), schema)
            found = held if found is None else found.unionAll(held)
    return texts.sparkSession.createDataFrame([], schema) if found is None else found.distinct()


def _with(wanted: list[str], work: Callable):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for word in wanted:
            finder.add_word(word, word)
        finder.make_automaton()
        yield from work(finder, batches)

    return run


def _pairs(finder, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words, rows = [], []
        for i, text in enumerate(batch["text"]):
            held = {word for _, word in finder.iter(text)}
            words += held
            rows += [i] * len(held)
        yield pd.DataFrame({"word": pd.Series(words, dtype="object"), "uid": batch["uid"].iloc[rows].to_numpy()})


def _words(finder, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = set()
    for batch in batches:
        for text in batch["text"]:
            found.update(word for _, word in finder.iter(text))
    yield pd.DataFrame({"word": pd.Series(sorted(found), dtype="object")})


def contained(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, uid): the texts (uid, text) in which each of the words (word) stands, each pair once.

    Case counts; lower both sides where it should not. Null texts hold nothing, null and empty words stand nowhere; a uid of several
    texts counts if one of them has the word.
    """
    plain = texts.select("uid", "text").where("text IS NOT NULL")
    return _walked(words, plain, _pairs, StructType().add("word", StringType()).add(plain.schema["uid"]))


def standing(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word): the words (word) that stand in some text (text), as in `contained`; each task hands on each word once."""
    return _walked(words, texts.select("text").where("text IS NOT NULL"), _words, StructType().add("word", StringType()))
