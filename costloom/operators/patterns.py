"""Many patterns in many texts: one pass of an Aho-Corasick automaton a text, however many patterns there are.

The automaton is built once from the patterns and sent to the workers; sets of more than BLOCK patterns are dealt
into blocks of about that size, each with its own automaton and pass, so memory is bounded and all texts meet
all patterns without a join on containment.
"""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.sources.store import cut

BLOCK = 200_000


def automaton(patterns):
    """An automaton over the non-empty patterns, by their places in the list."""
    found = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        if p:
            found.add_word(p, i)
    if len(found):
        found.make_automaton()
    return found


def _held(sent):
    """The patterns that each text of a batch holds, by the automaton that was sent."""

    @F.pandas_udf("array<struct<pattern:string,n:long>>")
    def held(s: pd.Series) -> pd.Series:
        words, known = sent.value

        def of(t):
            counts: dict[int, int] = {}
            if t and len(known):
                for _, i in known.iter(t):
                    counts[i] = counts.get(i, 0) + 1
            return [{"pattern": words[i], "n": n} for i, n in counts.items()]

        return s.map(of)

    return held


def occurrences(texts: DataFrame, patterns: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of texts with pattern and n: every pattern (pattern string) that a text holds, and how often, overlaps included.

    Case counts; empty and null patterns are in no text, null texts hold nothing; a pattern that is listed twice counts
    once. Rows that hold nothing are left out.
    """
    spark = texts.sparkSession
    listed = cut(patterns.select("pattern").filter("pattern <> ''").distinct())
    blocks, out = max(1, -(-listed.count() // block)), None
    for k in range(blocks):
        part = listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k)
        words = sorted(r["pattern"] for r in part.toLocalIterator())
        sent = spark.sparkContext.broadcast((words, automaton(words)))
        rows = texts.withColumn("found_", _held(sent)(F.col(text))).select(*texts.columns, F.explode("found_").alias("x_"))
        rows = rows.select(*texts.columns, "x_.pattern", "x_.n")
        out = rows if out is None else out.unionByName(rows)
    return out


def leftmost_longest(texts: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """The rows of texts with pattern, start, end of matches that don't overlap: leftmost first, of those the longest.

    Patterns are a dictionary of bounded size here (BLOCK), as matches of different blocks could overlap; more are refused.
    """
    listed = patterns.select("pattern").filter("pattern <> ''").distinct()
    words = sorted(r["pattern"] for r in listed.limit(BLOCK + 1).collect())
    if len(words) > BLOCK:
        raise ValueError(f"leftmost_longest takes at most {BLOCK} patterns")
    sent = texts.sparkSession.sparkContext.broadcast((words, automaton(words)))

    @F.pandas_udf("array<struct<pattern:string,start:int,end:int>>")
    def held(s: pd.Series) -> pd.Series:
        words, known = sent.value

        def of(t):
            if not t or not len(known):
                return []
            return [{"pattern": words[i], "start": e + 1 - len(words[i]), "end": e + 1} for e, i in known.iter_long(t)]

        return s.map(of)

    rows = texts.withColumn("found_", held(F.col(text))).select(*texts.columns, F.explode("found_").alias("x_"))
    return rows.select(*texts.columns, "x_.pattern", "x_.start", "x_.end")
