"""Filter interaction audit: what each filter removes in every order of the filters, by a product of matrices.

One scan turns a text into a mask of the filters that it fails and a digest, after which only narrow rows move. A
part (source) is a histogram over the 32 masks, of all its documents, of its good ones and of its toxic ones. With
these as rows, products with four integer matrices of 32 masks by 600 columns (120 orders x 5 steps) give every
outcome of every order at once; no document is looked at again, and no order is run.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import WORD, checked_broadcast, cut, sliced, whole_text

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def incidence() -> dict[str, np.ndarray]:
    """kept, removed, redundant, unique: for each mask and (order, step) 1 where a document of that mask has the outcome there."""
    mask = np.arange(MASKS)[:, None]
    bits = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    before = np.cumsum(bits, axis=1) - bits
    own, before = bits.ravel()[None, :], before.ravel()[None, :]
    fails, gone = (mask & own) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": np.broadcast_to(mask == own, fails.shape)}
    return {k: v.astype(np.int64) for k, v in found.items()}


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of the filters that look at one text: A to D), sha (digest of the text)."""
    text = whole_text()
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    counts = words.select("doc_id", "part", "text", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("d"))
    fails = [
        F.col("n") < 50,
        100 * F.col("d") < 65 * F.col("n"),
        100 * (F.length("text") - F.length(F.translate("text", CAPITALS, ""))).cast("long") > 5 * F.length("text").cast("long"),
        F.col("text").rlike(r"[#$%&*|]"),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return counts.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, counts: for each mask struct<n, good, toxic>, in an array over the 32 masks."""
    rows = cut(masks(docs))
    least = cut(rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).filter("c > 1").select("sha", "least"))
    repeat = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    full = rows.join(checked_broadcast(least, 56), "sha", "left").select("doc_id", "part", (F.col("mask") + F.when(repeat, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    cells = full.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    by = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("by"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "good", "toxic")])
    return by.select("part", F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.try_element_at("by", m), none)).alias("counts"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    A filter's letter names what fails it: A under 50 words, B under 65 % distinct words, C over 5 % capitals A-Z,
    D one of #$%&*|, E a text that is that of a smaller doc_id, in any part, removed or not (by SHA-256). Null texts are
    empty, null sources part of ""; a row without id repeats nothing and no row repeats it; rows of the
    smallest id of a text all pass E. A document is good or toxic if any row of labels says so; a null there says
    nothing. No documents give no rows; extra columns are ignored.
    """
    matrices = incidence()
    names = pa.array(ORDERS).take(pa.array(np.repeat(np.arange(len(ORDERS)), STEPS)))
    letter = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in _COUNTS]])
    width = len(letter)

    def run(batches):
        for batch in sliced(batches, 64):
            parts = batch.num_rows
            cell = batch["counts"].flatten()
            rows = np.stack([np.asarray(cell.field(c)).reshape(parts, MASKS) for c in ("n", "good", "toxic")])
            every, good, toxic = rows
            removed = every @ matrices["removed"]
            share = np.stack([removed[:, letter == k].sum(axis=1) for k in range(STEPS)], axis=1)
            values = (every @ matrices["kept"], removed, every @ matrices["redundant"], every @ matrices["unique"], good @ matrices["removed"], toxic @ matrices["removed"], share[:, letter])
            part = batch["part"].take(pa.array(np.repeat(np.arange(parts), width)))
            orders = pa.concat_arrays([names] * parts) if parts else names.slice(0, 0)
            steps = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), parts * len(ORDERS)))
            yield pa.RecordBatch.from_arrays([part, orders, steps, *[pa.array(v.ravel()) for v in values]], schema=schema)

    return histograms(docs, labels).mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
             regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || d.c || e.c || h.c AS filter_order FROM x a, x b, x d, x e, x h WHERE len(list_distinct([a.c, b.c, d.c, e.c, h.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[strpos('ABCDE', letter)] AS own, len(list_filter(fails, lambda b: b)) AS many,
             len(list_filter(string_split(filter_order[1:step - 1], ''), lambda c: c <> '' AND fails[strpos('ABCDE', c)])) > 0 AS gone FROM g, s),
y AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN own AND many = 1 THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y
"""


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interactions(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
