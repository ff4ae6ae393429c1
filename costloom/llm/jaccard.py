"""Set-similarity self join on word shingles: a size-aware heavy-light join, exact at any group size.

1. Equal sets. One scan gives each document its set's size and 128-bit fingerprint; equal sets are one
   class, represented by its smallest id.
2. Who can have a partner at all. A set shares ceil(0.75 n) shingles with any partner, so it can spare only
   n - ceil(0.75 n) that no other set has. Shingles are looked at in runs of hash ranges, each run only of
   sets that passed the one before, counting those that are alone; each is a count and a join.
3. Contraction. Sets that agree on a minimum hash are checked against two of them, the most typical and the
   smallest id: pairs in proportion to the sets, whatever the group's size. What links is one component.
4. Heavy-light join of what is left between different components, shingles ordered from rare to common.
   Light sets (size <= boundary) enumerate the 2-subsets of their prefix as keys; heavy sets are found by
   scanning the inverted lists of single prefix shingles. The boundary has the least cost by the counts
   of subsets and the lengths of lists, summed over all sets. Candidates are verified on whole sets.

A pair inside a component that is already known is never formed, so a large group of near copies stays
linear, and every link between components is found, so components are exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import checked_broadcast, cut, drop_listed, sliced, whole_text
from costloom.llm.graphs import components
from costloom.llm.shingles import fingerprint, mixed, shingle_sets

#: Two sets link when 100 x intersection >= 75 x union.
PERCENT = 75
ANCHORS = 4
#: Hash ranges of the runs that find sets without partners, in sixteenths. Random sets fail the first.
RUNS = ((0, 5), (5, 10))
#: What a key costs to emit, shuffle and count, in entries of a list that are looked at.
KEY_COST = 100
_MOST = 1 << 18


def least_shared(n: int) -> int:
    """The fewest shingles that a set of n shares with any partner."""
    return -(-PERCENT * n // 100)


def _long_rows(schema, columns):
    """Record batches of bounded size from lists of numpy columns."""
    whole = [np.concatenate(c) if len(c) else np.zeros(0, np.int64) for c in columns]
    for i in range(0, len(whole[0]), _MOST):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + _MOST]) for c in whole], schema=schema)


def _exploded(docs: DataFrame, low: int = 0, high: int = 16) -> DataFrame:
    """doc_id, shingle: of the sets of at least 3 shingles, the hashes from low to high sixteenths of their range."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingle", pa.int64())])
    first, last = np.uint64(low << 60), np.uint64((high << 60) - 1)

    def run(batches):
        columns: list[list] = [[], []]
        held = 0
        for batch in sliced(batches):
            ids = batch["doc_id"].to_numpy()
            for i, values in shingle_sets(batch["text"].to_pylist()):
                if len(values) < 3:  # such sets link with equal ones only
                    continue
                values = values[np.searchsorted(values, first) : np.searchsorted(values, last, side="right")]
                columns[0].append(np.full(len(values), ids[i]))
                columns[1].append(values.view(np.int64))
                held += len(values)
                if held >= _MOST:
                    yield from _long_rows(schema, columns)
                    columns, held = [[], []], 0
        if held:
            yield from _long_rows(schema, columns)

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, shingle long")


def set_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary())])

    def run(batches):
        for batch in sliced(batches):
            sizes, marks = [], []
            for _, values in shingle_sets(batch["text"].to_pylist()):
                sizes.append(len(values))
                marks.append(fingerprint(values))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary")


def linkable_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n, shingles, counts: sets that may have a partner, with their shared shingles from rare to common."""
    spare = F.col("n") - F.ceil(F.col("n") * PERCENT / 100)
    near, alone, asked = classes.select("doc_id", F.col("n_shingles").alias("n")), F.lit(0), docs
    for low, high in RUNS:
        rows = _exploded(asked, low, high)
        twice = rows.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1")
        # A hash lies in the same run for every set, so what no other set has here, none has at all.
        found = rows.join(twice, "shingle", "left").groupBy("doc_id").agg(F.count_if(F.col("c").isNull()).alias("more"))
        near = near.join(found, "doc_id", "left").select("doc_id", "n", (alone + F.coalesce("more", F.lit(0))).alias("alone"))
        near = cut(near.filter(F.col("alone") <= spare))
        alone = F.col("alone")
        asked = docs.join(checked_broadcast(near.select("doc_id"), 16), "doc_id", "left_semi").select("doc_id", "text")
    whole = _exploded(asked)
    counts = whole.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1")
    kept = whole.join(counts, "shingle").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("c", "shingle"))).alias("e"))
    enough = F.size("e") >= F.ceil(F.col("n") * PERCENT / 100)
    return cut(kept.join(near, "doc_id").filter(enough).select("doc_id", F.col("n").cast("int").alias("n"), F.col("e.shingle").alias("shingles"), F.col("e.c").alias("counts")))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, shared, n_a, n_b: the pairs whose sets link, with their overlap. Shingles outside the shared ones can't be in both."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("shared"), "n_a", "n_b")
    return met.filter(100 * F.col("shared") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("shared")))


def anchored(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set and two of those with one of its minimum hashes: the most typical and the first.

    A set is typical of a group if its shingles are in many sets on average: the text that near copies
    derive from, or the passage without additions. Both are found before rows meet.
    """
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("typical", pa.float64())])

    def run(batches):
        for batch in sliced(batches):
            keys, ids, ranks = [], [], []
            for i, n, values, counts in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["shingles"], batch["counts"], strict=True):
                v = np.asarray(values.values).view(np.uint64)
                rank = float(np.asarray(counts.values).sum() + n - len(v)) / n
                for k in range(ANCHORS):
                    salt = np.uint64(0x1000193 * (k + 1))
                    keys.append(int(mixed(np.array([mixed(v ^ salt).min() + salt]))[0].view(np.int64)))
                    ids.append(i)
                    ranks.append(rank)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(ranks, pa.float64())], schema=schema)

    keys = cut(sets.select("doc_id", "n", "shingles", "counts").mapInArrow(run, "key long, doc_id long, typical double"))
    pivots = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max(F.struct("typical", (-F.col("doc_id")).alias("id"))).alias("top"), F.count("*").alias("c")).filter("c > 1")
    pivots = pivots.select("key", F.array_distinct(F.array("first", -F.col("top.id"))).alias("b"))
    return keys.join(pivots, "key").select(F.col("doc_id").alias("a"), F.explode("b").alias("b")).filter("a <> b").distinct()


def boundary(sets: DataFrame) -> int:
    """The largest size of light sets, of least total cost; sums over all sets by size, some hundred rows.

    A set pays the subsets it enumerates if it or a smaller partner is light, and if heavy its keys and the
    lists it scans.
    """
    prefix = F.greatest(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.size("counts")), F.lit(0)).cast("double")
    by = sets.select(
        F.when(F.col("n") <= 64, F.col("n")).otherwise(F.ceil(F.pow(F.lit(2.0), F.ceil(F.log2("n") * 4) / 4))).cast("long").alias("size"),
        (KEY_COST * (prefix + 1) * prefix / 2).alias("subsets"),
        (KEY_COST * prefix + F.aggregate(F.slice("counts", 1, prefix.cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)).alias("lists"),
    )
    rows = sorted(by.groupBy("size").agg(F.sum("subsets"), F.sum("lists")).collect())
    best, at = None, 0
    for light in [0, *(r[0] for r in rows)]:
        cost = sum(r[1] for r in rows if r[0] <= math.ceil(light * 100 / PERCENT)) + sum(r[2] for r in rows if r[0] > light)
        if best is None or cost < best:
            best, at = cost, light
    return at


def candidates(sets: DataFrame, light: int) -> DataFrame:
    """Pairs (a, b) of sets with different labels that a 2-subset key or an inverted list brings together.

    A true pair passes the position test at its first common key: what follows both places in the order
    bounds the overlap. A set of n with s shared shingles has partners of at most 7 s / 3 - n (its cap);
    a key's entries that no size and cap among its others allow are dropped before rows meet.
    """
    most = math.ceil(light * 100 / PERCENT)
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("left", pa.int32()), ("cap", pa.int32()), ("label", pa.int64())])

    def run(batches):
        for batch in sliced(batches):
            columns: list[list] = [[] for _ in schema]
            held = 0

            def add(keys, left, i, n, cap, label):
                for c, x in zip(columns, (keys.view(np.int64), np.full(len(keys), i), np.full(len(keys), n, np.int32), left.astype(np.int32), np.full(len(keys), cap, np.int32), np.full(len(keys), label)), strict=True):
                    c.append(x)

            for i, n, label, values in zip(batch["doc_id"].to_pylist(), batch["n"].to_pylist(), batch["label"].to_pylist(), batch["shingles"], strict=True):
                v = np.asarray(values.values).view(np.uint64)
                prefix = n - least_shared(n) + 1 - (n - len(v))  # shingles in one set only come first
                cap = (100 + PERCENT) * len(v) // PERCENT - n
                if n > light:
                    add(mixed(v[:prefix]), len(v) - np.arange(prefix), i, n, cap, label)
                    held += prefix
                if n <= most:
                    x, y = np.triu_indices(min(prefix + 1, len(v)), 1)
                    add(mixed(mixed(v[x]) + v[y]), len(v) - x, i, n, cap, label)
                    held += len(x)
                if held >= _MOST:
                    yield from _long_rows(schema, columns)
                    columns, held = [[] for _ in schema], 0
            if held:
                yield from _long_rows(schema, columns)

    keys = cut(sets.select("doc_id", "n", "label", "shingles").mapInArrow(run, "key long, doc_id long, n int, left int, cap int, label long"))
    # By key and label first: a key of one label ends here. Of a key with several, the rows outside its largest
    # label meet all its rows; those of the largest, however many, don't meet each other.
    by = keys.groupBy("key", "label").agg(F.count("*").alias("c"), F.min("n").alias("least"), F.max("cap").alias("most"))
    several = by.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("top"), F.min("least").alias("least"), F.max("most").alias("most")).filter("labels > 1").select("key", "top", "least", "most")
    left = cut(keys.join(several, "key").filter("least <= cap AND n <= most").drop("least", "most"))
    right = left.select("key", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "left", "cap", "label")])
    union = 100 + PERCENT
    need = F.ceil(F.lit(PERCENT) * (F.col("n") + F.col("n_b")) / F.lit(union))
    once = (F.col("label_b") == F.col("top")) | (F.col("doc_id") < F.col("doc_id_b"))
    ok = once & (F.col("label") != F.col("label_b")) & (F.least("left", "left_b") >= need) & (F.col("n") <= F.col("cap_b")) & (F.col("n_b") <= F.col("cap"))
    met = left.filter("label <> top").join(right, "key").filter(ok)
    return met.select(F.least("doc_id", "doc_id_b").alias("a"), F.greatest("doc_id", "doc_id_b").alias("b")).distinct()


def set_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_hash of every document; the classes of equal sets: their hash, least doc_id, copies)."""
    rows = cut(set_sizes(docs))
    return rows, cut(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "set_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))


def jaccard_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every link of two different sets, and which documents have which set.

    pairs: a < b (the least doc_id of each set), shared, n_a, n_b (the overlap and the sizes). members: doc_id,
    n_shingles, class_id (that least doc_id; null without shingles or id). Two documents link where they
    have one class_id or their classes are a pair. No pair is left out, so a group of n near copies with
    different sets gives up to n * n / 2 rows; jaccard_components gives one row a document instead.
    Odd rows are as there.
    """
    rows, classes = set_classes(docs)
    sets = linkable_sets(docs, classes).withColumn("label", F.col("doc_id"))
    pairs = verified(candidates(sets, boundary(sets)), sets)
    members = rows.join(classes.select("n_shingles", "set_hash", F.col("doc_id").alias("class_id")), ["n_shingles", "set_hash"], "left")
    return pairs, members.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set has the distinct five-word shingles of its lower-cased (A-Z) whole text; with fewer
    words the whole sequence is its one shingle; null, empty and blank texts have none and link with
    nothing. Documents link when 100 x intersection >= 75 x union; component_id is the smallest doc_id that
    links reach. Repeated rows are copies of each other. A row without doc_id has a size, no component
    and links nothing; one doc_id names one text. Extra columns are ignored; no rows give no rows.
    """
    rows, classes = set_classes(docs)
    sets = linkable_sets(docs, classes)
    links = verified(anchored(sets), sets)
    close = cut(components(links))
    labelled = cut(sets.join(close.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    across = verified(candidates(labelled, boundary(sets)), sets)
    of = labelled.select("doc_id", "label")
    bridges = across.join(of.select(F.col("doc_id").alias("a"), F.col("label").alias("x")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("label").alias("y")), "b")
    far = components(bridges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    final = of.join(far.select(F.col("id").alias("label"), F.col("label").alias("least")), "label", "left").select("doc_id", F.coalesce("least", "label").alias("component_id"))
    # Only classes with copies or a smaller component need a look-up; all others are their own.
    named = classes.join(final, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    named = cut(named.filter("copies > 1 OR component_id <> doc_id").select("n_shingles", "set_hash", "component_id"))
    out = rows.join(checked_broadcast(named, 64), ["n_shingles", "set_hash"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the smallest id, with all columns as they were.

    Rows without doc_id, and texts without words, link with nothing and stay; repeated rows of an id that stays all
    stay (exact dedup comes before); no rows give no rows.
    """
    found = jaccard_components(docs)
    gone = cut(found.filter("component_id <> doc_id").select("doc_id").distinct())
    return drop_listed(docs, gone, {"doc_id": F.col("doc_id")}, 24)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a) SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id)
"""


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
