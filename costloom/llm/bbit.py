"""Near-duplicate components by b-bit MinHash: bands find candidates, packed low bits estimate, full sets confirm.

1. One scan gives each document its set's size, 128-bit fingerprint, the low BITS bits of HASHES minima packed as bit
   planes (a plane has one bit of every minimum, so eight longs in all) and a key for each of BANDS bands of
   whole minima. Equal sets are one class from here on, whatever their number.
2. Stars: in each band bucket, every set is a candidate with the smallest id and with the most typical set only: pairs
   in proportion to the sets. What links is one component.
3. Between components: in buckets that still hold several, the sets outside a bucket's largest component meet all
   others of another component and of a size that allows a link, if each holds enough shingles that other
   components have as well. First the most alike pair of two components is confirmed, then, where that doesn't
   link them, all the rest.
4. Estimate: minima agree where all planes do: HASHES less the bits set in the OR of the planes' XOR. Of b bits a share
   2^-b agrees by chance, so s = (agreeing / HASHES - 2^-b) / (1 - 2^-b). Pairs six standard deviations
   below the least similarity go no further; the rest is counted on full sets, so every link is real.

A link at the least similarity, 0.8, is missed by all bands with probability (1 - 0.8^4)^32 = 5e-8 and by the estimate
with less than 1e-8; more similar ones by far less. A component loses nothing unless all paths are lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import checked_broadcast, cut, sliced, whole_text
from costloom.llm.graphs import components
from costloom.llm.shingles import fingerprint, mixed, shingle_sets

#: Two sets link when 100 x intersection >= 80 x union; shingles have four words.
PERCENT, WORDS = 80, 4
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
#: Smaller sets link with equal ones only.
LEAST_SET = 4
PLANES = [f"p{k}" for k in range(BITS * HASHES // 64)]
_CHUNK = 1 << 16
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), *[(p, pa.int64()) for p in PLANES], ("bands", pa.list_(pa.int64()))])
_SPARK = "doc_id long, n_shingles long, set_hash binary, " + ", ".join(f"{p} long" for p in PLANES) + ", bands array<long>"

def _small(table: DataFrame, width: int) -> DataFrame:
    """A broadcast of a written table of at most 8 MB by rows x width; there are many of them at once here."""
    return checked_broadcast(table, width, 8 << 20)


_keys = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _keys[:HASHES].astype(np.uint32) | np.uint32(1), _keys[HASHES:].astype(np.uint32)


def least_agreeing(deviations: float = 6.0) -> int:
    """The fewest agreeing minima that a candidate may have."""
    p = PERCENT / 100 + (1 - PERCENT / 100) / 2**BITS
    return math.floor(HASHES * p - deviations * math.sqrt(HASHES * p * (1 - p)))


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """uint32[sets, HASHES]: the minimum of each hash over each set; sets are consecutive runs of values."""
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    out, h, t = np.empty((HASHES, len(starts)), np.uint32), np.empty_like(low), np.empty_like(low)
    for k in range(HASHES):
        np.multiply(low, _TIMES[k], out=h)
        np.multiply(high, _PLUS[k], out=t)
        h += t
        out[k] = np.minimum.reduceat(h, starts)
    return out.T


def packed(lowest: np.ndarray) -> np.ndarray:
    """int64[sets, planes]: BITS mixed low bits of each minimum, a plane of 64 minima after the other."""
    low = mixed(lowest.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    bits = np.stack([(low >> np.uint64(b)) & np.uint64(1) for b in range(BITS)], axis=1).astype(np.uint8)
    return np.packbits(bits.reshape(len(low), -1), axis=1, bitorder="little").view(np.int64)


def band_keys(lowest: np.ndarray) -> np.ndarray:
    """int64[sets, BANDS]: a hash of each band's number and whole minima."""
    x = lowest.astype(np.uint64).reshape(len(lowest), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2])
    for k in range(ROWS):
        key = mixed(key + x[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash, planes and bands of every document; sets under LEAST_SET have no bands and empty planes."""

    def run(batches):
        for batch in sliced(batches):
            ids, sizes, marks, planes, bands = batch["doc_id"].to_pylist(), [], [], [], []
            held: list[np.ndarray] = []

            def flush():
                full = [v for v in held if len(v) >= LEAST_SET]
                if full:
                    lowest = minima(np.concatenate(full), np.concatenate([[0], np.cumsum([len(v) for v in full])[:-1]]))
                    signs, keys = iter(packed(lowest)), iter(band_keys(lowest))
                for v in held:
                    planes.append(next(signs) if len(v) >= LEAST_SET else np.zeros(len(PLANES), np.int64))
                    bands.append(next(keys) if len(v) >= LEAST_SET else np.zeros(0, np.int64))
                held.clear()

            size = 0
            for _, values in shingle_sets(batch["text"].to_pylist(), WORDS):
                sizes.append(len(values))
                marks.append(fingerprint(values))
                held.append(values)
                size += len(values)
                if size >= _CHUNK:
                    flush()
                    size = 0
            flush()
            signs = np.stack(planes) if planes else np.zeros((0, len(PLANES)), np.int64)
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), *[pa.array(np.ascontiguousarray(signs[:, k])) for k in range(len(PLANES))], keys], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, _SPARK)


def agreeing(a: str, b: str) -> Column:
    """How many minima's low bits agree between the planes with prefix a and those with prefix b."""
    words = HASHES // 64
    differ = [None] * words
    for k, p in enumerate(PLANES):
        x = F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))
        differ[k % words] = x if differ[k % words] is None else differ[k % words].bitwiseOR(x)
    out = F.lit(HASHES)
    for x in differ:
        out = out - F.bit_count(x)
    return out


def similarity(agree: Column) -> Column:
    """The estimate of the Jaccard similarity, with what agrees by chance taken off."""
    chance = 2.0**-BITS
    return (agree / HASHES - chance) / (1 - chance)


def _sized(small: Column, large: Column) -> Column:
    return 100 * F.least(small, large) >= PERCENT * F.greatest(small, large)


def estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs whose sizes and packed minima allow a link."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), *[F.col(p).alias(f"{x}_{p}") for p in PLANES])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.filter(_sized(F.col("n_a"), F.col("n_b")) & (agreeing("a_", "b_") >= least_agreeing())).select("a", "b")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, shingles: whole sets of the documents that ids (a written table) lists."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in sliced(batches, 64):
            owners = batch["doc_id"].to_pylist()
            for i, values in shingle_sets(batch["text"].to_pylist(), WORDS):
                yield pa.RecordBatch.from_arrays([pa.array([owners[i]]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.view(np.int64)))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.join(_small(ids, 16), "doc_id", "left_semi").mapInArrow(run, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs that link by their full sets (doc_id, shingles)."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s_{x}"))
    both, sizes = F.size(F.array_intersect("s_a", "s_b")).cast("long"), (F.size("s_a") + F.size("s_b")).cast("long")
    right = side("b").withColumnRenamed("b", "other")
    # In the join's condition, so that pairs that don't link aren't rows after it.
    return pairs.join(side("a"), "a").join(right, (F.col("b") == F.col("other")) & ((100 + PERCENT) * both >= PERCENT * sizes)).select("a", "b")


def ends(pairs: DataFrame) -> DataFrame:
    """doc_id: the documents of pairs (a, b), a written table."""
    return cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())


def stars(sets: DataFrame) -> DataFrame:
    """Pairs (a, b): each set and two sets of each of its band buckets, the most typical one and the smallest id.

    A set is typical if many share buckets with it: the text that near copies derive from meets more of them than they
    meet each other. Sums are taken before rows meet, so a bucket gives two pairs a set whatever its size.
    """
    keys = cut(sets.select("doc_id", F.explode("bands").alias("key")))
    counts = cut(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    shared = keys.join(_small(counts, 16), "key")
    rank = cut(shared.groupBy("doc_id").agg(F.sum("c").alias("rank")))
    ranked = shared.select("key", "doc_id").join(_small(rank, 16), "doc_id")
    centres = ranked.groupBy("key").agg(F.min("doc_id").alias("first"), F.max(F.struct("rank", (-F.col("doc_id")).alias("id"))).alias("top"))
    centres = centres.select("key", F.array_distinct(F.array("first", -F.col("top.id"))).alias("b"))
    return shared.select("key", F.col("doc_id").alias("a")).join(centres, "key").select("a", F.explode("b").alias("b")).filter("a <> b").distinct()


def contested(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, top: band buckets that hold several components, and their largest one; doc_id: the sets in them). sets has label."""
    keys = sets.select("doc_id", "label", F.explode("bands").alias("key"))
    by = keys.groupBy("key", "label").agg(F.count("*").alias("c"))
    several = cut(by.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("top")).filter("labels > 1").select("key", "top"))
    return several, cut(keys.join(_small(several, 24), "key").select("doc_id").distinct())


def shared_counts(full: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, s: how many shingles of each full set are in a set of another component too; without any there is no row.

    A link to another component rests on these alone. A shingle is reduced to its least and greatest component
    before rows move, so one that half of all texts hold is no burden.
    """
    rows = full.join(_small(labels, 24), "doc_id").select("doc_id", "label", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("shingle")
    return rows.join(_small(cut(shared), 12), "shingle", "left_semi").groupBy("doc_id").agg(F.count("*").alias("s"))


def held_by_top(sets: DataFrame, several: DataFrame, full: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, top, t: how many shingles of a set the sets of a contested bucket's largest component hold together.

    For each set outside that component; no link into it can rest on more. sets has label.
    """
    outside = sets.select("doc_id", "label", F.explode("bands").alias("key")).join(_small(several, 24), "key").filter("label <> top").select("doc_id", "top").distinct()
    asked = full.join(cut(outside), "doc_id").select("doc_id", "top", F.explode("shingles").alias("shingle"))
    tops = _small(cut(several.select("top").distinct()), 12)
    together = full.join(_small(labels, 24), "doc_id").join(tops, F.col("label") == F.col("top")).select("top", F.explode("shingles").alias("shingle")).distinct()
    return asked.join(together, ["top", "shingle"]).groupBy("doc_id", "top").agg(F.count("*").alias("t"))


def between(sets: DataFrame, several: DataFrame, shared: DataFrame, held: DataFrame) -> DataFrame:
    """a, b, label_a, label_b, agree: pairs of sets of different components (label) that share a contested bucket and may link.

    A bucket's rows are met by size class, a factor of 100 / PERCENT wide: partners are in one class or neighbours. Those
    of the bucket's largest component don't meet each other. Two sets that link share at least PERCENT / (100 + PERCENT)
    of their sizes' sum, so each must hold as many shingles that other components have (shared), and to link
    into the largest component as many that it has (held).
    """
    few, sum_ = PERCENT, 100 + PERCENT
    able = sets.join(shared, "doc_id").filter(100 * F.col("s") >= PERCENT * F.col("n"))
    band = F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int")
    names = ("doc_id", "label", "n", "s", "bands", *PLANES)
    keys = able.select(*names, band.alias("band"), F.explode("bands").alias("key"))
    rows = keys.join(_small(several, 24), "key")
    left = rows.filter("label <> top").join(_small(held, 32), ["doc_id", "top"], "left").select("key", "band", F.coalesce("t", F.lit(0)).alias("t"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).select("key", "band", (F.col("label") == F.col("top")).alias("of_top"), *[F.col(c).alias(f"b_{c}") for c in names])
    agree = agreeing("a_", "b_")
    enough = lambda x: sum_ * x >= few * (F.col("a_n") + F.col("b_n"))
    one_way = F.when(F.col("of_top"), enough(F.col("t"))).otherwise(F.col("a_doc_id") < F.col("b_doc_id"))
    ok = (F.col("a_label") != F.col("b_label")) & one_way & _sized(F.col("a_n"), F.col("b_n")) & enough(F.least("a_s", "b_s")) & (agree >= least_agreeing())
    # A pair that shares several buckets is formed in the first of them only.
    ok = ok & (F.array_min(F.array_intersect("a_bands", "b_bands")) == left["key"])
    met = left.join(right, (left["key"] == right["key"]) & (left["band"] == right["band"]) & ok)
    turned = F.col("a_doc_id") > F.col("b_doc_id")
    side = lambda c, x, y: F.when(turned, F.col(f"{y}_{c}")).otherwise(F.col(f"{x}_{c}"))
    return met.select(side("doc_id", "a", "b").alias("a"), side("doc_id", "b", "a").alias("b"), side("label", "a", "b").alias("label_a"), side("label", "b", "a").alias("label_b"), agree.alias("agree")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, label: labels after links between documents are added."""
    met = links.join(labels.select(F.col("doc_id").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("doc_id").alias("b"), F.col("label").alias("y")), "b")
    found = cut(components(met.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    return labels.join(_small(found, 24).select(F.col("id").alias("label"), F.col("label").alias("least")), "label", "left").select("doc_id", F.coalesce("least", "label").alias("label"))


def near_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set has the distinct four-word shingles of its lower-cased (A-Z) whole text; with fewer words the
    whole sequence is its one shingle; null, empty and blank texts have none and link with nothing. Documents
    link when 100 x intersection >= 80 x union; component_id is the smallest doc_id that links reach, kept says that it is
    the document's own. Repeated rows are copies of each other; rows of one id with different texts are one
    node, which links what any of them links. A row without doc_id has a size, no component, isn't
    kept and links nothing. Extra columns are ignored; no rows give no rows.
    """
    rows = cut(sketches(docs))
    known = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("n_shingles", "set_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in (*PLANES, "bands")]))
    sets = classes.filter(f"n_shingles >= {LEAST_SET}").select("doc_id", F.col("n_shingles").alias("n"), *PLANES, "bands")
    near = cut(estimated(stars(sets), sets).distinct())
    close = cut(components(confirmed(near, cut(full_sets(docs, ends(near))))))
    labels = cut(sets.select("doc_id").distinct().join(close.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("label")))
    labelled = sets.join(labels, "doc_id")
    several, ids = contested(labelled)
    full = cut(full_sets(docs, ids))
    across = cut(between(labelled, several, shared_counts(full, labels), cut(held_by_top(labelled, several, full, labels))))
    if not across.isEmpty():
        first = F.min_by(F.struct("a", "b"), F.struct(-F.col("agree"), "a", "b")).alias("p")
        best = across.groupBy(F.least("label_a", "label_b"), F.greatest("label_a", "label_b")).agg(first).select("p.a", "p.b")
        found = cut(confirmed(cut(best), full))
        told = across.join(found, ["a", "b"], "left_semi").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        joined = cut(components(told))  # components that the most alike pair links
        x, y = [_small(joined, 24).select(F.col("id").alias(f"label_{c}"), F.col("label").alias(f"to_{c}")) for c in ("a", "b")]
        now = lambda c: F.coalesce(f"to_{c}", f"label_{c}")
        apart = across.join(x, "label_a", "left").join(y, "label_b", "left").filter(now("a") != now("b")).select("a", "b")
        labels = cut(merged(labels, found.unionByName(confirmed(cut(apart), full))))
    # Only classes with copies or a smaller component need a look-up; all others are their own.
    named = classes.join(labels, "doc_id", "left").withColumn("component_id", F.coalesce("label", "doc_id"))
    named = cut(named.filter("copies > 1 OR component_id <> doc_id").select("n_shingles", "set_hash", "component_id"))
    out = rows.select("doc_id", "n_shingles", "set_hash").join(_small(named, 64), ["n_shingles", "set_hash"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a) SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id)
"""


def op13_bbit_minhash(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
