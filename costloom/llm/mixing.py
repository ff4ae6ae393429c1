"""Mixing sources to target weights by hash-threshold histograms; nothing is sorted by document.

Each document has a fixed 60-bit hash. A source takes floor(target / size) whole copies of every document
and, of the rest, the documents whose hash is under the source's threshold. The threshold is found from
histograms: sizes summed by (source, leading hash bits) give the bucket in which the running sum passes
the budget; only that bucket is split by the next bits, until it holds one hash. Budgets are nested: with
the same hashes a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costloom.llm.common import WORD, checked_broadcast, cut, whole_text

BITS, LEVELS = 12, 5  # 5 levels of 12 bits make the 60 bits of the hash


def n_words(name: str = "text") -> Column:
    """Words of the whole text; null has none."""
    return F.regexp_count(whole_text(name), F.lit(WORD)).cast("long")


def hash60(*cols) -> Column:
    """60 bits of MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target from (source, source_size): one row for each source.

    Sources by code point, null last, weigh as the cycle of weights says and share all sizes; a target
    stops at most x its source's size and the excess goes to the others by weight, until none is above.
    That fixed point is a water level: sources fill up in order of size / weight, and the level that the
    others share is (total - capacity of the full) / (weight of the rest). Windows over sources only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    fill = every.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("place", F.row_number().over(fill))
    # The first place whose share fits under its cap ends the full ones; its level is the water level.
    s = s.withColumn("water", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("place") < F.col("water.place"), F.col("cap")).otherwise(F.col("water.level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, repeats, source, hash.

    repeats is how often the mix has the document, taken = repeats x size; repeats never passes most.
    Sizes default to words. Null texts have size 0, null sources are one source, an empty table gives no
    rows. The hash is of doc_id alone, so reruns agree; rows with one doc_id stand or fall together, and
    where one hash holds the boundary it is taken if that comes nearer to the target. Extra columns are
    ignored. A source of any size is fine: no source meets in one task but its histogram.
    """
    rows = cut(docs.select("doc_id", "source", (n_words() if size is None else size).alias("size"), hash60(F.col("doc_id")).alias("hash")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    cuts = cut(targets.select("source", "source_size", "target", whole.cast("long").alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("under")))
    source = F.col("source").eqNullSafe(F.col("at_source"))

    def side(table: DataFrame, *names: str) -> DataFrame:
        return checked_broadcast(table, 96).select(F.col("source").alias("at_source"), *names)

    for level in range(1, LEVELS + 1):
        # Histogram of the boundary bucket only: [lo, lo + 2^width) split into 2^BITS parts.
        width = 60 - BITS * level
        inside = rows.join(side(cuts, "lo"), source & (F.shiftright("hash", width + BITS) == F.shiftright("lo", width + BITS)))
        hist = inside.groupBy("source", F.shiftright("hash", width).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        part = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        part = part.join(side(cuts, "under", "budget"), source).withColumn("upto", F.col("under") + F.col("upto"))
        at = F.struct("bucket", (F.col("upto") - F.col("n")).alias("under"), "upto", F.col("first").alias("first"), F.col("last").alias("last"))
        bound = part.filter("upto > budget").groupBy("source").agg(F.min(at).alias("b"))
        # Without a bucket that passes the budget the threshold lies above all hashes of the bucket before.
        cuts = cut(
            cuts.alias("c").join(bound.alias("b"), F.col("c.source").eqNullSafe(F.col("b.source")), "left").select(
                "c.source", "c.source_size", "c.target", "c.whole", "c.budget",
                F.when(F.col("b.b").isNull(), F.lit(1 << 60) if level == 1 else F.col("c.lo")).otherwise(F.shiftleft(F.col("b.b.bucket"), width)).alias("lo"),
                F.coalesce("b.b.under", "c.under").alias("under"),
                F.col("b.b.upto").alias("upto"), F.col("b.b.first").alias("first"), F.col("b.b.last").alias("last"),
            )
        )
        if level == LEVELS or cuts.filter("first < last").isEmpty():
            break
    # One hash is left in the boundary bucket: in if that comes nearer to the budget.
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("under")
    ends = cuts.withColumn("below", F.when(F.col("first").isNull(), F.col("lo")).when(nearer, F.col("last") + 1).otherwise(F.col("first")))
    ends = cut(ends.select("source", "source_size", "target", "whole", "below"))
    out = rows.join(side(ends, "source_size", "target", "whole", "below"), source, "left").withColumn("repeats", F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats", "source", "hash")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all columns of docs.

    Documents are known by id and source, null as well, so repeated rows are taken alike; texts without words and
    null texts have size 0 and go by their hash; no rows give no rows.
    """
    found = cut(mix(docs).select("doc_id", "source", "repeats").distinct())
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_"), F.col("doc_id").alias("id_"), F.col("source").alias("source_"))
    side = checked_broadcast(found, 64).select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), "repeats")
    out = rows.join(side, F.col("id_").eqNullSafe(F.col("mix_id")) & F.col("source_").eqNullSafe(F.col("mix_source"))).filter("repeats > 0")
    return out.select("row_", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int")))).select("row_.*")


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS hash
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS w,
            source_size * 3.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sizes),
filled AS (  -- in rounds, as the rule is told: whoever is above the cap stops there, the rest is shared again
  SELECT 0 AS k, source, source_size, w, cap, total, false AS stop, total * w / sum(w) OVER () AS target FROM weighed
  UNION ALL
  SELECT k + 1, source, source_size, w, cap, total, now_stop,
         CASE WHEN now_stop THEN cap ELSE (total - coalesce(sum(CASE WHEN now_stop THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT now_stop THEN w END) OVER () * w END
  FROM (SELECT *, stop OR target > cap AS now_stop FROM filled WHERE k < (SELECT count(*) + 1 FROM sizes)) q),
targets AS (SELECT source, source_size, target,
                   CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
            FROM filled WHERE k = (SELECT max(k) FROM filled)),
by_hash AS (SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS budget,
                   sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE UNBOUNDED PRECEDING) AS upto,
                   sum(size) OVER (PARTITION BY d.source, hash) AS tied
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
chosen AS (SELECT *, upto <= budget OR (upto - tied <= budget AND upto - budget < budget - (upto - tied)
                     AND upto = min(CASE WHEN upto > budget THEN upto END) OVER (PARTITION BY source)) AS extra
           FROM by_hash)
SELECT doc_id, size, source_size, target, CAST((whole + CAST(extra AS INT)) * size AS BIGINT) AS taken,
       CAST(whole + CAST(extra AS INT) AS BIGINT) AS repeats, source, hash
FROM chosen
"""


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
