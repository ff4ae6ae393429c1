"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep the smallest id.

Plan. One scan reduces each row to (doc_id, digest, copies). Hashes that occur once are done. Only rows
whose 128-bit hash repeats are read again with their text and grouped by (hash, text): that grouping is
the byte comparison, it splits colliding texts, and its map-side half folds a hot group of copies to one
row per task, so neither the texts of a hot group nor those of unique documents cross the network (the
repeating hashes are a broadcast of checked size; past the limit they are a shuffled semi join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import SPACES, checked_broadcast, cut, drop_listed, whole_text


def normalised(name: str = "text") -> Column:
    """The text that is compared: each run of ASCII white space is one space."""
    return F.regexp_replace(whole_text(name), SPACES, " ")


def digest(name: str = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(normalised(name).cast("binary"), 256)


def hash128(text_sha256: Column) -> Column:
    """The 128-bit content hash: the leading half of the digest."""
    return F.unhex(F.substring(text_sha256, 1, 32))


def exact_dedup(docs: DataFrame, key=hash128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, copies.

    Texts are equal when identical after each run of white space became one space; null is the empty
    text. The smallest doc_id of equal texts stays. Rows that share doc_id and text are told apart by
    count only: one of them may stay. Null ids count in group_size and stay only if no id is there.
    Empty input gives no rows; other columns are ignored. key maps the digest to the grouping hash.
    """
    rows = cut(docs.select("doc_id", digest().alias("sha")).groupBy("doc_id", "sha").agg(F.count("*").alias("copies")).select("doc_id", F.unhex("sha").alias("sha"), "copies"))
    hashed = rows.select("doc_id", "sha", "copies", key(F.lower(F.hex("sha"))).alias("key"))
    repeated = cut(hashed.groupBy("key").agg(F.sum("copies").alias("n")).filter("n > 1").select("key"))
    texts = docs.select("doc_id", normalised().alias("norm")).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).withColumn("key", key(F.col("sha")))
    classes = cut(
        texts.join(checked_broadcast(repeated, 40), "key", "left_semi")
        .groupBy("key", "norm")
        .agg(F.min("doc_id").alias("keep"), F.count("*").alias("size"))
        .select("key", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep", "size")
    )
    # (key, sha) names a class; unique hashes have none and stand for themselves.
    found = hashed.join(checked_broadcast(classes, 96), ["key", "sha"], "left")
    return found.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "copies",
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy_no") == 1)).alias("kept"),
        "text_sha256",
        "copies",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all columns of docs. Repeated rows of one id and text become one.

    Null texts are the empty text, null ids give way to any id of an equal text; no rows give no rows.
    """
    found = cut(exact_dedup(docs))
    sha = digest()
    gone = cut(found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.max("copies").alias("copies")).filter("not stays or copies > 1"))
    out = drop_listed(docs, gone, {"doc_id": F.col("doc_id"), "text_sha256": sha}, 120)
    again = gone.filter("stays").select(F.col("doc_id").alias("again_id"), F.col("text_sha256").alias("again_sha"))
    if again.isEmpty():
        return out
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_"), F.col("doc_id").alias("id_"), sha.alias("sha_"))
    one = whole.join(again, F.col("id_").eqNullSafe(F.col("again_id")) & (F.col("sha_") == F.col("again_sha")), "left_semi").groupBy("id_", "sha_").agg(F.first("row_").alias("row_"))
    return out.unionByName(one.select("row_.*"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256, count(*) OVER (PARTITION BY doc_id, text_sha256) AS copies
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
