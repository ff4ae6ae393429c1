"""Chunks of a knowledge base from documents and tables: sections, windows, types, versions, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costloom.functions import text as fn
from costloom.functions.maths import general, signed
from costloom.operators.retrieval import chunk_type


def normalised(raw: Column) -> Column:
    """Page text as it is cut: compatibility forms unified, radicals as characters, line ends alike."""
    return F.regexp_replace(fn.unified(fn.nfkc()(F.coalesce(raw, F.lit("")))), r"\r\n?", "\n")


def whole_documents(pages: DataFrame) -> DataFrame:
    """source, text, starts: each document's pages (source, page, text) joined by line ends, and where each page starts.

    A document is one row from here on; null pages are empty.
    """
    one = pages.select("source", "page", normalised(F.col("text")).alias("text"))
    by = one.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    begin = lambda i: F.aggregate(F.slice("p", 1, i), F.lit(0), lambda n, x: n + F.length(x["text"]) + 1)
    starts = F.transform("p", lambda x, i: F.struct(begin(i).alias("at"), x["page"].alias("page")))
    return by.select("source", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), starts.alias("starts"))


def page_at(starts: Column, place: Column) -> Column:
    """The page that a place in a document's text is on."""
    return F.element_at(F.filter(starts, lambda s: s["at"] <= place), -1)["page"]


def document_chunks(pages: DataFrame, kinds: DataFrame, version: str = "v1", mark: str = "。") -> DataFrame:
    """chunk_id, source, page, end_page, doc_version, type, title, text, context, forbid_current_numbers.

    Each document is cut at its headings, long sections into windows that end at a mark. kinds gives a
    source's kind, by which titles get their types. page and end_page are where the section's first and last line are, by
    the places of the cut, so headings may repeat; without a heading, the whole document's. Documents without text have no chunks.
    """
    docs = whole_documents(pages).join(F.broadcast(kinds.select("source", "kind")), "source", "left")
    rows = docs.select("source", "kind", "starts", F.posexplode(fn.split_sections(F.col("text"), places=True)).alias("n", "s"))
    kind = F.coalesce("kind", F.lit(""))
    type_, forbid = chunk_type(F.col("s.title"), kind)
    cut = rows.select("source", "n", F.col("s.title").alias("title"), F.col("s.text").alias("section"), page_at(F.col("starts"), F.col("s.start")).alias("page"), page_at(F.col("starts"), F.greatest(F.col("s.end") - 1, F.col("s.start"))).alias("end_page"), type_.alias("type"), forbid.alias("forbid_current_numbers"), F.posexplode(fn.windows(F.col("s.text"), mark)).alias("k", "w"))
    text = F.substring("section", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    out = cut.select(F.concat_ws("-", "source", F.col("n"), F.col("k")).alias("chunk_id"), "source", "page", "end_page", F.lit(version).alias("doc_version"), "type", "title", text.alias("text"), F.concat_ws(" ", "source", "title").alias("context"), "forbid_current_numbers")
    return out.filter(F.length(F.trim("text")) > 0)


def benchmark_chunks(rows: DataFrame, source: str, version: str = "v1") -> DataFrame:
    """A chunk for each row of an industry table: product, item, low, mean, high, own."""
    c = lambda n: F.coalesce(general(F.col(n)), F.lit("—"))
    off = signed((F.col("own") / F.nullif(F.col("mean"), F.lit(0.0)) - 1) * 100, 1, "%")
    text = F.concat("product", F.lit(" "), "item", F.lit(": "), c("low"), F.lit(" to "), c("high"), F.lit(", mean "), c("mean"), F.lit(", own "), c("own"), F.lit(" ("), off, F.lit(")"))
    return rows.select(F.concat_ws("-", F.lit(source), "product", "item").alias("chunk_id"), F.lit(source).alias("source"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("end_page"), F.lit(version).alias("doc_version"), F.lit("行业基准").alias("type"), F.col("item").alias("title"), text.alias("text"), F.concat_ws(" ", F.lit(source), "product").alias("context"), F.lit(False).alias("forbid_current_numbers"))


def knowledge_base(parts: list[DataFrame]) -> DataFrame:
    """All chunks of several kinds, numbered by their id for the index; of one id the first by text stays."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    one = both.groupBy("chunk_id").agg(F.min(F.struct("text", *[c for c in both.columns if c not in ("chunk_id", "text")])).alias("x")).select("chunk_id", "x.*")
    return one.withColumn("chunk_no", F.abs(F.xxhash64("chunk_id")))
