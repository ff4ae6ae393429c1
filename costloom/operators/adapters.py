"""Thin edges: instructions for a writer, documents for other libraries, choice of an embedder, stories as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costloom.operators.retrieval import hash_cosine, hash_vectors, idf, postings

#: Steps that a writer is instructed for: id, area, temperature, output, instruction. Numbers always come from the facts.
PROMPTS = [
    ("A0", "shared", 0.0, "injected", "Use only numbers that the facts hold, each with a citation; never compute."),
    ("M1-1", "report", 0.0, "json", "Plan the chapters of the report for the topic, month and products given."),
    ("M1-2", "report", 0.3, "json", "Explain the movements in the facts with the evidence, each claim cited."),
    ("M1-3", "report", 0.0, "json", "Sum up the chapters and suggest actions that can be checked."),
    ("M1-4", "report", 0.0, "rule", "Fill numbers from the mapping, texts from drafts, tables from queries."),
    ("M2-1", "dashboard", 0.0, "json", "Say which element contributed most and which alerts are open."),
    ("M2-2", "dashboard", 0.0, "rule", "Alert on movements beyond the calibrated band of their tier."),
    ("M3-1", "benchmark", 0.0, "json", "Name the largest differences between the plants."),
    ("M3-2", "benchmark", 0.0, "json", "Break a difference down to elements and materials."),
    ("M3-3", "benchmark", 0.0, "json", "Give causes of a difference from the evidence, with suggestions."),
    ("M4-1", "remediation", 0.0, "json", "Turn a finding into a task of the task schema."),
    ("M4-2", "remediation", 0.0, "text", "Write a notice of at most 80 characters for a task."),
    ("M4-3", "remediation", 0.0, "json", "State the risk of pushing each task; suggest confirm or hold."),
]


def prompt_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROMPTS, "prompt_id string, area string, temperature double, output string, instruction string")


def embedded_search(docs: DataFrame, queries: DataFrame, k: int, embed: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, str | None]:
    """(query_id, id, score, place; warning): nearest documents by embed, or by hashed vectors where it fails.

    embed gets (docs, queries, k); a model that isn't available raises when asked, before any row is read.
    """
    warning = None
    if embed is not None:
        try:
            return embed(docs, queries, k), None
        except (ImportError, OSError) as e:
            warning = f"hashed vectors in place of the model: {e}"
    post = postings(docs)
    weights = idf(post, post.select("id").distinct().agg(F.count("*").alias("n")))
    return hash_cosine(queries, hash_vectors(post, weights), weights, k), warning


def as_documents(results: list[dict], warnings: list[str] = ()) -> list:
    """Results as LangChain documents, warnings as empty ones; needs the optional langchain_core."""
    from langchain_core.documents import Document

    found = [Document(page_content=r.get("text", ""), metadata={k: v for k, v in r.items() if k != "text"}) for r in results]
    return found + [Document(page_content="", metadata={"warning": w}) for w in warnings]


def narrated(rows: DataFrame) -> DataFrame:
    """Each row as a JSON line of a story."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def causal_diagram(chains: list[tuple[str, str, str, str]]) -> str:
    """A Mermaid graph of (id, event, driver, product)."""
    lines = [f"  {i}[{event}] --> {i}d[{driver}] --> {i}u[unit cost {product}]" for i, event, driver, product in chains]
    return "\n".join(["graph LR", *lines])
