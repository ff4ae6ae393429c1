"""Tables in: Parquet folders, the CSV data pack, and text or office documents as rows."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the CSV pack's tables in the engine's names, as DDL.
SCHEMAS = {
    "cost_monthly": "product string, month string, volume long, material double, labor double, overhead double, unit_cost double, total_cost double",
    "material_detail": "product string, month string, material string, unit_consumption_cost double, total_material_cost double, share_of_material string",
    "overhead_detail": "product string, month string, category string, amount double, unit_amount double",
    "labor_detail": "product string, month string, labor_total double, hours double, volume long, headcount long, work_days long",
    "budget": "product string, month string, budget_volume long, budget_material double, budget_labor double, budget_overhead double, budget_unit_cost double, budget_total_cost double",
    "industry_benchmark": "category string, metric string, p25 double, p50 double, p75 double, own_level double, assessment string",
}


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan over all cores where it has fewer files than those; beyond that as they are.

    A file may be one row group, which one task reads whatever its size; work on texts then runs on one core. A table of
    many files, as large ones are, isn't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pack_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV of the pack with its declared schema; a byte-order mark is passed over, a bad row fails."""
    return spark.read.schema(SCHEMAS[name]).csv(path, header=True, enforceSchema=True, mode="FAILFAST", encoding="UTF-8")


def read_cost_files(spark: SparkSession, files: dict[tuple[str, int], str]) -> DataFrame:
    """cost_monthly of all (factory, year) files as one table; filters on both prune files."""
    out = None
    for (factory, year), path in files.items():
        part = read_pack_csv(spark, path, "cost_monthly").withColumns({"factory": F.lit(factory), "year": F.lit(year)})
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no cost files")
    return out


def checked_month(col):
    """The month, or an error where it isn't like yyyy-MM."""
    return F.when(col.rlike("^.{4}-.{2}$"), col).otherwise(F.raise_error(F.concat(F.lit("not a month: "), col)))


def decode_text(content: bytes) -> str:
    """Text of unknown encoding: UTF-8 with or without mark, then GBK, then UTF-8 with replacement."""
    for name in ("utf-8-sig", "gbk"):
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with their cells joined by a space; straight from the package's XML."""
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda x: "".join(t.text or "" for t in x.iter(f"{w}t"))
    lines = [text(p) for p in body.findall(f"{w}p")]
    for row in body.iter(f"{w}tr"):
        lines.append(" ".join(text(c).strip() for c in row.findall(f"{w}tc")))
    return "\n".join(x for x in lines if x.strip())


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page; needs the optional pypdf."""
    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, page (from 1), text, error of .txt, .docx and .pdf files; one that can't be read is a row of nulls with its error."""
    import pyarrow as pa

    def parse(batches):
        schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                kind = re.sub(r"^.*\.", "", r["path"]).lower()
                try:
                    pages = pdf_pages(r["content"]) if kind == "pdf" else [docx_text(r["content"]) if kind == "docx" else decode_text(r["content"])]
                except Exception as e:
                    rows.append({"path": r["path"], "error": f"{type(e).__name__}: {e}"[:500]})
                    continue
                rows += [{"path": r["path"], "page": i, "text": t} for i, t in enumerate(pages, 1)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").rlike(r"\.(txt|docx|pdf)$")).select("path", "content").mapInArrow(parse, "path string, page int, text string, error string")
