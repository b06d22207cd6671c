"""Manuscripts, libraries, JSONL records and reports as files."""

from __future__ import annotations

import glob
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillcheck.functions.text import word_count
from quillcheck.session import broadcast_if_small

# Parts of file names and the sections they stand for, first hit first.
SECTION_HINTS = (
    ("proceeding", "combined"), ("combined", "combined"), ("full", "combined"), ("introduction", "intro"), ("intro", "intro"), ("method", "methods"), ("result", "results"),
    ("discussion", "discussion"), ("conclusion", "conclusion"), ("reference", "refs"), ("refs", "refs"), ("bibliography", "refs"),
)


def section_of(stem: Column) -> Column:
    """The section that a file name tells, else ``body``."""
    low = F.lower(stem)
    out: Column | None = None
    for hint, section in SECTION_HINTS:
        out = F.when(low.contains(hint), section) if out is None else out.when(low.contains(hint), section)
    return out.otherwise("body")


def expand_specs(specs: list[str], base: str | os.PathLike = ".") -> list[str]:
    """Paths and patterns relative to ``base``, patterns sorted, each file once where first seen."""
    seen: dict[str, None] = {}
    for spec in specs:
        full = spec if os.path.isabs(spec) else os.path.join(base, spec)
        hits = sorted(glob.glob(full, recursive=True)) if any(c in spec for c in "*?[") else [full]
        for h in hits:
            seen.setdefault(str(Path(h).resolve()))
    return list(seen)


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``ord, path, stem, content, text, modified`` of UTF-8 files in the given order; CR LF becomes LF.  One scan."""
    order = spark.createDataFrame([(i + 1, p) for i, p in enumerate(paths)], "ord int, path string")
    if not paths:
        return order.select("ord", "path", F.lit("").alias("stem"), F.lit(None).cast("binary").alias("content"), F.lit("").alias("text"), F.lit(None).cast("timestamp").alias("modified"))
    scan = spark.read.format("binaryFile").load(paths).withColumn("path", F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), r"^file:(?://)?", "")))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return scan.join(broadcast_if_small(order), "path").select("ord", "path", stem.alias("stem"), "content", text.alias("text"), F.col("modificationTime").alias("modified"))


def manuscripts(texts: DataFrame, version: str = "v1") -> DataFrame:
    """The manuscript record of every file."""
    return texts.select(
        F.format_string("mss-%03d", "ord").alias("id"), F.col("path").alias("file_path"), section_of(F.col("stem")).alias("section"), F.lit(version).alias("version"), F.sha2("content", 256).alias("sha256"),
        word_count(F.col("text")).cast("int").alias("word_count"), F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("last_modified"), "ord", "text",
    )


def manifest(records: DataFrame, project: str, target: str) -> DataFrame:
    """One row: the records in order and the first eight digits of the hash over their hashes, ``empty`` for none."""
    files = F.array_sort(F.collect_list(F.struct("ord", *[c for c in records.columns if c not in ("ord", "text")])))
    joined = F.array_join(F.transform("_f", lambda f: f["sha256"]), "")
    one = records.agg(files.alias("_f"))
    prefix = F.when(F.size("_f") == 0, "empty").otherwise(F.substring(F.sha2(joined, 256), 1, 8))
    return one.select(F.lit(project).alias("project"), F.lit(target).alias("audit_target"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("ingested_at"), F.transform("_f", lambda f: f.dropFields("ord")).alias("files"), prefix.alias("manifest_sha256_prefix8"))


def frontmatter(text: Column, key: str) -> Column:
    """A value of the leading block of a markdown file, unquoted; the last of equal keys; null without one."""
    head = F.left(text, F.lit(8192))
    block = F.when(head.startswith("---\n"), F.get(F.split(F.substring(head, F.lit(5), F.lit(8192)), r"\n---", 2), F.lit(0)))
    closed = F.when(F.substring(head, F.lit(4), F.lit(8192)).contains("\n---"), block)
    value = F.try_element_at(F.regexp_extract_all(closed, F.lit(rf"(?md)^{key}:[ \t]*(.*)$"), 1), F.lit(-1))
    return F.nullif(F.regexp_replace(F.trim(value), r"^[\"']|[\"']$", ""), F.lit(""))


def library(spark: SparkSession, root: str) -> DataFrame:
    """``path, stem, ext, doi, title`` of the markdown and PDF files below a folder; PDF files are only listed, the scan prunes their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    marked = files.option("pathGlobFilter", "*.[mM][dD]").load(root).select("path", F.decode(F.substring("content", 1, 32768), "UTF-8").alias("head"))
    printed = files.option("pathGlobFilter", "*.[pP][dD][fF]").load(root).select("path", F.lit(None).cast("string").alias("head"))
    scan = marked.unionByName(printed).withColumn("path", F.url_decode(F.regexp_replace(F.regexp_replace("path", r"\+", "%2B"), r"^file:(?://)?", ""))).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    text = F.col("head")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return scan.select("path", stem.alias("stem"), "ext", frontmatter(text, "doi").alias("doi"), frontmatter(text, "title").alias("title"))


def pdf_pages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, page_no, text`` of PDF files, by an optional reader; without it, or of a file it cannot read, no pages."""

    def pages(batches):
        import pandas as pd

        try:
            import pdfplumber
        except ImportError:
            pdfplumber = None
        for b in batches:
            rows = []
            for p in b["path"]:
                if pdfplumber is not None:
                    try:
                        with pdfplumber.open(p) as pdf:
                            rows += [(p, i + 1, page.extract_text() or "") for i, page in enumerate(pdf.pages)]
                    except (OSError, ValueError, TypeError):
                        continue
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(pages, "path string, page_no int, text string")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good records, and malformed lines for a warning as ``file, line_no, _corrupt``; blank lines and a missing file give nothing.

    Lines are numbered only for the warning, within their file.
    """
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    if not os.path.exists(path):
        empty = spark.createDataFrame([], corrupt)
        return empty.drop("_corrupt"), empty.select(F.lit("").alias("file"), F.lit(0).alias("line_no"), "_corrupt")
    lines = spark.read.text(path)
    record = F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    present = F.trim("value") != ""
    good = lines.where(present).select(record.alias("r")).select("r.*").where("_corrupt is null").drop("_corrupt")
    placed = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    within = Window.partitionBy("file").orderBy("_b", "_m")
    numbered = placed.withColumn("line_no", F.row_number().over(within)).where(present)
    bad = numbered.select("file", "line_no", record["_corrupt"].alias("_corrupt")).where("_corrupt is not null")
    return good, bad


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object per line, nulls kept, by all executors."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)
