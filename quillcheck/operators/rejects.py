"""Rows that fail to parse, set apart with their reason while the valid ones load."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillcheck.functions import grammars
from quillcheck.session import spread

PROBLEM = T.StructType([T.StructField("reason", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("message", T.StringType())])
STATISTIC = T.StructType(
    [T.StructField("dv", T.StringType()), T.StructField("f", T.DoubleType()), T.StructField("df1", T.LongType()), T.StructField("df2", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("p_r", "p_scipy", "beta", "se", "ci_low", "ci_high")]
    + [T.StructField("n", T.LongType()), T.StructField("parity", T.StringType()), T.StructField("remark", T.StringType())]
)
REFERENCE = T.StructType(
    [T.StructField("authors", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("suffix", T.StringType()), T.StructField("title", T.StringType()), T.StructField("link", T.StringType())]
)


def _parsed(values: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("reason", T.StringType()), T.StructField("problems", T.ArrayType(PROBLEM)), T.StructField("record", values)])


def _row(record: grammars.Record, names: list[str]) -> dict:
    return {
        "reason": record.reason,
        "problems": [{"reason": p.reason, "position": p.position, "message": p.message} for p in record.problems],
        "record": {n: record.values.get(n) for n in names},
    }


def _bounded(record: grammars.Record) -> grammars.Record:
    """Whole numbers beyond 64 bits have no typed value."""
    for name in ("df1", "df2", "n"):
        value = record.values.get(name)
        if not isinstance(value, int) or abs(value) >= 1 << 63:
            record.values[name] = None
    return record


@F.pandas_udf(T.ArrayType(_parsed(STATISTIC)))
def parse_statistics(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The records of export text: one per line, null for null."""
    names = STATISTIC.fieldNames()
    for batch in lines:
        yield pd.Series([None if t is None else [_row(_bounded(r), names) for r in grammars.read_export(t)] for t in batch], dtype=object)


@F.pandas_udf(_parsed(REFERENCE))
def parse_reference(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """One reference entry; null and blank texts lack their parts."""
    names = REFERENCE.fieldNames()
    for batch in texts:
        yield pd.DataFrame([_row(grammars.read_reference(t), names) for t in batch], columns=["reason", "problems", "record"])


def statistics_records(rows: DataFrame, text: str = "raw_line") -> DataFrame:
    """Every delivered record with ``reason`` (null when valid), ``problems`` and its typed columns.

    Columns of the input are kept under ``source``, so extra columns with
    clashing names do no harm.  A null text is one record without columns.
    """
    source = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("source")
    parsed = spread(rows.select(source)).withColumn("p", F.explode(parse_statistics(F.coalesce(F.col(f"source.{text}"), F.lit("")))))
    return parsed.select("source", "p.reason", "p.problems", "p.record.*")


def reference_records(entries: DataFrame, text: str = "raw_text") -> DataFrame:
    """Every entry with ``reason`` (null when valid), ``problems`` and the parsed parts."""
    source = F.struct(*[F.col(f"`{c}`") for c in entries.columns]).alias("source")
    parsed = spread(entries.select(source)).withColumn("p", parse_reference(F.col(f"source.{text}")))
    return parsed.select("source", "p.reason", "p.problems", "p.record.*")


def _rejects(records: DataFrame, table: str, record_id: Column) -> DataFrame:
    return records.where(F.col("reason").isNotNull()).select(F.lit(table).alias("record_table"), record_id.cast("string").alias("record_id"), "reason").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and entries that cannot be loaded, with the first reason that holds."""
    lines = spark.read.parquet(f"{sf_dir}/raw_stat_rows.parquet").select("row_id", "raw_line")
    entries = spark.read.parquet(f"{sf_dir}/reference_entries.parquet").select("id", "raw_text")
    found = _rejects(statistics_records(lines), "raw_stat_rows", F.col("source.row_id"))
    return found.unionByName(_rejects(reference_records(entries), "reference_entries", F.col("source.id")))


def p4_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid statistics, typed, ready for gt_rows."""
    lines = spark.read.parquet(f"{sf_dir}/raw_stat_rows.parquet").select("row_id", "manuscript_id", "raw_line")
    good = statistics_records(lines).where(F.col("reason").isNull())
    return good.select(F.col("source.row_id").alias("row_id"), F.col("source.manuscript_id").alias("manuscript_id"), *[c for c in STATISTIC.fieldNames() if c != "remark"]).distinct()


def p4_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located syntax errors of the statistics lines and reference entries: code-point position and what was expected."""
    lines = spark.read.parquet(f"{sf_dir}/raw_stat_rows.parquet").select("row_id", "raw_line")
    entries = spark.read.parquet(f"{sf_dir}/reference_entries.parquet").select("id", "raw_text")
    parts = [(statistics_records(lines), "raw_stat_rows", F.col("source.row_id").cast("string")), (reference_records(entries), "reference_entries", F.col("source.id"))]
    found = [r.where(F.col("reason").isNotNull()).select(F.lit(t).alias("record_table"), i.alias("record_id"), F.inline("problems")) for r, t, i in parts]
    return found[0].unionByName(found[1]).distinct()
