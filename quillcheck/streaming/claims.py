"""Claims and citations from streams of lines, and late references against a stream of deliveries.

Extraction is stateless per line, so the batch functions run unchanged on a
streaming frame; nothing is kept between triggers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quillcheck.operators.citations import extract_citations
from quillcheck.operators.claims import extract_claims


def claims_stream(lines: DataFrame) -> DataFrame:
    """Claims of a stream of lines: manuscript_id, section, line_no, text and any other columns."""
    return extract_claims(lines)


def citations_stream(lines: DataFrame) -> DataFrame:
    """Citations of a stream of lines."""
    return extract_citations(lines)


def claim_counts(lines: DataFrame, event_time: str, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Claims per type and time window; rows later than ``lateness`` are dropped by the watermark."""
    claims = extract_claims(lines.withWatermark(event_time, lateness))
    return claims.groupBy(F.window(event_time, width), "claim_type").agg(F.count("*").alias("n"))


def write_stream(frame: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to parquet files exactly once; the checkpoint folder must be shared by all executors."""
    return frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_line_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of parquet line files."""
    return spark.readStream.schema(schema).parquet(path)
