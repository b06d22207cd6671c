"""Counts, rates, gates and the length check of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.functions.text import lines_of
from quillcheck.schemas import RESULT

CITATION_TARGETS = ("in-text-citation", "reference-entry")


def ordered_counts(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Values and counts, most frequent first, ties by first appearance; nulls are a value."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").drop("_first")


def measure_counts(results: DataFrame) -> DataFrame:
    """Results per matched measure; blank ones are left out."""
    return results.where(F.coalesce(F.col("matched_dv"), F.lit("")) != "").groupBy("matched_dv").agg(F.count("*").alias("n"))


def manual_by_type(results: DataFrame, claims: DataFrame) -> DataFrame:
    """MANUAL results of claims by claim type."""
    manual = results.where((F.col("status") == "MANUAL") & (F.col("target_type") == "numerical-claim")).select(F.col("target_id").alias("id"))
    return manual.join(claims.select("id", "claim_type").distinct(), "id").groupBy("claim_type").agg(F.count("*").alias("n"))


def pass_rate(results: DataFrame) -> DataFrame:
    """One row: ``n``, ``n_pass`` and the percentage that passes; 0 for none."""
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("n_pass")).withColumn("pass_rate", F.coalesce(F.try_divide(F.col("n_pass") * 100.0, F.col("n")), F.lit(0.0)))


def fail_breakdown(results: DataFrame) -> DataFrame:
    """One row: failures in all, of claims, of citations and entries, and the rest."""
    fail = F.col("status") == "FAIL"
    out = results.agg(
        F.count_if(fail).alias("n_fail"), F.count_if(fail & (F.col("target_type") == "numerical-claim")).alias("n_numerical"), F.count_if(fail & F.col("target_type").isin(*CITATION_TARGETS)).alias("n_citation")
    )
    return out.withColumn("n_other", F.col("n_fail") - F.col("n_numerical") - F.col("n_citation"))


def fail_detail(results: DataFrame, order: str, top: int = 20) -> DataFrame:
    """The first failures in result order; the limit is the feature."""
    return results.where(F.col("status") == "FAIL").orderBy(order).limit(top)


def gate(counts: DataFrame, broken: Column, target_type: str, target_id: str, evidence: str) -> DataFrame:
    """One FAIL result if a one-row table breaks its condition, else none."""
    values = {"id": "vr-0000", "target_type": target_type, "target_id": target_id, "verifier": f"{target_type}-gate" if target_type != "coverage" else "coverage-gate", "status": "FAIL", "evidence": evidence}
    return counts.where(F.coalesce(broken, F.lit(True))).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in RESULT])


def coverage_gate(items: DataFrame, what: str) -> DataFrame:
    """FAIL if something that was configured yields nothing."""
    return gate(items.agg(F.count("*").alias("n")), F.col("n") == 0, "coverage", what, f"{what}: nothing found")


def truth_gate(claims: DataFrame, usable: DataFrame) -> DataFrame:
    """FAIL if there are claims but no usable truth."""
    counts = claims.agg(F.count("*").alias("n")).crossJoin(usable)  # one row each
    return gate(counts, (F.col("n") > 0) & ~F.col("usable"), "ground-truth", "ground-truth", "no usable ground truth")


def truth_coverage(truth: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``n_measures`` with ground truth and their names in order; the names are bounded by the catalog."""
    names = F.array_sort(F.collect_set("dv"))
    return truth.groupBy(*keep).agg(F.count_distinct("dv").alias("n_measures"), F.array_join(names, ", ").alias("measures"))


def error_gate(spark: SparkSession, error: str) -> DataFrame:
    """FAIL with the reason why the comparison of paraphrases ended early."""
    one = spark.range(1).select(F.lit(0).alias("n"))
    return gate(one, F.lit(True), "phase-2", "paraphrase-matching", f"phase 2 failed: {error}")


def scored_gate(matches: DataFrame) -> DataFrame:
    """FAIL if no paraphrase was decided with a valid score."""
    ok = F.col("status").isin("PASS", "FAIL") & (F.col("score") >= 0) & (F.col("score") <= 1)
    return gate(matches.agg(F.count_if(ok).alias("n")), F.col("n") == 0, "phase-2", "phase-2", "no paraphrase has a valid score")


def exit_code(results: DataFrame, page_status: Column | None = None) -> DataFrame:
    """One row ``exit_code``: 1 if anything failed, else 0."""
    return results.agg(F.when(F.count_if(F.col("status") == "FAIL") > 0, 1).otherwise(0).alias("exit_code"))


def page_status(n_lines: Column, most_pass: int = 70, most_warn: int = 85) -> Column:
    """PASS, WARN or FAIL by the number of lines; FAIL for a missing page."""
    return F.when(n_lines.isNull(), "FAIL").when(n_lines <= most_pass, "PASS").when(n_lines <= most_warn, "WARN").otherwise("FAIL")


def page_check(pages: DataFrame, text: str = "text", most_pass: int = 70, most_warn: int = 85) -> DataFrame:
    """``pages`` with ``line_count`` and ``status``."""
    n = F.size(lines_of(F.col(text)))
    return pages.withColumn("line_count", F.when(F.col(text).isNotNull(), n)).withColumn("status", page_status(F.col("line_count"), most_pass, most_warn))
