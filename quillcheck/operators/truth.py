"""Ground truth from the tables of a statistics document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcheck.functions.text import to_number, whole_number
from quillcheck.schemas import TRUTH
from quillcheck.session import broadcast_if_small

TABLES = ("p_table", "beta_table", "wilcoxon_table")
TABLE_FIELDS = ("f", "df1", "df2", "p_r", "p_scipy", "beta", "se", "ci_low", "ci_high", "v", "p_wil")
NUMBER = r"[+\-−.\d]+"


def table_rows(lines: DataFrame, heading: str | Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Data rows of the first table under a heading: ``line_no, cells``.

    The first line that contains the heading opens the section; every line that
    contains it is skipped.  The separator row ends the header, the first other
    line behind it ends the table, later separators are skipped.  Three minima
    over one window per document.  ``keep`` names the columns that tell
    documents apart.  No heading or separator: no rows.
    """
    document = Window.partitionBy(*(keep or (F.lit(0),)))
    inner = F.regexp_extract("text", r"^\|(.+)\|\s*$", 1)
    rows = lines.where(F.col("text").isNotNull()).select(*keep, "line_no", "text")
    rows = rows.withColumns({"has": F.contains("text", F.lit(heading) if isinstance(heading, str) else heading), "is_row": F.col("text").rlike(r"^\|(.+)\|\s*$")})
    rows = rows.withColumn("cells", F.when(F.col("is_row"), F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c))))
    rows = rows.withColumn("is_rule", F.coalesce(F.forall("cells", lambda c: c.rlike("^[-: ]*$")), F.lit(False)))
    rows = rows.withColumn("_h", F.min(F.when(F.col("has"), F.col("line_no"))).over(document))
    below = (F.col("line_no") > F.col("_h")) & ~F.col("has")
    rows = rows.withColumn("_s", F.min(F.when(below & F.col("is_rule"), F.col("line_no"))).over(document))
    inside = below & (F.col("line_no") > F.col("_s"))
    rows = rows.withColumn("_e", F.min(F.when(inside & ~F.col("is_row"), F.col("line_no"))).over(document))
    body = inside & (F.col("_e").isNull() | (F.col("line_no") < F.col("_e"))) & F.col("is_row") & ~F.col("is_rule")
    return rows.where(body).select(*keep, "line_no", "cells")


def _cell(i: int) -> Column:
    return F.coalesce(F.get("cells", i), F.lit(""))


def _digits(i: int) -> Column:
    return F.when(_cell(i).rlike(r"^\d+$"), whole_number(_cell(i)))


def _missing(table: str, fields: dict[str, Column]) -> Column:
    absent = F.filter(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in fields.items()]), lambda x: x.isNotNull())
    return F.when(F.size(absent) > 0, F.concat(F.lit(f"{table}: missing/invalid required fields: "), F.array_join(absent, ", ")))


def _errors(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda e: e.isNotNull())


def p_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the p table: F, df1, df2, two p values and their parity."""
    fields = {"f": to_number(_cell(1)), "df1": _digits(2), "df2": _digits(3), "p_r": to_number(_cell(4)), "p_scipy": to_number(_cell(5))}
    parity = F.when(_cell(6).contains("✗"), "✗").when(_cell(6).contains("✓"), "✓").otherwise("unknown")
    bad = F.when(parity != "✓", F.lit("p_table: parity is not ✓"))
    return rows.select(*keep, "dv", "line_no", *[c.alias(n) for n, c in fields.items()], parity.alias("parity"), _errors(bad, _missing("p_table", fields)).alias("errors"))


def beta_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the coefficient table: β, SE, interval, consistency mark."""
    pair = rf"\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]"
    fields = {"beta": to_number(_cell(1)), "se": to_number(_cell(2)), "ci_low": to_number(F.regexp_extract(_cell(3), pair, 1)), "ci_high": to_number(F.regexp_extract(_cell(3), pair, 2))}
    bad = F.when(_cell(4).contains("✗"), F.lit("beta_table: interval is inconsistent"))
    return rows.select(*keep, "dv", "line_no", *[c.alias(n) for n, c in fields.items()], _errors(_missing("beta_table", fields), bad).alias("errors"))


def wilcoxon_rows(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the rank test table: V, p, r, d_z (cell 5), n (cell 7)."""
    fields = {"v": to_number(_cell(1)), "p_wil": to_number(_cell(2)), "r": to_number(_cell(3)), "dz": to_number(_cell(5)), "n": to_number(_cell(7))}
    short = F.when(F.size("cells") < 8, F.lit("wilcoxon_table: too few columns"))
    return rows.select(*keep, "dv", "line_no", *[c.alias(n) for n, c in fields.items() if n != "n"], _errors(short, _missing("wilcoxon_table", fields)).alias("errors"))


READERS = {"p_table": p_rows, "beta_table": beta_rows, "wilcoxon_table": wilcoxon_rows}


def labelled(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows whose first cell is a known label, with its measure; ``aliases``: label, dv."""
    return rows.withColumn("label", _cell(0)).join(broadcast_if_small(aliases.select("label", "dv").distinct()), "label")


def build_truth(lines: DataFrame, headings: dict[str, str], aliases: DataFrame, alpha: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per measure, and per document where ``keep`` tells them apart: the three tables merged with the reliabilities.

    The last row of a table wins as a whole, nulls included; errors of all rows
    accumulate.  A measure with a reliability but no table still has a row; of
    several reliabilities of a measure the highest counts.
    """
    key = [*keep, "dv"]
    merged = alpha.groupBy(*key).agg(F.max("alpha").alias("alpha")).withColumn("errors_alpha", F.array().cast("array<string>"))
    for table in TABLES:
        rows = READERS[table](labelled(table_rows(lines, headings[table], keep), aliases), keep)
        fields = [c for c in rows.columns if c not in (*key, "line_no", "errors")]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*fields), "line_no").alias("_r"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "errors"))), lambda e: e["errors"])).alias(f"errors_{table}"))
        merged = merged.join(last.select(*key, "_r.*", f"errors_{table}"), key, "full_outer")
    errors = F.concat(*[F.coalesce(f"errors_{t}", F.array().cast("array<string>")) for t in TABLES])
    merged = merged.withColumn("validation_errors", errors).withColumn("parity", F.coalesce("parity", F.lit("unknown")))
    present = set(merged.columns)
    return merged.select(*keep, *[F.col(f.name) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in TRUTH])


def mean_sd_cell(cell: Column) -> Column:
    """``mean (sd)`` of a summary cell as a struct; null fields where it does not match."""
    pattern = rf"^({NUMBER})%?\s*\(({NUMBER})\)"
    hit = cell.rlike(pattern)
    return F.when(hit, F.struct(to_number(F.regexp_extract(cell, pattern, 1)).alias("m"), to_number(F.regexp_extract(cell, pattern, 2)).alias("sd")))


def merge_summary(truth: DataFrame, cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``truth`` with means and deviations of the two conditions; ``cells``: dv, line_no, cells.

    Cell 1 fills the first condition, cell 2 the second; a cell that does not
    match leaves the old values.  The last matching row of a measure wins.
    """
    key = [*keep, "dv"]
    both = cells.select(*key, "line_no", mean_sd_cell(_cell(1)).alias("a"), mean_sd_cell(_cell(2)).alias("b"))
    last = both.groupBy(*key).agg(F.max_by("a", F.when(F.col("a").isNotNull(), F.col("line_no"))).alias("a"), F.max_by("b", F.when(F.col("b").isNotNull(), F.col("line_no"))).alias("b"))
    joined = truth.join(last, key, "left")
    slot = lambda old, c, f: F.when(F.col(c).isNotNull(), F.col(f"{c}.{f}")).otherwise(F.col(old)).alias(old)
    new = {"m_hq": ("a", "m"), "sd_hq": ("a", "sd"), "m_lq": ("b", "m"), "sd_lq": ("b", "sd")}
    return joined.select(*[slot(c, *new[c]) if c in new else F.col(c) for c in truth.columns])


def summary_rows(lines: DataFrame, headings: dict[str, str], spark: SparkSession, keep: tuple[str, ...] = ()) -> DataFrame:
    """Shape 1: one section per measure, the row whose first cell holds an M; ``headings``: heading → measure.

    The few headings are searched for in one pass over the lines of a document.
    """
    if not headings:
        return spark.createDataFrame([], lines.select(*keep, F.lit("").alias("dv"), F.lit(0).alias("line_no"), F.array().cast("array<string>").alias("cells")).schema)
    pairs = F.array(*[F.struct(F.lit(h).alias("_heading"), F.lit(dv).alias("dv")) for h, dv in sorted(headings.items())])
    asked = lines.select(*keep, "line_no", "text", F.inline(pairs))
    rows = table_rows(asked, F.col("_heading"), (*keep, "_heading", "dv"))
    return rows.where((F.size("cells") >= 3) & _cell(0).contains("M")).select(*keep, "dv", "line_no", "cells")


def summary_labels(lines: DataFrame, headings: list[str], aliases: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Shape 2: sections of rows whose first cell, emphasis aside, is a label."""
    out: DataFrame | None = None
    for heading in headings:
        rows = table_rows(lines, heading, keep).withColumn("label", F.replace(_cell(0), F.lit("*"), F.lit("")))
        rows = rows.join(broadcast_if_small(aliases.select("label", "dv").distinct()), "label").select(*keep, "dv", "line_no", "cells")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no heading is given")
    return out


def is_usable(validation_errors: Column = None) -> Column:
    """A row that can decide claims: a table value, no error, parity not ✗."""
    errors = F.col("validation_errors") if validation_errors is None else validation_errors
    some = F.coalesce(*[F.col(c).cast("double") for c in (*TABLE_FIELDS[:10], "p_wil")]).isNotNull()
    return some & (F.coalesce(F.size(errors), F.lit(0)) <= 0) & (F.coalesce(F.col("parity"), F.lit("unknown")) != "✗")


def has_usable_truth(truth: DataFrame) -> DataFrame:
    """One row ``usable``: whether any measure can decide claims; false for an empty table."""
    return truth.agg(F.coalesce(F.max(is_usable()), F.lit(False)).alias("usable"))
