"""References matched with the files of a local library, best rank first, only if the best is alone."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillcheck.session import numbered

# Title words that do not distinguish.
TITLE_STOPWORDS = ("a", "an", "the", "of", "and", "in", "on", "for", "to", "with")


def _fold(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").casefold()


@F.pandas_udf(T.ArrayType(T.StringType()))
def folded_tokens(texts: pd.Series) -> pd.Series:
    """Compatible, case-folded words of letters and digits; none for null."""
    return pd.Series([re.findall(r"[^\W_]+", _fold(t)) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def folded_letters(texts: pd.Series) -> pd.Series:
    """Compatible, case-folded letters and digits alone; empty for null."""
    return pd.Series(["".join(c for c in _fold(t) if c.isalnum()) for t in texts], dtype=object)


def doi_key(doi: Column) -> Column:
    """A DOI without resolver, case and trailing punctuation; null for none."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.nullif(F.regexp_replace(bare, r"[.,;]+$", ""), F.lit(""))


def contains_run(tokens: Column, needle: Column) -> Column:
    """Whether ``needle`` stands in ``tokens`` as an unbroken run; false for an empty one."""
    spaced = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(spaced(tokens), spaced(needle))


def match_library(references: DataFrame, files: DataFrame) -> DataFrame:
    """Per reference ``pdf_path`` and ``source_kind``: one file of the best rank, else ambiguous or not-found.

    ``references``: id, first_author_last, year, title, doi; ``files``: path,
    stem, doi, title, ext.  Candidates meet through equal keys, not by pairing
    every file with every reference: the DOI, the words of the DOI at the end of
    the file's name, or an author word with a year of at most one off.  Ranks: DOI, title, author and year, author and a year off
    by one.  Different DOIs veto.  Blank authors find nothing.
    """
    ref = references.select("id", F.col("year").alias("r_year"), folded_tokens("first_author_last").alias("author"), folded_tokens("title").alias("t_tokens"), folded_letters("title").alias("t_letters"), doi_key(F.col("doi")).alias("r_doi"))
    ref = ref.withColumns({"ref_key": F.xxhash64("id", "r_year", "author", "t_letters", "r_doi"), "t_words": F.array_except("t_tokens", F.array(*map(F.lit, TITLE_STOPWORDS)))})
    ref = ref.withColumn("distinct_title", (F.size("t_words") >= 2) | F.exists("t_words", lambda w: F.length(w) >= 4)).where(F.size("author") > 0)
    lib = files.select("path", "ext", folded_tokens("stem").alias("name"), doi_key(F.col("doi")).alias("f_doi"), folded_letters("title").alias("f_letters"))

    years = F.filter("name", lambda w: w.rlike(r"^\d{1,4}$"))
    by_word = lib.select("path", "name", F.explode(F.array_distinct(years)).alias("y")).select("path", "y", F.explode(F.array_distinct("name")).alias("k"))
    author_key = ref.where("r_year is not null").select("ref_key", F.get("author", F.lit(0)).alias("k"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: (F.col("r_year") + d).cast("string"))).alias("y"))
    by_author = author_key.join(by_word, ["k", "y"]).select("ref_key", "path").distinct()
    by_doi = ref.where("r_doi is not null").select("ref_key", F.col("r_doi").alias("k")).join(lib.where("f_doi is not null").select("path", F.col("f_doi").alias("k")), "k").select("ref_key", "path")
    doi_tail = ref.where("r_doi is not null").select("ref_key", F.array_join(F.filter(F.split(F.col("r_doi"), r"[^\p{L}\p{N}]+"), lambda t: t != ""), " ").alias("k")).where("k <> ''")
    tails = F.transform(F.sequence(F.lit(1), F.size("name")), lambda i: F.array_join(F.slice("name", i, F.size("name")), " "))
    by_tail = doi_tail.join(lib.where(F.size("name") > 0).select("path", F.explode(tails).alias("k")), "k").select("ref_key", "path")
    pairs = by_author.unionByName(by_doi).unionByName(by_tail).distinct().join(ref, "ref_key").join(lib, "path")

    doi_tokens = F.filter(F.split(F.col("r_doi"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    ends_with = F.col("r_doi").isNotNull() & (F.size("name") >= F.size(doi_tokens)) & (F.slice("name", -F.size(doi_tokens), F.size(doi_tokens)) == doi_tokens)
    veto = F.col("r_doi").isNotNull() & F.col("f_doi").isNotNull() & (F.col("r_doi") != F.col("f_doi"))
    doi_match = F.coalesce(F.col("r_doi") == F.col("f_doi"), F.lit(False)) | F.coalesce(ends_with, F.lit(False))
    year = lambda off: F.array_contains("name", (F.col("r_year") + off).cast("string"))
    author = contains_run(F.col("name"), F.col("author"))
    near = year(0) | year(-1) | year(1)
    title = author & near & F.col("distinct_title") & ((F.size(F.array_except("t_words", "name")) == 0) | (F.col("t_letters") == F.col("f_letters")))
    rank = F.when(doi_match, 0).when(F.coalesce(title, F.lit(False)), 1).when(author & F.coalesce(year(0), F.lit(False)), 2).when(author & F.coalesce(near, F.lit(False)), 3)
    ranked = pairs.where(~veto).withColumn("rank", rank).where("rank is not null")
    best = ranked.groupBy("ref_key").agg(F.min(F.struct("rank", "path")).alias("m"), F.min("rank").alias("low"))
    ties = ranked.join(best.select("ref_key", "low"), "ref_key").where("rank = low").groupBy("ref_key").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("ext").alias("ext"), F.min("low").alias("rank"))
    kind = F.when(F.col("n") > 1, "ambiguous").when(F.col("rank") == 3, F.concat("ext", F.lit("-yearfuzzy"))).otherwise(F.col("ext"))
    found = ref.select("id", "ref_key").join(ties.select("ref_key", kind.alias("source_kind"), F.when(F.col("n") == 1, F.col("path")).alias("pdf_path")), "ref_key")
    return references.select("id").distinct().join(found.select("id", "pdf_path", "source_kind").distinct(), "id", "left").withColumn("source_kind", F.coalesce("source_kind", F.lit("not-found")))


def find_by_author_year(references: DataFrame, files: DataFrame) -> DataFrame:
    """``id, pdf_path`` by author and year alone, an exact year before one off; null if there is none or more than one."""
    blank = F.lit(None).cast("string")
    found = match_library(references.withColumns({"doi": blank, "title": blank}), files.withColumns({"doi": blank, "title": blank}))
    return found.select("id", "pdf_path")


def attached(references: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records ``pdf-001`` ... of the files, one per reference in its order, and ``references`` with ``pdf_attached``.

    ``found``: id, pdf_path, source_kind as ``match_library`` gives them.
    """
    joined = references.join(found.withColumnsRenamed({"pdf_path": "_path", "source_kind": "_kind"}), "id")
    rows = joined.select(F.col("id").alias("ref_id"), "ref_ord", F.col("_path").alias("pdf_path"), F.col("_kind").alias("source_kind"))
    records = numbered(rows, ["ref_ord", "ref_id"], "pdf-%03d").select("id", "ref_id", "pdf_path", "source_kind")
    return records, joined.withColumn("pdf_attached", F.col("_path").isNotNull()).drop("_path", "_kind")


def attach_verdict(kind: Column, path: Column) -> Column:
    """PASS for a certain file, WARN for none, several, or a year off by one."""
    return F.when(kind == "ambiguous", "WARN").when(kind.endswith("-yearfuzzy"), "WARN").when(path.isNotNull(), "PASS").otherwise("WARN")
