"""In-text citations: extraction, purpose, and links to reference entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.functions.text import spans

# A citation in parentheses, and one in running text.
SUB_CITATION = r"(?U)^(?:[A-Z][\w\-]+;\s*)?([A-Z][\w\-]+)(?:\s+et\s+al\.|[^,;()]{0,80}?)\s*,\s*(\d{4}[a-z]?)(?:/(\d{4}[a-z]?))?\b"
NARRATIVE = r"(?U)\b([A-Z][\w\-]+)(?:\s+et\s+al\.(?:'s)?|\s+(?:and|&)\s+[A-Z][\w\-]+(?:'s)?|(?:'s)?)?\s*\((\d{4}[a-z]?)(?:/(\d{4}[a-z]?))?\)"
# Words that tell why a work is cited.
FINDING_VERBS = "found showed demonstrated observed indicated revealed concluded documented established noted identified suggested argued proposed claimed posited"
METHOD_VERBS = r"used measured assessed administered applied computed operationalized calculated estimated derived adapted following fitted analyzed\s+with using"
METHOD_NOUNS = "instrument scale questionnaire package software library toolkit procedure protocol method technique algorithm factor item model test estimator tool measure"
THEORY_NOUNS = "theory framework hypothesis principle account paradigm approach"
_SLOT = "array<struct<kind:int,pos:int,sub:int,raw_text:string,shown:string,author:string,y:string,alt:string>>"


def _words(words: str, plural: bool = False) -> str:
    return rf"(?iU)\b(?:{'|'.join(words.split(' '))}){'s?' if plural else ''}\b"


def citation_purpose(context: Column, raw: Column) -> Column:
    """theory, method, finding or background, by the words around a citation."""
    abbreviated = raw.rlike(r"\(([A-Z]{2,}|[A-Z][A-Za-z]+);\s*[A-Z]")
    method = context.rlike(_words(METHOD_VERBS)) & context.rlike(_words(METHOD_NOUNS, plural=True))
    return (
        F.when(F.coalesce(abbreviated, F.lit(False)), "theory-cite").when(F.coalesce(method, F.lit(False)), "method-cite").when(F.coalesce(context.rlike(_words(THEORY_NOUNS)), F.lit(False)), "theory-cite")
        .when(F.coalesce(context.rlike(_words(FINDING_VERBS)), F.lit(False)), "finding-cite").otherwise("background-cite")
    )


def extract_citations(lines: DataFrame) -> DataFrame:
    """Citations of every line that is no block quote: parenthetical ones in order, then narrative ones.

    Columns of ``lines`` except ``text`` are kept.  Null lines have none.
    """
    kept = [c for c in lines.columns if c != "text"]
    text = F.col("text")
    outer = spans(text, r"\(([^()]+)\)")
    per_outer = F.transform(
        outer,
        lambda o: F.transform(
            F.split(F.substring(o["raw"], F.lit(2), F.length(o["raw"]) - 2), ";"),
            lambda part, j: F.struct(
                F.lit(0).alias("kind"), o["start"].alias("pos"), j.alias("sub"), F.concat(F.lit("("), F.trim(part), F.lit(")")).alias("raw_text"), o["raw"].alias("shown"),
                F.regexp_extract(F.trim(part), SUB_CITATION, 1).alias("author"), F.regexp_extract(F.trim(part), SUB_CITATION, 2).alias("y"), F.regexp_extract(F.trim(part), SUB_CITATION, 3).alias("alt"),
            ),
        ),
    )
    parenthetical = F.filter(F.flatten(per_outer), lambda c: c["y"] != "")
    narrative = F.transform(
        spans(text, NARRATIVE),
        lambda s: F.struct(
            F.lit(1).alias("kind"), s["start"].alias("pos"), F.lit(0).alias("sub"), s["raw"].alias("raw_text"), s["raw"].alias("shown"),
            F.regexp_extract(s["raw"], NARRATIVE, 1).alias("author"), F.regexp_extract(s["raw"], NARRATIVE, 2).alias("y"), F.regexp_extract(s["raw"], NARRATIVE, 3).alias("alt"),
        ),
    )
    rows = lines.where(text.isNotNull() & text.contains("(") & ~text.rlike(r"^\s*>"))
    rows = rows.select(*kept, F.trim("text").alias("context_paraphrase"), F.inline(F.concat(parenthetical.cast(_SLOT), narrative.cast(_SLOT))))
    return rows.select(
        *kept, "kind", "pos", "sub", "raw_text", F.when(F.col("kind") == 0, "parenthetical").otherwise("narrative").alias("citation_type"), F.col("author").alias("first_author_last"),
        F.substring("y", 1, 4).cast("int").alias("year"), F.substring("y", 5, 1).alias("year_suffix"), F.when(F.col("alt") != "", F.substring("alt", 1, 4).cast("int")).alias("year_alt"),
        "context_paraphrase", citation_purpose(F.col("context_paraphrase"), F.col("shown")).alias("citation_purpose"),
    )


def link_citations(citations: DataFrame, references: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """``citations`` with ``ref_id``: by author, year and suffix; else the only entry of author and year for a bare year; else the same by the alternative year.

    ``references``: id, ref_ord, first_author_last, year, year_suffix.  Of
    entries with equal keys the last one is meant.  ``scope`` columns must agree
    as well.  Null authors or years link nothing; the right sides have one row
    per key, so no citation is multiplied.
    """
    ref = references.select(*scope, F.lower("first_author_last").alias("_a"), F.col("year").alias("_y"), F.coalesce("year_suffix", F.lit("")).alias("_s"), "id", "ref_ord")
    exact = ref.groupBy(*scope, "_a", "_y", "_s").agg(F.max_by("id", "ref_ord").alias("_id"))
    bare = ref.groupBy(*scope, "_a", "_y").agg(F.count("*").alias("_n"), F.max_by("id", "ref_ord").alias("_id")).where("_n = 1").drop("_n")
    out = citations.drop("ref_id").withColumns({"_a": F.lower("first_author_last"), "_s": F.coalesce("year_suffix", F.lit(""))})
    for name, side, year, with_suffix in (("_1", exact, "year", True), ("_2", bare, "year", False), ("_3", exact, "year_alt", True), ("_4", bare, "year_alt", False)):
        right = side.withColumnRenamed("_id", name).withColumnRenamed("_y", f"{name}y")
        keys = [*scope, "_a", *(["_s"] if with_suffix else [])]
        left = out.withColumn(f"{name}y", F.col(year))
        out = left.join(right, [*keys, f"{name}y"], "left").drop(f"{name}y")
    bare_year = F.col("_s") == ""
    ref_id = F.coalesce("_1", F.when(bare_year, F.col("_2")), "_3", F.when(bare_year, F.col("_4")))
    return out.select(*[c for c in citations.columns if c != "ref_id"], ref_id.alias("ref_id"))


def dangling(linked: DataFrame) -> DataFrame:
    """Citations without an entry."""
    return linked.where(F.col("ref_id").isNull())


def uncited(references: DataFrame, linked: DataFrame) -> DataFrame:
    """Entries that nothing cites."""
    return references.join(linked.where(F.col("ref_id").isNotNull()).select(F.col("ref_id").alias("id")).distinct(), "id", "left_anti")
