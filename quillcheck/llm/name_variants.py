"""Variant spellings of author names linked to one author.

The distinct typed names of a manuscript are joined by pigeonhole segments (see
``quillcheck.operators.name_candidates``): every name is cut into k + 1
segments, substrings at shifted positions are looked up in an inverted index,
and pairs are verified with banded edit distance and the compatibility of given
names.  Each name then follows its most frequent near spelling; the common one
stands for the author.  A citation belongs to the authors of the nearest entry
names only, so a surname that equals one entry's exactly means that author.

Null and blank names link nothing.  Repeated rows and deliveries of an id are
one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcheck.operators.name_candidates import first_author_name, matching_names
from quillcheck.session import checkpointed


def author_of_names(entries: DataFrame) -> DataFrame:
    """``manuscript_id, name, author`` for every distinct entry name; ``author`` is the leading spelling.

    ``entries`` has ``manuscript_id`` and ``name``.  A name follows the most
    frequent of its near spellings, ties by the name itself, so following never
    turns in a circle.  Leaders are followed until nothing changes; every round
    doubles the steps taken.
    """
    counted = checkpointed(entries.where(F.col("name").isNotNull()).groupBy("manuscript_id", "name").agg(F.count("*").alias("n")))
    near = matching_names(counted, counted, ["manuscript_id"]).where(F.col("probe_name") != F.col("indexed_name"))
    weight = counted.select("manuscript_id", F.col("name").alias("indexed_name"), "n")
    options = near.join(weight, ["manuscript_id", "indexed_name"]).select("manuscript_id", F.col("probe_name").alias("name"), F.col("indexed_name").alias("to"), "n")
    own = counted.select("manuscript_id", "name", F.col("name").alias("to"), "n")
    leader = options.unionByName(own).groupBy("manuscript_id", "name").agg(F.max_by("to", F.struct("n", "to")).alias("author"))
    leader = checkpointed(leader)
    while True:
        onward = leader.where(F.col("name") != F.col("author")).select("manuscript_id", F.col("name").alias("author"), F.col("author").alias("_next"))
        followed = checkpointed(leader.join(onward, ["manuscript_id", "author"], "left"))
        leader = followed.select("manuscript_id", "name", F.coalesce("_next", "author").alias("author"))
        if followed.where(F.col("_next").isNotNull()).isEmpty():
            return leader


def link_variants(entries: DataFrame, citations: DataFrame) -> DataFrame:
    """Pairs ``id_a, id_b`` of records of one author under different spellings.

    ``entries``: id, manuscript_id, first_author_last, authors_raw, ref_year,
    year_suffix; ``citations``: id, manuscript_id, first_author_last, cite_year,
    year_alt, year_suffix, already reduced to those to be linked.  Pairs are an
    entry and a citation whose surnames are written differently, or two entries
    whose surname or full name is.
    """
    base = entries.select("id", "manuscript_id", "first_author_last", "authors_raw", "ref_year", "year_suffix").distinct()
    named = checkpointed(base.withColumn("name", first_author_name("authors_raw", "first_author_last")).drop("authors_raw"))
    author = author_of_names(named.select("id", "manuscript_id", "name").distinct())
    known = named.join(author, ["manuscript_id", "name"])

    cited = citations.select("id", "manuscript_id", F.col("first_author_last").alias("name"), "cite_year", "year_alt", "year_suffix").distinct()
    near = matching_names(cited, author, ["manuscript_id"])
    candidates = near.join(author.withColumnRenamed("name", "indexed_name"), ["manuscript_id", "indexed_name"])
    exact = F.col("indexed_name").startswith(F.col("probe_name")) & ~F.substring("indexed_name", F.length("probe_name") + 1, F.lit(1)).rlike(r"\p{L}")
    candidates = candidates.withColumn("apart", F.when(exact, -1).otherwise(F.col("apart")))
    best = candidates.groupBy("manuscript_id", "probe_name", "author").agg(F.min("apart").alias("apart"))
    rank = Window.partitionBy("manuscript_id", "probe_name")
    best = best.withColumn("_least", F.min("apart").over(rank)).where(F.col("apart") == F.col("_least"))
    best = checkpointed(best.select("manuscript_id", F.col("probe_name").alias("name"), "author"))

    # several authors equally near: the year decides where it can, then the number of their entries
    years = known.select("manuscript_id", "author", F.col("ref_year").alias("_year"), F.coalesce("year_suffix", F.lit("")).alias("_suffix")).distinct()
    linked = cited.join(best, ["manuscript_id", "name"])
    in_year = (F.col("_year") == F.col("cite_year")) | (F.col("_year") == F.col("year_alt"))
    hits = linked.join(years, ["manuscript_id", "author"]).where(in_year & (F.col("_suffix") == F.coalesce("year_suffix", F.lit("")))).select("id", "author").distinct().withColumn("_hit", F.lit(1))
    sizes = known.groupBy("manuscript_id", "author").agg(F.count_distinct("id").alias("_n"))
    linked = linked.join(hits, ["id", "author"], "left").join(sizes, ["manuscript_id", "author"])
    first = Window.partitionBy("id").orderBy(F.desc(F.coalesce("_hit", F.lit(0))), F.desc("_n"))
    linked = linked.withColumn("_rank", F.rank().over(first)).where("_rank = 1").select("id", "manuscript_id", F.col("name").alias("cited_as"), "author").distinct()

    members = known.select(F.col("id").alias("entry_id"), "manuscript_id", "author", "first_author_last", "name").distinct()
    mixed = linked.join(members, ["manuscript_id", "author"]).where(F.col("cited_as") != F.col("first_author_last")).select(F.col("id").alias("x"), F.col("entry_id").alias("y"))
    a, b = members.alias("a"), members.alias("b")
    differ = ~F.col("a.first_author_last").eqNullSafe(F.col("b.first_author_last")) | (F.col("a.name") != F.col("b.name"))
    same = (F.col("a.manuscript_id") == F.col("b.manuscript_id")) & (F.col("a.author") == F.col("b.author")) & (F.col("a.entry_id") < F.col("b.entry_id"))
    entries_pairs = a.join(b, same & differ).select(F.col("a.entry_id").alias("x"), F.col("b.entry_id").alias("y"))
    pairs = mixed.unionByName(entries_pairs)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entries, and of entries and unresolved citations, with one first author under different spellings."""
    citations = spark.read.parquet(f"{sf_dir}/in_text_citations.parquet").where(F.col("ref_id").isNull() | (F.trim("ref_id") == ""))
    return link_variants(spark.read.parquet(f"{sf_dir}/reference_entries.parquet"), citations)
