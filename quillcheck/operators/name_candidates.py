"""Join of typed names through an inverted index of segments, verified by edit distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillcheck.functions import names
from quillcheck.session import shuffled


@F.pandas_udf(T.ArrayType(T.StringType()))
def index_entries(column: pd.Series) -> pd.Series:
    """Index entries of each typed name."""
    return pd.Series([names.name_index(n) for n in column], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def probe_entries(column: pd.Series) -> pd.Series:
    """Lookups of each typed name."""
    return pd.Series([names.name_probe(n) for n in column], dtype=object)


@F.pandas_udf(T.IntegerType())
def names_apart(left: pd.Series, right: pd.Series) -> pd.Series:
    """Distance of two typed names that can denote the same author, else null."""
    return pd.Series([names.compare(a, b) for a, b in zip(left, right, strict=True)], dtype="Int32")


@F.pandas_udf(T.StringType())
def first_author_name(authors: pd.Series, last: pd.Series) -> pd.Series:
    """The first author's name as a reference entry writes it."""
    return pd.Series([names.first_author(a, f) for a, f in zip(authors, last, strict=True)], dtype=object)


def exact_key(name: Column) -> Column:
    """Letters of a name alone, lower-cased, without its given part; equal keys need no search."""
    return F.lower(F.regexp_replace(F.split_part(name, F.lit(","), F.lit(1)), r"[^\p{L}]", ""))


def matching_names(probes: DataFrame, indexed: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs ``scope, probe_name, indexed_name, apart`` of names that can denote the same author.

    Both inputs have ``scope`` columns and ``name``.  Their distinct names are
    spread over hashed index entries that contain the scope, so one large scope
    is divided over as many keys as it has segments; only pairs that share an
    entry are compared.  What is shuffled per entry are two hashes, of the entry
    and of the name; names that share a hash are told apart when the pairs get
    their names back and are verified.  Null and blank names match nothing.
    """
    present = F.col("name").isNotNull() & (F.trim("name") != "")
    hashed = [F.col(c) for c in scope]

    def sides(names_: DataFrame, role: str, entries) -> tuple[DataFrame, DataFrame]:
        # few rows become many entries here
        rows = shuffled(names_.where(present).select(*scope, "name").distinct())
        rows = rows.select(*[F.col(c).alias(f"_{role}_{c}") for c in scope], F.col("name").alias(f"{role}_name"), F.xxhash64(*hashed, "name").alias(f"_{role}"), *hashed)
        keyed = rows.select(f"_{role}", *hashed, F.explode(entries(f"{role}_name")).alias("_entry")).select(f"_{role}", F.xxhash64(*hashed, "_entry").alias("_key"))
        return rows.drop(*scope), keyed

    left, keyed_left = sides(probes, "probe", probe_entries)
    right, keyed_right = sides(indexed, "indexed", index_entries)
    pairs = keyed_left.join(keyed_right, "_key").select("_probe", "_indexed").distinct()
    named = pairs.join(left, "_probe").join(right, "_indexed")
    for c in scope:
        named = named.where(F.col(f"_probe_{c}").eqNullSafe(F.col(f"_indexed_{c}")))
    named = named.select(*[F.col(f"_probe_{c}").alias(c) for c in scope], "probe_name", "indexed_name")
    return named.withColumn("apart", names_apart("probe_name", "indexed_name")).where(F.col("apart").isNotNull())
