"""References to records that do not exist, were deleted or come later, and what hangs on them.

``cascade`` is a fixpoint over a graph of foreign keys.  Its first round finds
the direct orphans: keys that name no record, keys whose record was not live at
the event, and references by author and year that nothing answers.  Children of
orphaned records are inherited orphans; joins down the graph run until a round
adds nothing, only along edges whose parents were added in the round before, and
the lineage is cut by checkpoints in the shared folder.

Where records have lifetimes, deliveries of a key are intervals from
``loaded_at`` to ``deleted_at``.  For an event the question is only whether the
latest end among the deliveries loaded up to it lies behind it, so a running
maximum decides; no event is paired with every delivery.  All events of a key at
one instant have one answer, so distinct instants are judged.  They are cut into
minutes: ends are pre-aggregated per key and minute and carried forward over the
minutes of a key, and within a minute instants are merged.  A key that holds a
third of all rows is thereby divided.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcheck.operators.name_candidates import exact_key, first_author_name, matching_names
from quillcheck.session import checkpointed

#: End of a delivery that was never deleted.
FOREVER = "9999-12-31 00:00:00"
#: Microseconds of a minute.
MINUTE = 60_000_000


def key_of(column: str) -> Column:
    """Keys compare without case and outer spaces; blank ones are none."""
    return F.nullif(F.lower(F.btrim(F.col(column), F.lit(" \t\r\n "))), F.lit(""))


def late_or_missing(events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """``events`` whose key has no live delivery at their time, with ``reason``.

    ``events``: key, at, and any other columns; ``deliveries``: key, loaded_at,
    deleted_at.  ``missing`` if no delivery has the key, ``deleted`` if one was
    loaded at or before the event, else ``late``.  An event without a time sees
    nothing as loaded before it.  A delivery without ``loaded_at`` makes its key
    known but is never live.  Null keys are no events.
    """
    ends = deliveries.where(F.col("key").isNotNull()).groupBy("key", F.col("loaded_at").alias("at")).agg(F.max(F.coalesce("deleted_at", F.lit(FOREVER).cast("timestamp"))).alias("until"))
    asked = events.where(F.col("key").isNotNull()).select("key", "at").distinct()
    points = ends.withColumn("asked", F.lit(False)).unionByName(asked.select("key", "at", F.lit(None).cast("timestamp").alias("until"), F.lit(True).alias("asked")))
    points = points.withColumn("cut", F.floor(F.unix_micros("at") / F.lit(MINUTE)))

    cuts = points.groupBy("key", "cut").agg(F.max("until").alias("cut_until"), F.max(~F.col("asked")).alias("cut_known"), F.max("asked").alias("cut_asked"))
    earlier = Window.partitionBy("key").orderBy(F.col("cut").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.max(F.when(F.col("cut").isNotNull(), F.col("cut_until"))).over(earlier)
    carry = cuts.select(F.col("key").alias("_k"), F.col("cut").alias("_c"), "cut_asked", carried.alias("before"), F.max("cut_known").over(Window.partitionBy("key")).alias("known")).where("cut_asked")

    within = Window.partitionBy("key", "cut").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = points.withColumn("here", F.when(F.col("cut").isNotNull(), F.max("until").over(within))).where("asked")
    joined = placed.join(carry, (F.col("key") == F.col("_k")) & F.col("cut").eqNullSafe(F.col("_c")))
    until = F.greatest("before", "here")
    orphaned = joined.where(until.isNull() | (until <= F.col("at")) | F.col("at").isNull())
    reason = F.when(~F.col("known"), "missing").when(until.isNotNull() & F.col("at").isNotNull(), "deleted").otherwise("late")
    answers = orphaned.select(F.col("key").alias("_k"), F.col("at").alias("_at"), reason.alias("reason"))
    return events.join(answers, (F.col("key") == F.col("_k")) & F.col("at").eqNullSafe(F.col("_at"))).drop("_k", "_at")


def period(at: str) -> Column:
    """Month ``YYYY-MM`` of a time in UTC, whatever the session's zone."""
    zone = F.current_timezone()
    return F.date_format(F.convert_timezone(zone, F.lit("UTC"), F.col(at).cast("timestamp_ntz")), "yyyy-MM")


def unmatched_citations(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """Citations without a key that no entry of their manuscript answers by author, year and suffix.

    Surnames alone with equal letters are matched first; only what is left goes
    through the search for variant spellings, within the same manuscript, year and suffix.
    A citation without author, year or manuscript is answered by nothing.
    """
    scope = ["manuscript_id", "year", "suffix"]
    suffix = F.lower(F.coalesce(F.trim("year_suffix"), F.lit("")))
    asked = citations.select(
        "id", "manuscript_id", F.col("first_author_last").alias("name"), suffix.alias("suffix"), F.explode(F.array_distinct(F.array("cite_year", F.coalesce("year_alt", "cite_year")))).alias("year")
    )
    held = entries.select("manuscript_id", F.col("ref_year").alias("year"), suffix.alias("suffix"), "first_author_last", "authors_raw").distinct()
    direct = held.select(*scope, exact_key(F.col("first_author_last")).alias("letters")).where("letters <> ''").distinct()
    asked = asked.withColumn("letters", F.when(~F.contains("name", F.lit(",")), exact_key(F.col("name"))))  # a given name is left to the search
    answered = asked.join(direct, [*scope, "letters"], "left_semi").select("id").distinct()
    rest = asked.join(answered, ["id"], "left_anti")
    wanted = rest.select(*scope).distinct()
    named = held.join(wanted, scope, "left_semi").select(*scope, first_author_name("authors_raw", "first_author_last").alias("name"))
    near = matching_names(rest, named, scope).select(*scope, F.col("probe_name").alias("name")).distinct()
    also = rest.join(near, [*scope, "name"], "left_semi").select("id").distinct()
    return citations.join(answered.unionByName(also), ["id"], "left_anti")


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.id``; a null or blank value refers to nothing.

    ``lifetime``: the parent's records are live from loaded_at to deleted_at
    only.  ``by_author``: a child whose ``column`` is blank refers by its first
    author and year to a record of the same manuscript.
    """

    child: str
    column: str
    parent: str
    lifetime: bool = False
    by_author: bool = False


#: References to entries, the ones that p5_found reports.
REFERENCES = (ForeignKey("in_text_citations", "ref_id", "reference_entries", lifetime=True, by_author=True), ForeignKey("source_pdfs", "ref_id", "reference_entries", lifetime=True))
#: Foreign keys of the reference domain.
GRAPH = (
    ForeignKey("numerical_claims", "manuscript_id", "manuscripts"),
    ForeignKey("reference_entries", "manuscript_id", "manuscripts"),
    ForeignKey("in_text_citations", "manuscript_id", "manuscripts"),
    *REFERENCES,
    ForeignKey("paraphrase_matches", "citation_id", "in_text_citations"),
    ForeignKey("paraphrase_matches", "ref_id", "reference_entries"),
)
#: When a record refers; records of other tables take the month of the orphan they hang on.
EVENT_TIMES = {"numerical_claims": "extracted_at", "reference_entries": "loaded_at", "in_text_citations": "cited_at", "source_pdfs": "extracted_at"}
ORPHAN = ["record_table", "record_id", "via", "reason", "period"]


def _children(tables: dict[str, DataFrame], edge: ForeignKey) -> DataFrame:
    """``record_table, record_id, via, at`` and the ``key`` of the records that refer along an edge."""
    time = EVENT_TIMES.get(edge.child)
    at = F.col(time) if time in tables[edge.child].columns else F.lit(None).cast("timestamp")
    rows = tables[edge.child].select(F.lit(edge.child).alias("record_table"), F.col("id").alias("record_id"), F.lit(edge.column).alias("via"), at.alias("at"), key_of(edge.column).alias("key"))
    return rows.where("key is not null")


def direct_orphans(tables: dict[str, DataFrame], graph: tuple[ForeignKey, ...]) -> DataFrame:
    """``record_table, record_id, via, reason, period``: the first round of ``cascade``.

    Edges to parents with lifetimes are judged together per parent, the others
    by anti-joins; ``via`` is the column that refers, ``first_author_last``
    where a reference is by author.
    """
    parts: list[DataFrame] = []
    for parent in dict.fromkeys(e.parent for e in graph if e.lifetime):
        events: DataFrame | None = None
        for e in graph:
            if e.lifetime and e.parent == parent:
                part = _children(tables, e)
                events = part if events is None else events.unionByName(part)
        deliveries = tables[parent].select(key_of("id").alias("key"), "loaded_at", "deleted_at")
        parts.append(late_or_missing(events, deliveries).select(*ORPHAN[:4], period("at").alias("period")))
    for e in graph:
        if not e.lifetime:
            keys = tables[e.parent].select(key_of("id").alias("key")).where("key is not null").distinct()
            parts.append(_children(tables, e).join(keys, "key", "left_anti").select(*ORPHAN[:3], F.lit("missing").alias("reason"), period("at").alias("period")))
        if e.by_author:
            blank = tables[e.child].where(key_of(e.column).isNull()).select("id", "manuscript_id", "first_author_last", "cite_year", "year_suffix", "year_alt", "cited_at")
            unanswered = unmatched_citations(blank, tables[e.parent])
            parts.append(unanswered.select(F.lit(e.child).alias("record_table"), F.col("id").alias("record_id"), F.lit("first_author_last").alias("via"), F.lit("missing").alias("reason"), period("cited_at").alias("period")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def cascade(tables: dict[str, DataFrame], graph: tuple[ForeignKey, ...] = GRAPH) -> DataFrame:
    """``record_table, record_id, via, kind, reason, period`` of direct and inherited orphans.

    A record is a direct orphan if one of its references has nothing to refer
    to (``direct_orphans``); it is an inherited one, with the reason of its
    parent, if it names an orphan.  A record that is both is direct.  Each
    reason, month and column of a record is a row.  Rounds of joins run until
    no record is added; there are at most as many as the graph has levels,
    unless keys form a cycle, where they end because every round must add a
    record.  A graph without edges is an error.
    """
    if not graph:
        raise ValueError("the graph has no foreign key")
    found = direct_orphans(tables, graph).withColumn("kind", F.lit("direct"))
    edges = [e for e in graph if e.parent in {f.child for f in graph}]
    if not edges:  # nothing can hang on what was found
        return found.select(*ORPHAN[:3], "kind", *ORPHAN[3:])
    found = checkpointed(found)
    fresh = found
    while True:
        touched = {r[0] for r in fresh.select("record_table").distinct().collect()}  # names of tables
        added: DataFrame | None = None
        for e in edges:
            if e.parent in touched:
                parents = fresh.where(F.col("record_table") == e.parent).select(key_of("record_id").alias("key"), "reason", F.col("period").alias("parent_period")).where("key is not null").distinct()
                part = _children(tables, e).join(parents, "key").select(*ORPHAN[:4], F.coalesce(period("at"), "parent_period").alias("period"))
                added = part if added is None else added.unionByName(part)
        if added is None:
            return found.select(*ORPHAN[:3], "kind", *ORPHAN[3:])
        known = found.select("record_table", "record_id").distinct()
        fresh = checkpointed(added.distinct().join(known, ["record_table", "record_id"], "left_anti").withColumn("kind", F.lit("inherited")))
        found = found.unionByName(fresh)


def _tables(spark: SparkSession, sf_dir: str, graph: tuple[ForeignKey, ...]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in {e.child for e in graph} | {e.parent for e in graph}}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations and library files whose reference does not exist, was deleted or comes later, with the month: the cascade along the references to entries."""
    found = cascade(_tables(spark, sf_dir, REFERENCES), REFERENCES)
    return found.select("record_table", "record_id", "reason", "period").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return p5_found(spark, sf_dir).groupBy("record_table", "period", "reason").agg(F.count("*").alias("n_records"))


def p5_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans down the whole graph, one row per record, column, reason and month."""
    return cascade(_tables(spark, sf_dir, GRAPH), GRAPH)


def p5_key_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same along keys alone, without references by author."""
    graph = tuple(replace(e, by_author=False) for e in GRAPH)
    return cascade(_tables(spark, sf_dir, graph), graph)
