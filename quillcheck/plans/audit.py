"""The whole audit: ingest, extract, decide, link, attach, compare, gate, report."""

from __future__ import annotations

import argparse
import os
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.operators import citations as cit
from quillcheck.operators import gates, paraphrase
from quillcheck.operators import references as ref
from quillcheck.operators.claims import extract_claims, number_claims, text_lines, without_duplicate_manuscripts
from quillcheck.operators.decide import decide
from quillcheck.operators.library import attach_verdict, attached, match_library
from quillcheck.operators.truth import build_truth, has_usable_truth, merge_summary, summary_labels, summary_rows
from quillcheck.schemas import RESULT
from quillcheck.session import checkpointed, collect_bounded, numbered
from quillcheck.sources.config import AuditConfig, load_config
from quillcheck.sources.files import expand_specs, library, manifest, manuscripts, pdf_pages, read_texts, write_jsonl
from quillcheck.sources.providers import classifier_of, resolve, scorer_of

#: Files of one library that references are attached to.
MAX_FILES = 100_000


@dataclass
class Audit:
    """The frames of one run."""

    manuscripts: DataFrame
    claims: DataFrame
    references: DataFrame | None
    citations: DataFrame | None
    files: DataFrame | None
    matches: DataFrame | None
    results: DataFrame
    truth: DataFrame | None = None


def _results(rows: DataFrame, order: int, target: str, verifier: str, target_id: Column, status: Column, evidence: Column, **more: Column) -> DataFrame:
    values = {"target_type": F.lit(target), "target_id": target_id, "verifier": F.lit(verifier), "status": status, "evidence": evidence} | more
    fields = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT if f.name != "id"]
    return rows.select(F.lit(order).alias("src"), *fields)


#: ``path, page_no, text`` of the PDF files at some paths.
PageReader = Callable[[SparkSession, list[str]], DataFrame]


def source_texts(spark: SparkSession, paths: list[str], pages: PageReader = pdf_pages) -> DataFrame:
    """``path, text`` of markdown files and of the first pages of PDF files; citations give no page hint."""
    marked = [p for p in paths if p.lower().endswith(".md")]
    printed = [p for p in paths if p.lower().endswith(".pdf")]
    texts = read_texts(spark, marked).select("path", "text")
    hints = spark.createDataFrame([(p, None) for p in printed], "path string, page_hint int")
    return texts.unionByName(paraphrase.page_slice(pages(spark, printed), hints)) if printed else texts


def run(
    spark: SparkSession, config: AuditConfig, phase: int = 1, scorer: paraphrase.Scorer | None = paraphrase.lexical_score, classifier: paraphrase.Classifier | None = None, pages: PageReader = pdf_pages
) -> Audit:
    """All frames of an audit; ids of results follow source and natural order.

    Without a ``scorer`` nothing is scored and every citation that needs a score
    fails; without a ``classifier`` purposes are those of the heuristic;
    ``pages`` reads PDF files.  What goes wrong in phase 2 is a failed result
    and leaves the results of phase 1.
    """
    texts = read_texts(spark, expand_specs(list(config.manuscripts)))
    records = manuscripts(texts)
    source = records.select(F.col("id").alias("manuscript_id"), F.col("ord").alias("ms_ord"), "section", "text")
    lines = checkpointed(without_duplicate_manuscripts(text_lines(source)))
    claims = checkpointed(number_claims(extract_claims(lines)))
    parts: list[DataFrame] = []
    truth: DataFrame | None = None

    if config.stats:
        stats = text_lines(read_texts(spark, [config.stats]).select("text"), keep=())
        aliases = spark.createDataFrame([*config.aliases.items(), ("", None)], "label string, dv string").where("dv is not null")
        alpha = spark.createDataFrame([*config.rules.alpha_values.items()] or [("", 0.0)], "dv string, alpha double").where("dv <> ''")
        truth = build_truth(stats, config.headings, aliases, alpha)
        parts.append(gates.truth_gate(claims, has_usable_truth(truth)).drop("id").withColumn("src", F.lit(0)))
        if config.summary_stats:
            summary = text_lines(read_texts(spark, [config.summary_stats]).select("text"), keep=())
            truth = merge_summary(truth, summary_rows(summary, config.summary_headings, spark))
            if config.summary_labels:
                truth = merge_summary(truth, summary_labels(summary, list(config.summary_labels), aliases))
        parts.append(gates.coverage_gate(claims, "numerical-claims").drop("id").withColumn("src", F.lit(0)))
        truth = checkpointed(truth)
        decided = decide(claims, truth, config.rules)
        parts.append(_results(decided, 1, "numerical-claim", "recompute", F.col("id"), F.col("status"), F.col("evidence"), expected_value=F.col("expected_value"), computed_value=F.col("computed_value"), delta=F.col("delta"), matched_dv=F.col("matched_dv")))

    entries = linked = files = matches = None
    if config.references:
        entries = checkpointed(ref.parse_references(ref.reference_chunks(read_texts(spark, [config.references]).select("text"))))
        parts.append(gates.coverage_gate(entries, "references").drop("id").withColumn("src", F.lit(0)))
        found = cit.extract_citations(lines.where(F.col("section") != "refs"))
        found = numbered(found, ["ms_ord", "line_no", "kind", "pos", "sub"], "cite-%04d")
        linked = checkpointed(cit.link_citations(found, entries))
        if config.library and os.path.isdir(config.library):
            files = match_library(entries, library(spark, config.library))
        else:
            files = entries.select("id", F.lit(None).cast("string").alias("pdf_path"), F.lit("not-found").alias("source_kind"))
        files, entries = attached(entries, files)
        files, entries = checkpointed(files), checkpointed(entries)
        parts.append(_results(entries, 2, "reference-entry", "doi-audit", F.col("id"), ref.doi_verdict(F.col("status"), F.col("doi")), F.col("status")))
        parts.append(_results(cit.dangling(linked), 3, "in-text-citation", "citation-graph", F.col("id"), F.lit("FAIL"), F.col("raw_text")))
        parts.append(_results(cit.uncited(entries, linked), 4, "reference-entry", "citation-graph", F.col("id"), F.lit("WARN"), F.lit("never cited")))
        parts.append(_results(files, 5, "reference-entry", "pdf-attach", F.col("ref_id"), attach_verdict(F.col("source_kind"), F.col("pdf_path")), F.col("source_kind")))
        if phase == 2:
            try:
                matches = _matches(spark, linked, files, scorer, classifier, pages)
                parts.append(_results(matches, 6, "paraphrase-match", "paraphrase", F.col("citation_id"), F.col("status"), F.col("citation_purpose"), computed_value=F.col("score")))
                parts.append(gates.scored_gate(matches).drop("id").withColumn("src", F.lit(7)))
            except (OSError, ValueError, RuntimeError, PySparkException, Py4JJavaError) as e:
                matches = None
                parts.append(gates.error_gate(spark, _reason(e)).drop("id").withColumn("src", F.lit(7)))
    elif phase == 2:
        parts.append(gates.error_gate(spark, "no references are configured").drop("id").withColumn("src", F.lit(7)))

    empty = spark.createDataFrame([], RESULT).drop("id").withColumn("src", F.lit(0))
    results = empty
    for p in parts:
        results = results.unionByName(p)
    results = numbered(results, ["src", "target_id", "evidence"], "vr-%04d").select("id", *[c for c in results.columns])
    return Audit(records, claims, entries, linked, files, matches, results, truth)


def _reason(error: Exception) -> str:
    """The line of an error that names its cause; errors of executors come wrapped in traces."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()] or [type(error).__name__]
    return next((line for line in lines if re.match(r"\w*(?:Error|Exception): ", line)), lines[0])[:300]


def _matches(spark: SparkSession, linked: DataFrame, files: DataFrame, scorer: paraphrase.Scorer | None, classifier: paraphrase.Classifier | None, pages: PageReader) -> DataFrame:
    """The citations of attached files compared with them, computed at once so that errors show here."""
    paths = [r[0] for r in collect_bounded(files.where("pdf_path is not null").select("pdf_path").distinct(), MAX_FILES, "the attached files")]
    asked = paraphrase.reclassified(linked, classifier) if classifier else linked
    return checkpointed(paraphrase.match_paraphrases(asked, files, source_texts(spark, paths, pages), scorer or (lambda p, q: None)))


def summary_text(audit: Audit, config: AuditConfig) -> str:
    """The report of one run in markdown."""
    r = audit.results.withColumn("ord", F.struct("src", "target_id"))
    rate = gates.pass_rate(r).first()
    broken = gates.fail_breakdown(r).first()
    out = [f"# Audit of {config.project}", "", f"{rate['n']} results, {rate['pass_rate']:.1f} % pass.", "", "## Status", ""]
    out += [f"- {x['status']}: {x['n']}" for x in gates.ordered_counts(r, "status", "ord").collect()]
    out += ["", "## Claims by type", "", *[f"- {x['claim_type']}: {x['n']}" for x in gates.ordered_counts(audit.claims, "claim_type", "id").collect()]]
    out += ["", "## Measures", "", *[f"- {x['matched_dv']}: {x['n']}" for x in gates.measure_counts(r).orderBy("matched_dv").collect()]]
    if audit.truth is not None:
        covered = gates.truth_coverage(audit.truth).first()
        out += ["", "## Ground truth", "", f"{covered['n_measures']} measures: {covered['measures']}" if covered else "no measures"]
    if audit.files is not None:
        out += ["", "## Library", "", *[f"- {x['source_kind']}: {x['n']}" for x in gates.ordered_counts(audit.files, "source_kind", "id").collect()]]
    if audit.matches is not None:
        out += ["", "## Paraphrases", "", *[f"- {x['status']}: {x['n']}" for x in gates.ordered_counts(audit.matches, "status", "citation_id").collect()]]
    out += ["", "## To be reviewed", "", *[f"- {x['claim_type']}: {x['n']}" for x in gates.manual_by_type(r, audit.claims).orderBy(F.desc("n"), "claim_type").collect()]]
    out += ["", "## Failures", "", f"{broken['n_fail']}: {broken['n_numerical']} numerical, {broken['n_citation']} of citations, {broken['n_other']} other", ""]
    out += [f"- {x['target_type']} {x['target_id']}: {x['evidence']}" for x in gates.fail_detail(r, "ord").collect()]
    if broken["n_fail"] > 20:
        out.append(f"- ... and {broken['n_fail'] - 20} more")
    return "\n".join(out) + "\n"


def main(argv: list[str] | None = None) -> int:
    """Command line: 0 if nothing failed, 1 if something did, 2 for wrong usage."""
    a = argparse.ArgumentParser(prog="quillcheck")
    a.add_argument("--config")
    a.add_argument("--manuscript", action="append", default=[])
    for name in ("--references", "--stats", "--summary-stats", "--reports-dir", "--output-summary", "--check-summary-length"):
        a.add_argument(name)
    a.add_argument("--phase", type=int, choices=(1, 2), default=1)
    args = a.parse_args(argv)
    if args.config and not os.path.isfile(args.config):
        print(f"no such configuration: {args.config}", file=sys.stderr)
        return 2
    config = load_config(args.config) if args.config else AuditConfig()
    given = {k: os.path.abspath(v) for k, v in (("references", args.references), ("stats", args.stats), ("summary_stats", args.summary_stats), ("reports_dir", args.reports_dir)) if v}
    config = replace(config, **given, **({"manuscripts": tuple(args.manuscript)} if args.manuscript else {}))
    unmatched = [m for m in config.manuscripts if not expand_specs([m])]
    if unmatched:
        print(f"no file matches: {', '.join(unmatched)}", file=sys.stderr)
        return 2
    if config.library and not os.path.isdir(config.library):
        print(f"no such library folder: {config.library}", file=sys.stderr)
        return 2
    try:
        provider = resolve(config.scorer, config.scorer_argv, config.scorer_timeout)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    paths = expand_specs(list(config.manuscripts))
    wrong = [p for p in [*paths, config.references, config.stats, config.summary_stats] if p and not os.path.isfile(p)]
    if not paths or wrong:
        print(f"missing: {', '.join(wrong) or 'manuscripts'}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quillcheck").getOrCreate()
    audit = run(spark, config, args.phase, scorer_of(provider, config.scorer), classifier_of(provider))
    short = manifest(audit.manuscripts, config.project, config.project)
    folder = args.reports_dir or os.path.join(config.reports_dir, short.first()["manifest_sha256_prefix8"])
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/manifest.json", "w", encoding="utf-8") as f:
        f.write(short.toJSON().first() + "\n")  # one record with the files of this audit
    for name, frame in (("claims", audit.claims), ("references", audit.references), ("citations", audit.citations), ("source_pdfs", audit.files), ("paraphrase_matches", audit.matches), ("verifications", audit.results)):
        if frame is not None:
            write_jsonl(frame, f"{folder}/{name}.jsonl")
    text = summary_text(audit, config)
    with open(args.output_summary or f"{folder}/summary.md", "w", encoding="utf-8") as f:
        f.write(text)
    print(text)
    code = gates.exit_code(audit.results).first()["exit_code"]
    if args.check_summary_length:
        exists = os.path.isfile(args.check_summary_length)
        page = read_texts(spark, [args.check_summary_length]) if exists else spark.createDataFrame([(None,)], "text string")
        code = max(code, int(gates.page_check(page).first()["status"] == "FAIL"))
    return code


if __name__ == "__main__":
    sys.exit(main())
