"""Named queries of the core library over the domain tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.functions.text import half_ulp_equal, lines_of, printed_digits, word_count
from quillcheck.operators import citations as cit
from quillcheck.operators import gates, paraphrase
from quillcheck.operators import references as ref
from quillcheck.operators.claims import PATTERNS, ClaimPattern, extract_claims
from quillcheck.operators.decide import DecisionRules, decide, infer_measure
from quillcheck.operators.orphans import EVENT_TIMES, GRAPH, p5_cascade, p5_found, p5_key_cascade, p5_report
from quillcheck.operators.rejects import p4_found, p4_loaded, p4_problems
from quillcheck.operators.truth import has_usable_truth, is_usable, p_rows, table_rows
from quillcheck.plans import record_queries
from quillcheck.session import collect_bounded, shuffled
from quillcheck.sources.files import section_of

Query = Callable[[SparkSession, str], DataFrame]
MAX_CATALOG = 100_000


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).distinct()


# --- claims ---------------------------------------------------------------


def _claims_of(pattern: ClaimPattern) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _table(spark, sf_dir, "numerical_claims", F.col("id").alias("claim_id"), F.col("context_snippet").alias("text"))
        return extract_claims(shuffled(lines), (pattern,)).select("claim_id", "raw_text", "start_pos", "end_pos")

    return query


def _re2(pattern: str) -> str:
    return pattern.replace(r"\s", r"[\s\x0b\x{85}\p{Z}]").replace(r"\d", r"\p{Nd}")


def _claims_sql(pattern: ClaimPattern) -> str:
    rx = _re2(pattern.pattern).replace("'", "''")
    return f"""
    WITH t AS (SELECT DISTINCT id, context_snippet s FROM numerical_claims WHERE regexp_matches(context_snippet, '{rx}')),
    m AS (SELECT id, regexp_extract_all(s, '{rx}') m, regexp_split_to_array(s, '{rx}') g FROM t),
    u AS (SELECT id, m, g, unnest(range(1, len(m) + 1)) k FROM m),
    p AS (SELECT id, m[k] raw, list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) s FROM u)
    SELECT id AS claim_id, raw AS raw_text, CAST(s AS INTEGER) AS start_pos, CAST(s + length(raw) AS INTEGER) AS end_pos FROM p"""


def claim_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "numerical_claims", F.col("id").alias("claim_id"), F.col("context_snippet").alias("text"))
    return extract_claims(shuffled(lines)).groupBy("claim_type").agg(F.count("*").alias("n"))


# --- decisions --------------------------------------------------------------


def _rules(spark: SparkSession, sf_dir: str) -> DecisionRules:
    catalog = collect_bounded(_table(spark, sf_dir, "dv_catalog", "dv", "label", "label_ko").where("dv is not null"), MAX_CATALOG, "the catalog")
    words = tuple(sorted((r["dv"], k) for r in catalog for k in (r["label"], r["label_ko"]) if k))
    return DecisionRules(dv_keywords=words, condition_labels=("HQ", "LQ"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per measure: the latest usable one."""
    rows = spark.read.parquet(f"{sf_dir}/gt_rows.parquet").where(is_usable() & F.col("dv").isNotNull())
    fields = [c for c in rows.columns if c not in ("dv", "manuscript_id", "loaded_at")]
    return rows.groupBy("dv").agg(F.max_by(F.struct(*fields), F.struct("loaded_at", "manuscript_id")).alias("t")).select("dv", "t.*")


TRUTH_SQL = """usable AS (SELECT * FROM gt_rows WHERE dv IS NOT NULL AND coalesce(len(validation_errors), 0) = 0 AND coalesce(parity, 'unknown') <> '✗'
      AND coalesce(f, df1, df2, p_r, p_scipy, beta, se, ci_low, ci_high, v, p_wil) IS NOT NULL),
    truth AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY dv ORDER BY loaded_at DESC NULLS LAST, manuscript_id DESC NULLS LAST) = 1),
    words AS (SELECT dv, unnest([lower(label), lower(label_ko)]) w FROM dv_catalog),
    c AS (SELECT DISTINCT id, claim_type, parsed_value, raw_text, context_snippet, start_pos, end_pos FROM numerical_claims),
    i AS (SELECT c.id, list_distinct(list(words.dv)) dvs FROM c JOIN words ON contains(lower(coalesce(c.context_snippet, c.raw_text, '') || ' ' || coalesce(c.raw_text, '')), words.w) GROUP BY c.id),
    j AS (SELECT c.*, CASE WHEN len(i.dvs) = 1 THEN i.dvs[1] END dv FROM c LEFT JOIN i USING (id))"""


def _decided(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    claims = spark.read.parquet(f"{sf_dir}/numerical_claims.parquet")
    claims = claims.select("id", "claim_type", "parsed_value", "raw_text", "context_snippet", "start_pos", "end_pos", "raw_values").dropDuplicates(["id"])
    claims = claims.where(F.col("claim_type").isin(*types)) if types else claims
    return decide(shuffled(claims), _truth(spark, sf_dir), _rules(spark, sf_dir))


def decide_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F statistics and plain numbers."""
    rows = _decided(spark, sf_dir, "F_stat", "beta", "effect_dz", "V_wilcoxon", "r_corr", "p_adj", "eta_squared", "rho", "IRR")
    return rows.select(F.col("id").alias("claim_id"), "status", "matched_dv")


GENERIC_SQL = f"""WITH {TRUTH_SQL},
    k AS (SELECT j.*, t.dv tdv, t.df1 tdf1, t.df2 tdf2,
        CASE j.claim_type WHEN 'F_stat' THEN t.f WHEN 'beta' THEN t.beta WHEN 'effect_dz' THEN t.dz WHEN 'V_wilcoxon' THEN t.v WHEN 'r_corr' THEN t.r END expected,
        CASE j.claim_type WHEN 'F_stat' THEN parsed_value.f WHEN 'beta' THEN parsed_value.beta WHEN 'effect_dz' THEN parsed_value.dz WHEN 'V_wilcoxon' THEN parsed_value.v WHEN 'r_corr' THEN parsed_value.r END observed,
        length(regexp_extract(coalesce(raw_text, ''), '\\.(\\d+)', 1)) d
      FROM j LEFT JOIN truth t ON j.dv = t.dv WHERE claim_type IN ('F_stat', 'beta', 'effect_dz', 'V_wilcoxon', 'r_corr', 'p_adj', 'eta_squared', 'rho', 'IRR'))
    SELECT id AS claim_id, CASE WHEN parsed_value IS NULL THEN 'WARN' WHEN tdv IS NULL THEN 'MANUAL'
        WHEN claim_type = 'F_stat' AND (coalesce(parsed_value.df1 <> tdf1, false) OR coalesce(parsed_value.df2 <> tdf2, false)) THEN 'FAIL'
        WHEN claim_type IN ('p_adj', 'eta_squared', 'rho', 'IRR') THEN 'MANUAL' WHEN expected IS NULL OR observed IS NULL THEN 'WARN'
        WHEN abs(observed - expected) <= CASE WHEN d > 0 THEN pow(10.0, -d) * 0.5 + 1e-9 ELSE 1e-9 END THEN 'PASS' ELSE 'FAIL' END AS status,
      CASE WHEN parsed_value IS NOT NULL AND tdv IS NOT NULL THEN dv END AS matched_dv FROM k"""


def decide_p_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inequalities and unlocated or unknown claims stay manual; the rest is routed by the nearer test."""
    return _decided(spark, sf_dir, "p_value").groupBy("status").agg(F.count("*").alias("n"))


P_VALUE_SQL = rf"""WITH {TRUTH_SQL},
    k AS (SELECT j.id, j.parsed_value v, t.dv tdv, t.p_r, t.p_wil, lower(coalesce(context_snippet, raw_text, '')) low, coalesce(context_snippet, raw_text, '') sn, coalesce(raw_text, '') raw, start_pos s, end_pos e
      FROM j LEFT JOIN truth t ON j.dv = t.dv WHERE claim_type = 'p_value'),
    l AS (SELECT *, CASE WHEN s IS NULL AND e IS NULL THEN CASE WHEN raw <> '' AND (length(sn) - length(replace(sn, raw, ''))) = length(raw) THEN instr(sn, raw) - 1 END
        WHEN s >= 0 AND e <= length(sn) AND s < e AND substr(sn, s + 1, e - s) = raw THEN s END st FROM k),
    m AS (SELECT *, lower(substr(sn, 1, st + length(raw))) scope FROM l),
    r AS (SELECT *, length(regexp_extract(raw, '\.(\d+)', 1)) d,
        greatest(length(regexp_extract(scope, '(?s)^(.*)wilcoxon', 1)) + CASE WHEN contains(scope, 'wilcoxon') THEN 0 ELSE -1 END, length(regexp_extract(scope, '(?s)^(.*)\*v\*', 1)) + CASE WHEN contains(scope, '*v*') THEN 0 ELSE -1 END,
          CASE WHEN regexp_matches(scope, '(?:^|[^a-z])v\s*=') THEN length(regexp_extract(scope, '(?s)^((?:.*[^a-z])?)v\s*=', 1)) ELSE -1 END) w,
        greatest(length(regexp_extract(scope, '(?s)^(.*)\*f\*', 1)) + CASE WHEN contains(scope, '*f*') THEN 0 ELSE -1 END,
          CASE WHEN regexp_matches(scope, '(?:^|[^a-z])f\s*\(') THEN length(regexp_extract(scope, '(?s)^((?:.*[^a-z])?)f\s*\(', 1)) ELSE -1 END) f FROM m),
    x AS (SELECT *, CASE WHEN w > f THEN p_wil ELSE p_r END expected FROM r)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN 'WARN' WHEN v.op IS NOT NULL AND v.op <> '=' THEN 'MANUAL'
        WHEN contains(low, 'interaction') OR contains(low, '×') OR contains(low, 'approached significance') OR contains(low, 'spearman') OR contains(low, 'correlation between') THEN 'MANUAL'
        WHEN tdv IS NULL THEN 'MANUAL' WHEN st IS NULL THEN 'MANUAL' WHEN expected IS NULL OR v.p IS NULL THEN 'WARN'
        WHEN abs(v.p - expected) <= CASE WHEN d > 0 THEN pow(10.0, -d) * 0.5 + 1e-9 ELSE 1e-9 END THEN 'PASS' ELSE 'FAIL' END AS status FROM x) GROUP BY status"""


def infer_dv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one measure that a claim and its line name, if it is one."""
    rows = _table(spark, sf_dir, "numerical_claims", "id", "raw_text", "context_snippet")
    text = F.concat(F.coalesce("context_snippet", "raw_text", F.lit("")), F.lit(" "), F.coalesce("raw_text", F.lit("")))
    return rows.select(F.col("id").alias("claim_id"), infer_measure(text, _rules(spark, sf_dir).dv_keywords).alias("dv")).where("dv is not null")


def half_ulp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed against expected numbers of the results table."""
    rows = _table(spark, sf_dir, "verification_results", "id", "expected_value", "computed_value")
    d = printed_digits(F.col("computed_value").cast("string"))
    return rows.select(F.col("id").alias("result_id"), *[half_ulp_equal(F.col("computed_value"), F.col("expected_value"), F.lit(k)).alias(f"equal_at_{k}") for k in range(4)], (d > 0).alias("has_digits"))


# --- ground truth -------------------------------------------------------------


def truth_p_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables printed per manuscript as markdown and read back."""
    rows = spark.read.parquet(f"{sf_dir}/gt_rows.parquet").where("manuscript_id is not null and dv is not null").select("manuscript_id", "dv", "f", "df1", "df2", "p_r", "p_scipy", "parity").distinct()
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    printed = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("dv", "f", "df1", "df2", "p_r", "p_scipy", "parity")]), F.lit(" |"))
    body = rows.groupBy("manuscript_id").agg(F.array_sort(F.collect_list(printed)).alias("b"))
    text = F.concat(F.array(*map(F.lit, ("# Statistics", "", "## p-value", "", "| DV | F | df1 | df2 | R p | scipy p | match |", "|---|---|---|---|---|---|---|"))), F.col("b"), F.array(F.lit(""), F.lit("| after | the | table |")))
    lines = body.select("manuscript_id", F.posexplode(text).alias("line_no", "text"))
    read = table_rows(lines, "p-value", ("manuscript_id",)).withColumn("dv", F.get("cells", F.lit(0)))
    parsed = p_rows(read.withColumn("dv", F.concat_ws("\t", "manuscript_id", "dv")))
    return parsed.select(F.split_part("dv", F.lit("\t"), F.lit(1)).alias("manuscript_id"), F.split_part("dv", F.lit("\t"), F.lit(2)).alias("dv"), "f", "df1", "df2", "p_r", "p_scipy", "parity", F.size("errors").alias("n_errors"))


TRUTH_P_SQL = """SELECT DISTINCT manuscript_id, dv, f, df1, df2, p_r, p_scipy, CASE WHEN contains(parity, '✗') THEN '✗' WHEN contains(parity, '✓') THEN '✓' ELSE 'unknown' END AS parity,
      CAST((CASE WHEN contains(parity, '✓') AND NOT contains(parity, '✗') THEN 0 ELSE 1 END) + (CASE WHEN f IS NULL OR df1 IS NULL OR df2 IS NULL OR p_r IS NULL OR p_scipy IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS n_errors
    FROM gt_rows WHERE manuscript_id IS NOT NULL AND dv IS NOT NULL"""


def truth_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "gt_rows", "*").groupBy("dv").agg(F.count_if(is_usable()).alias("n_usable"))


def truth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return has_usable_truth(spark.read.parquet(f"{sf_dir}/gt_rows.parquet"))


USABLE_SQL = "(coalesce(f, df1, df2, p_r, p_scipy, beta, se, ci_low, ci_high, v, p_wil) IS NOT NULL AND coalesce(len(validation_errors), 0) = 0 AND coalesce(parity, 'unknown') <> '✗')"


# --- references and citations ----------------------------------------------------


def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "reference_entries", F.col("id").alias("entry_id"), F.col("raw_text").alias("chunk")).where("chunk is not null")
    return ref.parse_references(rows).select("entry_id", "authors_raw", F.col("year").alias("ref_year"), "year_suffix", "title")


_ENTRY = ref.ENTRY.replace("(?mdU)", "(?m)")
REFERENCE_SQL = rf"""WITH t AS (SELECT DISTINCT id, raw_text r FROM reference_entries WHERE raw_text IS NOT NULL), m AS (SELECT id, regexp_extract(r, '{_ENTRY}', ['a', 'y', 't']) g FROM t)
    SELECT id AS entry_id, trim(g.a) AS authors_raw, CAST(substr(g.y, 1, 4) AS INTEGER) AS ref_year, substr(g.y, 5, 1) AS year_suffix, trim(g.t) AS title FROM m WHERE g.y <> ''"""


def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "reference_entries", "id", "status", "doi")
    return rows.select("id", "status", ref.doi_verdict(F.col("status"), F.col("doi")).alias("verdict"))


def citations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "in_text_citations", F.col("id").alias("citation_id"), F.col("raw_text").alias("text"))
    return cit.extract_citations(lines).select("citation_id", "citation_type", "raw_text", "first_author_last", F.col("year").alias("cite_year"), "year_suffix", "year_alt")


def _words_of(pattern: str) -> str:
    """The operator's expression for an engine without Unicode word classes and look-around."""
    return pattern.replace("(?U)", "").replace(r"[\w\-]", r"(?:[\pL\pN_\pM]|-)").replace("'s", "''s")


_IN_PARENTHESES = _words_of(cit.SUB_CITATION).removesuffix(r"\b") + r"(?:[^\pL\pN_]|$)"
_IN_TEXT = r"(?:^|[^\pL\pN_])" + _words_of(cit.NARRATIVE).removeprefix(r"\b")
CITATION_SQL = rf"""WITH t AS (SELECT DISTINCT id, raw_text r FROM in_text_citations WHERE raw_text IS NOT NULL AND NOT regexp_matches(raw_text, '^\s*>')),
    q AS (SELECT id, trim(unnest(string_split(substr(o, 2, length(o) - 2), ';'))) s FROM (SELECT id, unnest(regexp_extract_all(r, '\([^()]+\)')) o FROM t)),
    p AS (SELECT id, 'parenthetical' k, '(' || s || ')' w, regexp_extract(s, '{_IN_PARENTHESES}', ['a', 'y', 'z']) g FROM q), n AS (SELECT id, 'narrative' k, regexp_replace(regexp_extract(r, '{_IN_TEXT}', 0), '^[^A-Z]', '') w, regexp_extract(r, '{_IN_TEXT}', ['a', 'y', 'z']) g FROM t)
    SELECT id AS citation_id, k AS citation_type, w AS raw_text, g.a AS first_author_last, CAST(substr(g.y, 1, 4) AS INTEGER) AS cite_year, substr(g.y, 5, 1) AS year_suffix,
      CASE WHEN g.z <> '' THEN CAST(substr(g.z, 1, 4) AS INTEGER) END AS year_alt FROM (SELECT * FROM p UNION ALL SELECT * FROM n) WHERE g.y <> ''"""


def citation_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "in_text_citations", "id", "context_paraphrase", "raw_text")
    return rows.select(F.col("id").alias("citation_id"), cit.citation_purpose(F.col("context_paraphrase"), F.col("raw_text")).alias("purpose"))


def _alternatives(words: str) -> str:
    return "|".join(words.split(" "))


PURPOSE_SQL = rf"""SELECT id AS citation_id, CASE WHEN coalesce(regexp_matches(raw_text, '\(([A-Z]{{2,}}|[A-Z][A-Za-z]+);\s*[A-Z]'), false) THEN 'theory-cite'
      WHEN coalesce(regexp_matches(context_paraphrase, '(?i)\b(?:{_alternatives(cit.METHOD_VERBS)})\b') AND regexp_matches(context_paraphrase, '(?i)\b(?:{_alternatives(cit.METHOD_NOUNS)})s?\b'), false) THEN 'method-cite'
      WHEN coalesce(regexp_matches(context_paraphrase, '(?i)\b(?:{_alternatives(cit.THEORY_NOUNS)})\b'), false) THEN 'theory-cite'
      WHEN coalesce(regexp_matches(context_paraphrase, '(?i)\b(?:{_alternatives(cit.FINDING_VERBS)})\b'), false) THEN 'finding-cite' ELSE 'background-cite' END AS purpose
    FROM (SELECT DISTINCT id, context_paraphrase, raw_text FROM in_text_citations)"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cited = _table(spark, sf_dir, "in_text_citations", "id", "manuscript_id", "first_author_last", F.col("cite_year").alias("year"), "year_suffix", "year_alt")
    held = _table(spark, sf_dir, "reference_entries", "id", "manuscript_id", "first_author_last", F.col("ref_year").alias("year"), "year_suffix").withColumn("ref_ord", F.col("id"))
    return cit.link_citations(cited, held, ("manuscript_id",)), held


def citation_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[0].select(F.col("id").alias("citation_id"), "ref_id")


LINK_SQL = """c AS (SELECT DISTINCT id, manuscript_id m, lower(first_author_last) a, cite_year y, coalesce(year_suffix, '') s, year_alt z FROM in_text_citations),
    r AS (SELECT DISTINCT id, manuscript_id m, lower(first_author_last) a, ref_year y, coalesce(year_suffix, '') s FROM reference_entries),
    e AS (SELECT m, a, y, s, max(id) id FROM r GROUP BY ALL), b AS (SELECT m, a, y, max(id) id FROM r GROUP BY ALL HAVING count(*) = 1),
    linked AS (SELECT c.id AS citation_id, coalesce(e1.id, CASE WHEN c.s = '' THEN b1.id END, e2.id, CASE WHEN c.s = '' THEN b2.id END) AS ref_id, c.m FROM c
      LEFT JOIN e e1 ON c.m = e1.m AND c.a = e1.a AND c.y = e1.y AND c.s = e1.s LEFT JOIN b b1 ON c.m = b1.m AND c.a = b1.a AND c.y = b1.y
      LEFT JOIN e e2 ON c.m = e2.m AND c.a = e2.a AND c.z = e2.y AND c.s = e2.s LEFT JOIN b b2 ON c.m = b2.m AND c.a = b2.a AND c.z = b2.y)"""


def citation_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cit.dangling(_linked(spark, sf_dir)[0]).select(F.col("id").alias("citation_id"))


def reference_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked, held = _linked(spark, sf_dir)
    return cit.uncited(held, linked).select(F.col("id").alias("entry_id"))


# --- paraphrases ---------------------------------------------------------------


def paraphrase_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "paraphrase_matches", "id", "citation_purpose", "extracted_quote", "score", "status")
    status = paraphrase.paraphrase_status(F.col("citation_purpose"), F.col("extracted_quote"), F.col("score"))
    return rows.select(F.col("id").alias("match_id"), paraphrase.threshold_for(F.col("citation_purpose")).alias("threshold"), status.alias("decided"), paraphrase.fold_in(F.col("status"), F.col("score")).alias("folded"))


PARAPHRASE_SQL = """WITH t AS (SELECT DISTINCT id, citation_purpose p, extracted_quote q, score, status FROM paraphrase_matches),
    h AS (SELECT *, CASE WHEN p = 'finding-cite' THEN 0.85::DOUBLE WHEN p IN ('method-cite', 'theory-cite') THEN 0.40::DOUBLE END th FROM t)
    SELECT id AS match_id, th AS threshold, CASE WHEN th IS NULL THEN 'MANUAL' WHEN trim(coalesce(q, '')) = '' THEN 'FAIL' WHEN coalesce(score >= th, false) THEN 'PASS' ELSE 'FAIL' END AS decided,
      CASE WHEN NOT coalesce(status IN ('PASS', 'FAIL', 'WARN', 'MANUAL'), false) THEN 'FAIL' WHEN status = 'PASS' AND NOT coalesce(score BETWEEN 0 AND 1, false) THEN 'FAIL' ELSE status END AS folded FROM h"""


# --- results, documents, files ------------------------------------------------------


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "verification_results", "id", "target_type", "target_id", "status", "matched_dv")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.ordered_counts(_verdicts(spark, sf_dir), "status", "id")


def dv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.measure_counts(_verdicts(spark, sf_dir))


def manual_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.manual_by_type(_verdicts(spark, sf_dir), spark.read.parquet(f"{sf_dir}/numerical_claims.parquet"))


def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.pass_rate(_verdicts(spark, sf_dir))


def fail_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.fail_breakdown(_verdicts(spark, sf_dir))


def fail_detail_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.fail_detail(_verdicts(spark, sf_dir), "id").select(F.col("id").alias("result_id"), "target_type")


def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.exit_code(_verdicts(spark, sf_dir))


def coverage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates over the tables; a row per gate that fails."""
    claims, entries = spark.read.parquet(f"{sf_dir}/numerical_claims.parquet"), spark.read.parquet(f"{sf_dir}/reference_entries.parquet")
    rows = gates.coverage_gate(claims, "numerical-claims").unionByName(gates.coverage_gate(entries, "references"))
    return rows.unionByName(gates.scored_gate(spark.read.parquet(f"{sf_dir}/paraphrase_matches.parquet"))).select("target_type", "target_id", "status")


def page_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return gates.page_check(rows).select("doc_id", "line_count", "status")


_BREAK = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
PAGE_SQL = rf"""WITH t AS (SELECT doc_id, text, regexp_split_to_array(text, '{_BREAK}') p FROM documents),
    n AS (SELECT doc_id, CAST(CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 WHEN p[-1] = '' THEN len(p) - 1 ELSE len(p) END AS INTEGER) c FROM t)
    SELECT doc_id, c AS line_count, CASE WHEN c IS NULL THEN 'FAIL' WHEN c <= 70 THEN 'PASS' WHEN c <= 85 THEN 'WARN' ELSE 'FAIL' END AS status FROM n"""


DOC_LINES_SQL = rf"""WITH t AS (SELECT doc_id, regexp_split_to_array(text, '{_BREAK}') p FROM documents WHERE text IS NOT NULL AND text <> ''),
    n AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END q FROM t)
    SELECT doc_id, CAST(len(q) AS BIGINT) AS n_lines, CAST(list_sum(list_transform(q, lambda x: length(x))) AS BIGINT) AS n_line_chars FROM n WHERE len(q) > 0"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_line_chars"))


def doc_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), word_count(F.col("text")).cast("int").alias("n_words"))


def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.regexp_replace(F.regexp_extract("file_path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return _table(spark, sf_dir, "manuscripts", "id", "file_path").select("id", section_of(stem).alias("section"))


SECTION_SQL = r"""SELECT DISTINCT id, CASE WHEN contains(s, 'proceeding') OR contains(s, 'combined') OR contains(s, 'full') THEN 'combined' WHEN contains(s, 'intro') THEN 'intro' WHEN contains(s, 'method') THEN 'methods'
      WHEN contains(s, 'result') THEN 'results' WHEN contains(s, 'discussion') THEN 'discussion' WHEN contains(s, 'conclusion') THEN 'conclusion' WHEN contains(s, 'reference') OR contains(s, 'refs') OR contains(s, 'bibliography') THEN 'refs' ELSE 'body' END AS section
    FROM (SELECT id, lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\.[^.]*$', '')) s FROM manuscripts)"""


def manifest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest over the ordered digests of a project folder's files."""
    rows = _table(spark, sf_dir, "manuscripts", "id", "sha256").where("sha256 is not null")
    project = rows.withColumn("project", F.substring("id", 1, 10))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "sha256"))), lambda f: f["sha256"]), "")
    return project.groupBy("project").agg(F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 8).alias("prefix"))


_FIELD = r'(?:[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)'
_NUMBER = r"[+−-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+−-]?[0-9]+)?"


def _number_sql(k: int) -> str:
    return f"CASE WHEN regexp_full_match(c[{k}], '{_NUMBER}') AND isfinite(CAST(replace(c[{k}], '−', '-') AS DOUBLE)) THEN CAST(replace(c[{k}], '−', '-') AS DOUBLE) END"


def _optional_sql(k: int) -> str:
    return f"(c[{k}] IN ('', '—', 'N/A') OR {_number_sql(k)} IS NOT NULL)"


def _whole_sql(k: int) -> str:
    return f"coalesce({_number_sql(k)} >= 1 AND {_number_sql(k)} = floor({_number_sql(k)}), false)"


REJECTS_SQL = rf"""WITH l AS (SELECT DISTINCT row_id, coalesce(raw_line, '') s FROM raw_stat_rows),
    f AS (SELECT row_id, regexp_full_match(s, '{_FIELD}(?:,{_FIELD})*') ok, list_transform(regexp_extract_all(s || ',', '({_FIELD}),', 1),
        lambda x: trim(CASE WHEN trim(x) LIKE '"%' THEN replace(substr(trim(x), 2, length(trim(x)) - 2), '""', '"') ELSE x END)) c FROM l),
    a AS (SELECT 'raw_stat_rows' AS record_table, CAST(row_id AS VARCHAR) AS record_id, CASE WHEN NOT ok THEN 'quoting' WHEN len(c) <> 13 THEN 'column_count'
        WHEN NOT (coalesce({_number_sql(2)} >= 0, false) AND {_whole_sql(3)} AND {_whole_sql(4)} AND {_whole_sql(11)} AND coalesce({_number_sql(5)} BETWEEN 0 AND 1, false) AND coalesce({_number_sql(6)} BETWEEN 0 AND 1, false)
          AND {_optional_sql(7)} AND {_optional_sql(8)} AND {_optional_sql(9)} AND {_optional_sql(10)} AND coalesce({_number_sql(8)} > 0, true) AND coalesce({_number_sql(9)} <= {_number_sql(10)}, true) AND c[12] IN ('✓', '✗')) THEN 'value' END AS reason FROM f),
    r AS (SELECT DISTINCT id, coalesce(raw_text, '') s FROM reference_entries),
    g AS (SELECT *, regexp_extract(s, '\(([^()]*)\)\s*\.', 1) y, regexp_extract(s, '\([^()]*\)\s*\.', 0) w FROM r),
    h AS (SELECT *, CASE WHEN w = '' THEN '' ELSE substr(s, 1, instr(s, w) - 1) END head, CASE WHEN w = '' THEN s ELSE substr(s, instr(s, w) + length(w)) END rest FROM g),
    k AS (SELECT *, regexp_extract(rest, '(?is)(?:https?://|www\.|doi:)\S+.*$', 0) link FROM h),
    m AS (SELECT *, CASE WHEN link = '' THEN rest ELSE substr(rest, 1, length(rest) - length(link)) END body FROM k),
    b AS (SELECT 'reference_entries' AS record_table, id AS record_id, CASE
        WHEN length(replace(s, '(', '')) <> length(replace(s, ')', '')) OR (length(s) - length(replace(s, '*', ''))) % 2 = 1 OR (length(s) - length(replace(s, '"', ''))) % 2 = 1
          OR length(replace(s, '“', '')) <> length(replace(s, '”', '')) THEN 'quoting'
        WHEN w = '' OR trim(y) = '' OR NOT regexp_matches(head, '\pL') OR NOT regexp_matches(string_split(regexp_replace(body, '\*[^*]*\*', '', 'g'), '*')[1], '\pL') THEN 'column_count'
        WHEN NOT regexp_full_match(trim(y), '[0-9]{{4}}[A-Za-z]?') OR CAST(substr(trim(y), 1, 4) AS INTEGER) NOT BETWEEN 1800 AND 2026 OR (link <> '' AND NOT regexp_matches(trim(link), '(?:^|[^0-9.])10\.[0-9]{{4,9}}/\S+$')) THEN 'value' END AS reason FROM m)
    SELECT * FROM a WHERE reason IS NOT NULL UNION ALL SELECT * FROM b WHERE reason IS NOT NULL"""


LOADED_SQL = rf"""WITH l AS (SELECT DISTINCT row_id, manuscript_id, raw_line s FROM raw_stat_rows WHERE raw_line IS NOT NULL),
    f AS (SELECT row_id, manuscript_id, list_transform(regexp_extract_all(s || ',', '({_FIELD}),', 1), lambda x: trim(CASE WHEN trim(x) LIKE '"%' THEN replace(substr(trim(x), 2, length(trim(x)) - 2), '""', '"') ELSE x END)) c FROM l
      WHERE CAST(row_id AS VARCHAR) NOT IN (SELECT record_id FROM ({REJECTS_SQL}) WHERE record_table = 'raw_stat_rows'))
    SELECT DISTINCT row_id, manuscript_id, c[1] AS dv, {_number_sql(2)} AS f, CAST({_number_sql(3)} AS BIGINT) AS df1, CAST({_number_sql(4)} AS BIGINT) AS df2, {_number_sql(5)} AS p_r, {_number_sql(6)} AS p_scipy, {_number_sql(7)} AS beta, {_number_sql(8)} AS se,
      {_number_sql(9)} AS ci_low, {_number_sql(10)} AS ci_high, CAST({_number_sql(11)} AS BIGINT) AS n, c[12] AS parity FROM f"""


def _key_sql(column: str) -> str:
    return f"nullif(lower(trim({column}, chr(32) || chr(9) || chr(13) || chr(10) || chr(160))), '')"


def _month_sql(at: str) -> str:
    return f"strftime(make_timestamp(epoch_us({at})), '%Y-%m')"


def _key_cascade_sql() -> str:
    """Direct orphans by EXISTS over intervals and keys; the graph has three levels, so two rounds of joins follow."""
    time = lambda table: EVENT_TIMES.get(table)
    ids = "ids AS (" + " UNION ".join(f"SELECT '{t}' t, {_key_sql('id')} k FROM {t}" for t in sorted({e.parent for e in GRAPH})) + ")"
    events = "ev AS (" + " UNION ".join(
        f"SELECT '{e.child}' t, id, '{e.column}' via, '{e.parent}' parent, {str(e.lifetime).lower()} lives, {_key_sql(e.column)} k, {f'CAST({time(e.child)} AS TIMESTAMPTZ)' if time(e.child) else 'CAST(NULL AS TIMESTAMPTZ)'} tm FROM {e.child} WHERE {_key_sql(e.column)} IS NOT NULL"
        for e in GRAPH
    ) + ")"
    live = "d AS (SELECT " + _key_sql("id") + " k, loaded_at l, deleted_at u FROM reference_entries)"
    direct = f"""r0 AS (SELECT DISTINCT t, id, via, CASE WHEN NOT EXISTS (SELECT 1 FROM ids WHERE ids.t = ev.parent AND ids.k = ev.k) THEN 'missing' WHEN EXISTS (SELECT 1 FROM d WHERE d.k = ev.k AND d.l <= ev.tm) THEN 'deleted' ELSE 'late' END reason, {_month_sql('tm')} p
      FROM ev WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.t = ev.parent AND ids.k = ev.k) OR (lives AND NOT EXISTS (SELECT 1 FROM d WHERE d.k = ev.k AND d.l <= ev.tm AND (d.u IS NULL OR d.u > ev.tm))))"""
    step = lambda n, old: f"""r{n} AS (SELECT DISTINCT ev.t, ev.id, ev.via, o.reason, coalesce({_month_sql('ev.tm')}, o.p) p FROM ev JOIN r{n - 1} o ON o.t = ev.parent AND {_key_sql('o.id')} = ev.k
      WHERE NOT EXISTS (SELECT 1 FROM ({old}) x WHERE x.t = ev.t AND x.id = ev.id))"""  # noqa: E731
    rounds = ", ".join((ids, events, live, direct, step(1, "SELECT t, id FROM r0"), step(2, "SELECT t, id FROM r0 UNION ALL SELECT t, id FROM r1")))
    columns = "t AS record_table, id AS record_id, via, reason, p AS period"
    return f"WITH {rounds} SELECT {columns}, 'direct' AS kind FROM r0 UNION ALL SELECT {columns}, 'inherited' FROM r1 UNION ALL SELECT {columns}, 'inherited' FROM r2"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict counts per measure."""
    return record_queries.decide_counts(spark, sf_dir)


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {f"claims_{p.claim_type.lower()}": _claims_of(p) for p in PATTERNS}
    plain = (
        claim_type_counts, decide_generic, decide_p_value, infer_dv, half_ulp, truth_p_table, truth_usable, truth_gate, reference_parse, reference_status, citations_extract, citation_purpose,
        citation_link, citation_dangling, reference_orphans, paraphrase_status, status_counts, dv_counts, manual_by_type, pass_rate, fail_breakdown,
        fail_detail_top20, exit_code, coverage_gates, page_check, doc_lines, doc_digest, section_labels, manifest_prefix, p4_found, p4_loaded, p4_problems, p5_found, p5_report, p5_cascade, p5_key_cascade,
    )
    return named | {f.__name__: f for f in plain} | record_queries.queries()


def oracle_sql() -> dict[str, str]:
    v = "(SELECT DISTINCT id, target_type, target_id, status, matched_dv FROM verification_results)"
    claims = {f"claims_{p.claim_type.lower()}": _claims_sql(p) for p in PATTERNS}
    counts = " UNION ALL ".join(
        f"SELECT '{p.claim_type}' AS claim_type, count(*) AS n FROM (SELECT unnest(regexp_extract_all(s, '{_re2(p.pattern)}')) FROM (SELECT DISTINCT id, context_snippet s FROM numerical_claims)) HAVING count(*) > 0" for p in PATTERNS
    )
    return claims | record_queries.oracle_sql() | {
        "claim_type_counts": counts,
        "decide_generic": GENERIC_SQL,
        "p4_found": REJECTS_SQL,
        "p4_loaded": LOADED_SQL,
        "p5_key_cascade": _key_cascade_sql(),
        "infer_dv": f"WITH {TRUTH_SQL} SELECT DISTINCT id AS claim_id, dv FROM j WHERE dv IS NOT NULL",
        "decide_p_value": P_VALUE_SQL,
        "doc_lines": DOC_LINES_SQL,
        "half_ulp": "SELECT DISTINCT id AS result_id, coalesce(abs(computed_value - expected_value) <= 1.0 * 0.5 + 1e-9, false) AS equal_at_0, coalesce(abs(computed_value - expected_value) <= 0.1 * 0.5 + 1e-9, false) AS equal_at_1, coalesce(abs(computed_value - expected_value) <= 0.01 * 0.5 + 1e-9, false) AS equal_at_2, coalesce(abs(computed_value - expected_value) <= 0.001 * 0.5 + 1e-9, false) AS equal_at_3, CASE WHEN computed_value IS NOT NULL THEN true END AS has_digits FROM verification_results",
        "truth_p_table": TRUTH_P_SQL,
        "truth_usable": f"SELECT dv, count(*) FILTER (WHERE {USABLE_SQL}) AS n_usable FROM (SELECT DISTINCT * FROM gt_rows) GROUP BY dv",
        "truth_gate": f"SELECT coalesce(bool_or({USABLE_SQL}), false) AS usable FROM gt_rows",
        "reference_parse": REFERENCE_SQL,
        "reference_status": "SELECT DISTINCT id, status, CASE WHEN status = 'tbd-doi' THEN 'WARN' WHEN doi IS NULL AND status <> 'software' THEN 'WARN' ELSE 'PASS' END AS verdict FROM reference_entries",
        "citations_extract": CITATION_SQL,
        "citation_purpose": PURPOSE_SQL,
        "citation_link": f"WITH {LINK_SQL} SELECT citation_id, ref_id FROM linked",
        "citation_dangling": f"WITH {LINK_SQL} SELECT citation_id FROM linked WHERE ref_id IS NULL",
        "reference_orphans": f"WITH {LINK_SQL} SELECT r.id AS entry_id FROM r WHERE r.id NOT IN (SELECT ref_id FROM linked WHERE ref_id IS NOT NULL)",
        "paraphrase_status": PARAPHRASE_SQL,
        "status_counts": f"SELECT status, count(*) AS n FROM {v} GROUP BY status",
        "dv_counts": f"SELECT matched_dv, count(*) AS n FROM {v} WHERE coalesce(matched_dv, '') <> '' GROUP BY matched_dv",
        "manual_by_type": f"SELECT claim_type, count(*) AS n FROM {v} r JOIN (SELECT DISTINCT id, claim_type FROM numerical_claims) c ON r.target_id = c.id WHERE status = 'MANUAL' AND target_type = 'numerical-claim' GROUP BY claim_type",
        "pass_rate": f"SELECT count(*) AS n, count(*) FILTER (WHERE status = 'PASS') AS n_pass, coalesce(count(*) FILTER (WHERE status = 'PASS') * 100.0::DOUBLE / nullif(count(*), 0), 0.0) AS pass_rate FROM {v}",
        "fail_breakdown": f"""SELECT n_fail, n_numerical, n_citation, n_fail - n_numerical - n_citation AS n_other FROM (SELECT count(*) FILTER (WHERE status = 'FAIL') AS n_fail, count(*) FILTER (WHERE status = 'FAIL' AND target_type = 'numerical-claim') AS n_numerical,
            count(*) FILTER (WHERE status = 'FAIL' AND target_type IN ('in-text-citation', 'reference-entry')) AS n_citation FROM {v})""",
        "fail_detail_top20": f"SELECT id AS result_id, target_type FROM {v} WHERE status = 'FAIL' ORDER BY id LIMIT 20",
        "exit_code": f"SELECT CAST(CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM {v}",
        "coverage_gates": "SELECT 'coverage' AS target_type, 'references' AS target_id, 'FAIL' AS status WHERE (SELECT count(*) FROM reference_entries) = 0 UNION ALL SELECT 'coverage', 'numerical-claims', 'FAIL' WHERE (SELECT count(*) FROM numerical_claims) = 0 UNION ALL SELECT 'phase-2', 'phase-2', 'FAIL' WHERE (SELECT count(*) FROM paraphrase_matches WHERE status IN ('PASS', 'FAIL') AND score BETWEEN 0 AND 1) = 0",
        "page_check": PAGE_SQL,
        "doc_digest": r"SELECT doc_id, sha256(text) AS sha256, CAST(len(regexp_extract_all(text, '[^\s\x0b\x{85}\p{Z}]+')) AS INTEGER) AS n_words FROM documents",
        "section_labels": SECTION_SQL,
        "manifest_prefix": "SELECT substr(id, 1, 10) AS project, substr(sha256(string_agg(sha256, '' ORDER BY id, sha256)), 1, 8) AS prefix FROM (SELECT DISTINCT id, sha256 FROM manuscripts WHERE sha256 IS NOT NULL) GROUP BY 1",
    }
