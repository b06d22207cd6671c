"""More named queries over the domain tables, one row per record, and the SQL that must give the same rows.

The SQL states each rule anew, by splitting, list functions and joins; it shares
with the operators only what is a fixed value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.functions.text import approx_equal, claim_number, rounded
from quillcheck.operators import gates, paraphrase
from quillcheck.operators import references as ref
from quillcheck.operators.claims import PATTERNS, extract_claims, number_claims, without_duplicate_manuscripts
from quillcheck.operators.decide import DecisionRules, decide
from quillcheck.operators.library import attach_verdict, find_by_author_year, match_library
from quillcheck.operators.truth import build_truth, has_usable_truth, merge_summary, summary_labels, summary_rows
from quillcheck.session import collect_bounded, shuffled
from quillcheck.sources.files import frontmatter

Query = Callable[[SparkSession, str], DataFrame]
MAX_CATALOG = 100_000
#: Sample sizes of a study as a project would configure them.
SAMPLES = {"analytic": 245, "collected": 300, "power": 237, "pilot": 140}
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- decisions, claim by claim ------------------------------------------------------


def _latest_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per measure, the latest, whether it can decide claims or not."""
    rows = _read(spark, sf_dir, "gt_rows").where("dv is not null")
    fields = [c for c in rows.columns if c not in ("dv", "manuscript_id", "loaded_at")]
    return rows.groupBy("dv").agg(F.max_by(F.struct(*fields), F.struct("loaded_at", "manuscript_id")).alias("t")).select("dv", "t.*")


def decide_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim through the whole chain, with reliabilities, samples, conditions and measures in percent configured."""
    catalog = collect_bounded(_read(spark, sf_dir, "dv_catalog").where("dv is not null").select("dv", "label", "label_ko", "unit").distinct(), MAX_CATALOG, "the catalog")
    truth = _latest_truth(spark, sf_dir)
    alphas = collect_bounded(truth.where("alpha is not null").select("dv", "alpha"), MAX_CATALOG, "the reliabilities")
    rules = DecisionRules(
        dv_keywords=tuple(sorted((r["dv"], k) for r in catalog for k in (r["label"], r["label_ko"]) if k)), condition_labels=("HQ", "LQ"), percent_dvs=tuple(sorted(r["dv"] for r in catalog if r["unit"] == "percent")),
        n_contexts=dict(SAMPLES), alpha_values={r["dv"]: r["alpha"] for r in alphas},
    )
    claims = _read(spark, sf_dir, "numerical_claims").select("id", "claim_type", "parsed_value", "raw_text", "context_snippet", "start_pos", "end_pos", "raw_values").dropDuplicates(["id"])
    return decide(shuffled(claims), truth, rules).select(F.col("id").alias("claim_id"), "status", "matched_dv", "expected_value", "computed_value")


def _last_sql(text: str, needle: str) -> str:
    """Position of the last occurrence from 0, -1 for none; ``needle`` is a regular expression."""
    return f"CASE WHEN regexp_matches({text}, '{needle}') THEN length(regexp_extract({text}, '(?s)^(.*){needle}', 1)) ELSE -1 END"


def _printed_sql(value: str) -> str:
    return "CASE d " + " ".join(f"WHEN {k} THEN CAST(printf('%.{k}f', {value}) AS DOUBLE)" for k in range(1, 7)) + f" ELSE {value} END"


_HALF = "CASE WHEN {d} > 0 THEN pow(10.0, -{d}) * 0.5 + 1e-9 ELSE {none} END"
_EQUAL = "coalesce(abs({a} - {b}) <= pow(10.0, -length(regexp_extract({text}, '\\.(\\d+)', 1))) * 0.5 + 1e-9, false)"
_PAIR = r"\[\s*([+−-]?\d*\.?\d+)\s*,\s*([+−-]?\d*\.?\d+)\s*\]"
DECIDE_SQL = rf"""WITH truth AS (SELECT * FROM gt_rows WHERE dv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dv ORDER BY loaded_at DESC NULLS LAST, manuscript_id DESC NULLS LAST) = 1),
    words AS (SELECT dv, unnest([lower(label), lower(label_ko)]) w FROM dv_catalog),
    c AS (SELECT DISTINCT ON (id) id, claim_type kind, parsed_value v, coalesce(raw_text, '') raw, coalesce(context_snippet, raw_text, '') sn, start_pos s, end_pos e, raw_values rv FROM numerical_claims),
    i AS (SELECT c.id, list_distinct(list(words.dv)) dvs FROM c JOIN words ON contains(lower(sn || ' ' || raw), words.w) GROUP BY c.id),
    j AS (SELECT c.*, lower(sn) low, CASE WHEN len(i.dvs) = 1 THEN i.dvs[1] END dv FROM c LEFT JOIN i USING (id)),
    k AS (SELECT j.*, t.dv tdv, t AS t, length(regexp_extract(raw, '\.(\d+)', 1)) d, kind IN ('M_mean', 'SD', 'percent') grp,
        CASE WHEN s IS NULL AND e IS NULL THEN CASE WHEN raw <> '' AND (length(sn) - length(replace(sn, raw, ''))) = length(raw) THEN instr(sn, raw) - 1 END WHEN s >= 0 AND e <= length(sn) AND s < e AND substr(sn, s + 1, e - s) = raw THEN s END st
      FROM j LEFT JOIN truth t ON j.dv = t.dv),
    l AS (SELECT *, lower(substr(sn, 1, st + length(raw))) scope, lower(substr(sn, 1, st)) upto, len(regexp_extract_all(substr(sn, 1, st), '\[{SPACE}*[+−-]?\p{{Nd}}*\.?\p{{Nd}}+{SPACE}*,{SPACE}*[+−-]?\p{{Nd}}*\.?\p{{Nd}}+{SPACE}*\]')) earlier,
        coalesce(rv['ci_low'], nullif(regexp_extract(raw, '{_PAIR}', 1), '')) low_text, coalesce(rv['ci_high'], nullif(regexp_extract(raw, '{_PAIR}', 2), '')) high_text,
        CASE WHEN contains(low, 'kr-20') OR contains(low, 'test a') THEN 'learning_A' WHEN contains(low, 'test b') THEN 'learning_B' WHEN dv = 'learning' AND v.alpha > 0 AND v.alpha < 0.05 THEN 'learning_A' ELSE dv END akey,
        CASE WHEN contains(low, 'pilot') THEN 'pilot' WHEN contains(low, 'g*power') OR contains(low, 'g power') OR contains(low, 'a priori') THEN 'power'
          WHEN contains(low, 'analytic') OR contains(low, 'final') OR contains(low, 'yielding') OR contains(low, 'excluded') THEN 'analytic' WHEN contains(low, 'recruited') OR contains(low, 'collected') THEN 'collected' WHEN v.n = {SAMPLES["analytic"]} THEN 'analytic' END ctx FROM k),
    m AS (SELECT *, (SELECT max(alpha) FROM truth x WHERE x.dv = akey) atruth, coalesce((SELECT bool_or(abs(l.v.alpha - x.alpha) <= 0.001) FROM truth x WHERE x.alpha IS NOT NULL), false) other_alpha,
        CASE ctx {" ".join(f"WHEN '{k}' THEN {n}" for k, n in SAMPLES.items())} END ntruth, coalesce(v.n IN ({", ".join(map(str, SAMPLES.values()))}), false) other_n,
        {_last_sql("upto", "hq")} at_a, {_last_sql("upto", "lq")} at_b,
        greatest({_last_sql("scope", "wilcoxon")}, {_last_sql("scope", r"\*v\*")}, CASE WHEN regexp_matches(scope, '(?:^|[^a-z])v\s*=') THEN length(regexp_extract(scope, '(?s)^((?:.*[^a-z])?)v\s*=', 1)) ELSE -1 END) w,
        greatest({_last_sql("scope", r"\*f\*")}, CASE WHEN regexp_matches(scope, '(?:^|[^a-z])f\s*\(') THEN length(regexp_extract(scope, '(?s)^((?:.*[^a-z])?)f\s*\(', 1)) ELSE -1 END) fpos FROM l),
    n AS (SELECT *, CASE WHEN at_a > at_b THEN 'HQ' WHEN at_b > at_a THEN 'LQ' END label, CASE kind WHEN 'M_mean' THEN v.m WHEN 'SD' THEN v.sd ELSE v.pct END seen,
        CASE kind WHEN 'F_stat' THEN t.f WHEN 'p_value' THEN CASE WHEN w > fpos THEN t.p_wil ELSE t.p_r END WHEN 'beta' THEN t.beta WHEN 'effect_dz' THEN t.dz WHEN 'V_wilcoxon' THEN t.v WHEN 'r_corr' THEN t.r END expected,
        CASE kind WHEN 'F_stat' THEN v.f WHEN 'p_value' THEN v.p WHEN 'beta' THEN v.beta WHEN 'effect_dz' THEN v.dz WHEN 'V_wilcoxon' THEN v.v WHEN 'r_corr' THEN v.r END observed FROM m),
    o AS (SELECT *, CASE kind WHEN 'SD' THEN CASE label WHEN 'HQ' THEN t.sd_hq ELSE t.sd_lq END ELSE CASE label WHEN 'HQ' THEN t.m_hq ELSE t.m_lq END END wanted FROM n),
    r AS (SELECT *, CASE
        WHEN kind IS NULL OR v IS NULL THEN 'a WARN' WHEN kind = 'p_value' AND v.op IS NOT NULL AND v.op <> '=' THEN 'd MANUAL'
        WHEN kind = 'p_value' AND (contains(low, 'interaction') OR contains(low, '×') OR contains(low, 'approached significance') OR contains(low, 'spearman') OR contains(low, 'correlation between')) THEN 'd MANUAL'
        WHEN kind NOT IN ('alpha', 'N') AND tdv IS NULL THEN 'a MANUAL' WHEN kind NOT IN ('alpha', 'N') AND (coalesce(len(t.validation_errors), 0) > 0 OR t.parity = '✗') THEN 'd WARN'
        WHEN kind IN ('p_value', 'CI_pair', 'M_mean', 'SD', 'percent') AND st IS NULL THEN 'd MANUAL' WHEN kind = 'F_stat' AND (coalesce(v.df1 <> t.df1, false) OR coalesce(v.df2 <> t.df2, false)) THEN 'd FAIL' WHEN kind = 'p_adj' THEN 'd MANUAL'
        WHEN kind = 'CI_pair' AND (contains(low, 'd_z') OR contains(low, ' dz ') OR contains(sn, '~z~')) THEN 'd MANUAL' WHEN kind = 'CI_pair' AND earlier >= 1 THEN 'd MANUAL' WHEN kind = 'CI_pair' AND (t.ci_low IS NULL OR t.ci_high IS NULL) THEN 'd MANUAL'
        WHEN kind = 'CI_pair' AND (v.ci_low IS NULL OR v.ci_high IS NULL OR low_text IS NULL OR high_text IS NULL) THEN 'd WARN'
        WHEN kind = 'CI_pair' THEN CASE WHEN {_EQUAL.format(a="v.ci_low", b="t.ci_low", text="low_text")} AND {_EQUAL.format(a="v.ci_high", b="t.ci_high", text="high_text")} THEN 'd PASS' ELSE 'd FAIL' END
        WHEN kind = 'alpha' AND atruth IS NULL THEN 'k MANUAL' WHEN kind = 'alpha' AND abs(v.alpha - atruth) <= 0.001 THEN 'K PASS' WHEN kind = 'alpha' AND other_alpha THEN 'K MANUAL' WHEN kind = 'alpha' THEN 'K FAIL'
        WHEN kind = 'N' AND ntruth IS NULL THEN 'c MANUAL' WHEN kind = 'N' AND v.n = ntruth THEN 'C PASS' WHEN kind = 'N' AND other_n THEN 'C MANUAL' WHEN kind = 'N' THEN 'C FAIL'
        WHEN kind = 'percent' AND NOT EXISTS (SELECT 1 FROM dv_catalog q WHERE q.dv = o.dv AND q.unit = 'percent') THEN 'd MANUAL' WHEN grp AND label IS NULL THEN 'd MANUAL' WHEN grp AND wanted IS NULL THEN 'd MANUAL' WHEN grp AND seen IS NULL THEN 'd WARN'
        WHEN grp THEN CASE WHEN coalesce(abs({_printed_sql("wanted")} - seen) <= {_HALF.format(d="d", none="0.05")}, false) THEN 'G PASS' ELSE 'G FAIL' END
        WHEN kind NOT IN ('F_stat', 'p_value', 'beta', 'effect_dz', 'V_wilcoxon', 'r_corr') THEN 'd MANUAL' WHEN expected IS NULL OR observed IS NULL THEN 'D WARN'
        WHEN abs(observed - expected) <= {_HALF.format(d="d", none="1e-9")} THEN 'D PASS' ELSE 'D FAIL' END verdict FROM o)
    SELECT id AS claim_id, substr(verdict, 3) AS status, CASE WHEN verdict LIKE 'a%' THEN NULL WHEN verdict[1] IN ('k', 'K') THEN akey WHEN verdict[1] IN ('c', 'C') THEN ctx WHEN verdict[1] = 'G' THEN dv || '_' || label ELSE dv END AS matched_dv,
      CAST(CASE verdict[1] WHEN 'K' THEN atruth WHEN 'C' THEN ntruth WHEN 'G' THEN wanted WHEN 'D' THEN expected END AS DOUBLE) AS expected_value, CAST(CASE verdict[1] WHEN 'K' THEN v.alpha WHEN 'C' THEN v.n WHEN 'G' THEN seen WHEN 'D' THEN observed END AS DOUBLE) AS computed_value FROM r"""


def decide_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions counted per measure and status."""
    return decide_claims(spark, sf_dir).groupBy("matched_dv", "status").agg(F.count("*").alias("n"))


# --- typed values and numbers of claims ----------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "numerical_claims").select(F.col("id").alias("claim_id"), F.col("context_snippet").alias("text")).distinct()
    return shuffled(rows)


def claim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values and printed numbers of every claim found in the lines."""
    found = extract_claims(_lines(spark, sf_dir))
    typed = [F.col(f"parsed_value.{f}").cast("double").alias(f) for f in ("df1", "df2", "n", "f", "p", "p_adj", "beta", "alpha", "ci_low", "ci_high", "pct", "r")]
    return found.select("claim_id", "claim_type", "start_pos", F.col("parsed_value.op").alias("op"), *typed, F.size("raw_values").alias("n_values"))


def _values_sql() -> str:
    """Groups of each match, taken by themselves; numbers by replacing the minus sign."""
    parts = []
    fields = ("df1", "df2", "n", "f", "p", "p_adj", "beta", "alpha", "ci_low", "ci_high", "pct", "r")
    for p in PATTERNS:
        rx = p.pattern.replace(r"\s", r"[\s\x0b\x{85}\p{Z}]").replace(r"\d", r"\p{Nd}").replace("'", "''")
        group = lambda key: f"regexp_extract_all(s, '{rx}', {p.keys.index(key) + 1})[k]"  # noqa: B023, E731
        value = lambda f: f"TRY_CAST(translate({group(f)}, '−０１２３４５６７８９', '-0123456789') AS DOUBLE)" if f in p.keys else "CAST(NULL AS DOUBLE)"  # noqa: B023, E731
        op = group("op") if "op" in p.keys else "CAST(NULL AS VARCHAR)"
        numbers = len([k for k in p.keys if k != "op"])
        parts.append(f"""SELECT id AS claim_id, '{p.claim_type}' AS claim_type, CAST(list_sum(list_transform(regexp_split_to_array(s, '{rx}')[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(s, '{rx}')[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start_pos,
          {op} AS op, {", ".join(f"{value(f)} AS {f}" for f in fields)}, {numbers} AS n_values FROM (SELECT id, s, unnest(range(1, len(regexp_extract_all(s, '{rx}')) + 1)) k FROM t)""")
    return "WITH t AS (SELECT DISTINCT id, context_snippet s FROM numerical_claims WHERE context_snippet IS NOT NULL) " + " UNION ALL ".join(parts)


def claim_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of claims in the order of manuscripts, lines and places, over all manuscripts."""
    rows = _read(spark, sf_dir, "numerical_claims").where("manuscript_id is not null and claim_type = 'F_stat'").select(F.col("id").alias("claim_id"), F.substring_index("manuscript_id", "-", -1).cast("int").alias("ms_ord"), F.coalesce("line_no", F.lit(0)).alias("line_no")).distinct()
    keyed = rows.withColumns({"pat_ord": F.lit(0), "start_pos": F.substring_index("claim_id", "-", -1).cast("long")})
    return number_claims(keyed).select("claim_id", F.col("id").alias("number"))


NUMBERS_SQL = """SELECT claim_id, printf('claim-%04d', row_number() OVER (ORDER BY ms_ord, line_no, place)) AS number FROM (SELECT DISTINCT id AS claim_id, CAST(string_split(manuscript_id, '-')[-1] AS INTEGER) ms_ord, coalesce(line_no, 0) line_no,
      CAST(string_split(id, '-')[-1] AS BIGINT) place FROM numerical_claims WHERE manuscript_id IS NOT NULL AND claim_type = 'F_stat')"""


def number_primitives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison within a tolerance, rounding to printed digits, reading of printed numbers."""
    rows = _read(spark, sf_dir, "verification_results").select("id", "expected_value", "computed_value").distinct()
    printed = F.replace(F.replace(F.format_number("computed_value", 3), F.lit(","), F.lit("")), F.lit("-"), F.lit("−"))
    return rows.select(F.col("id").alias("result_id"), approx_equal(F.col("expected_value"), F.col("computed_value")).alias("close"), rounded(F.col("expected_value"), F.lit(1)).alias("at_1"), rounded(F.col("expected_value"), F.lit(3)).alias("at_3"), F.when(F.col("computed_value").isNotNull(), claim_number(printed)).alias("read_back"))


PRIMITIVES_SQL = """SELECT DISTINCT id AS result_id, coalesce(abs(expected_value - computed_value) <= 0.001, false) AS close, CAST(printf('%.1f', expected_value) AS DOUBLE) AS at_1, CAST(printf('%.3f', expected_value) AS DOUBLE) AS at_3,
      CAST(printf('%.3f', computed_value) AS DOUBLE) AS read_back FROM verification_results"""


# --- ground truth -------------------------------------------------------------------


#: Rows of one measure stand in the order of these numbers.
ORDER = ("f", "df1", "df2", "p_r", "p_scipy", "beta", "se", "v", "p_wil", "r", "dz", "m_hq", "sd_hq", "m_lq", "sd_lq", "ci_low", "ci_high")


def _printed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of a manuscript in the order of their numbers."""
    rows = _read(spark, sf_dir, "gt_rows").where("manuscript_id is not null and dv is not null").drop("loaded_at", "alpha", "validation_errors").distinct()
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    bar = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *cs), F.lit(" |"))
    interval = F.when(F.col("ci_low").isNotNull() & F.col("ci_high").isNotNull(), F.concat(F.lit("["), cell("ci_low"), F.lit(", "), cell("ci_high"), F.lit("]"))).otherwise("—")
    pair = lambda m, sd: F.concat(cell(m), F.lit(" ("), cell(sd), F.lit(")"))
    key = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(-1e9)) for c in ORDER])
    return rows.select(
        "manuscript_id", "dv", key.alias("k"), bar(cell("dv"), cell("f"), cell("df1"), cell("df2"), cell("p_r"), cell("p_scipy"), cell("parity")).alias("p_line"), bar(cell("dv"), cell("beta"), cell("se"), interval, F.lit("✓")).alias("b_line"),
        bar(cell("dv"), cell("v"), cell("p_wil"), cell("r"), F.lit("[0, 1]"), cell("dz"), F.lit("[0, 1]"), F.lit("38")).alias("w_line"), bar(F.concat(F.lit("**"), cell("dv"), F.lit("**")), pair("m_hq", "sd_hq"), pair("m_lq", "sd_lq")).alias("s_line"),
    )


def _document(rows: DataFrame, *sections: tuple[str, str, str]) -> DataFrame:
    """``manuscript_id, line_no, text`` of a markdown document per manuscript: (heading, header row, column of rows)."""
    body = rows.groupBy("manuscript_id").agg(F.array_sort(F.collect_list(F.struct("dv", "k", *[c for _, _, c in sections]))).alias("b"))
    text = F.array(F.lit("---"), F.lit("kind: statistics"), F.lit("---"))
    for heading, header, column in sections:
        rule = "|" + "---|" * (header.count("|") - 1)
        text = F.concat(text, F.array(F.lit(f"## {heading}"), F.lit(""), F.lit(header), F.lit(rule)), F.col(f"b.{column}"), F.array(F.lit("")))
    return body.select("manuscript_id", F.posexplode(text).alias("line_no", "text"))


HEADERS = {"p_table": "| DV | F | df1 | df2 | R p | scipy p | match |", "beta_table": "| DV | β | SE | CI | consistent |", "wilcoxon_table": "| DV | V | p | r | r CI | dz | dz CI | n |"}


def _truth_of_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _printed_rows(spark, sf_dir)
    headings = {"p_table": "p-value", "beta_table": "beta", "wilcoxon_table": "Wilcoxon"}
    columns = {"p_table": "p_line", "beta_table": "b_line", "wilcoxon_table": "w_line"}
    lines = _document(rows, *[(headings[t], HEADERS[t], columns[t]) for t in headings])
    aliases = rows.select(F.col("dv").alias("label"), "dv").distinct()
    alpha = _read(spark, sf_dir, "gt_rows").where("manuscript_id is not null and dv is not null and alpha is not null").groupBy("manuscript_id", "dv").agg(F.max("alpha").alias("alpha"))
    return build_truth(lines, headings, aliases, alpha, ("manuscript_id",)), rows


def truth_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of each manuscript's document merged per measure with the reliabilities; the last row of a table wins."""
    truth, _ = _truth_of_documents(spark, sf_dir)
    return truth.select("manuscript_id", "dv", "f", "df1", "df2", "p_r", "p_scipy", "beta", "se", "ci_low", "ci_high", "v", "p_wil", "r", "dz", "parity", "alpha", F.size("validation_errors").alias("n_errors"))


def truth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and deviations read from a summary table of labelled rows."""
    truth, rows = _truth_of_documents(spark, sf_dir)
    lines = _document(rows, ("Summary", "| Measure | HQ | LQ |", "s_line"))
    cells = summary_labels(lines, ["Summary"], rows.select(F.col("dv").alias("label"), "dv").distinct(), ("manuscript_id",))
    return merge_summary(truth, cells, ("manuscript_id",)).select("manuscript_id", "dv", "m_hq", "sd_hq", "m_lq", "sd_lq")


def truth_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one section per measure whose row of means holds an M."""
    rows = _printed_rows(spark, sf_dir).withColumn("s_line", F.regexp_replace("s_line", r"^\| \*\*.*?\*\* \|", "| M (SD) |"))
    measures = [r["dv"] for r in collect_bounded(_read(spark, sf_dir, "dv_catalog").select("dv").where("dv is not null").distinct(), MAX_CATALOG, "the catalog")]
    parts = rows.groupBy("manuscript_id", "dv").agg(F.array_sort(F.collect_list(F.struct("k", "s_line"))).alias("b"))
    section = F.concat(F.array(F.concat(F.lit("### "), F.col("dv"), F.lit(" ###")), F.lit("| | HQ | LQ |"), F.lit("|---|---|---|")), F.transform("b", lambda r: r["s_line"]), F.array(F.lit("")))
    body = parts.groupBy("manuscript_id").agg(F.array_sort(F.collect_list(F.struct("dv", section.alias("lines")))).alias("s")).select("manuscript_id", F.flatten(F.transform("s", lambda x: x["lines"])).alias("t"))
    lines = body.select("manuscript_id", F.posexplode("t").alias("line_no", "text"))
    truth = parts.select("manuscript_id", "dv", *[F.lit(None).cast("double").alias(c) for c in ("m_hq", "sd_hq", "m_lq", "sd_lq")])
    cells = summary_rows(lines, {f"### {dv} ###": dv for dv in measures}, spark, ("manuscript_id",))
    return merge_summary(truth, cells, ("manuscript_id",)).select("manuscript_id", "dv", "m_hq", "sd_hq", "m_lq", "sd_lq")


_GT = f"""g AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id, dv ORDER BY {", ".join(f"coalesce({c}, -1e9)" for c in ORDER)}) rn
    FROM (SELECT DISTINCT * EXCLUDE (loaded_at, alpha, validation_errors) FROM gt_rows WHERE manuscript_id IS NOT NULL AND dv IS NOT NULL))"""
TRUTH_BUILD_SQL = f"""WITH {_GT}, a AS (SELECT manuscript_id, dv, max(alpha) alpha FROM gt_rows WHERE manuscript_id IS NOT NULL AND dv IS NOT NULL GROUP BY ALL),
    e AS (SELECT g.*, alpha, sum((CASE WHEN contains(coalesce(parity, '—'), '✓') AND NOT contains(coalesce(parity, '—'), '✗') THEN 0 ELSE 1 END) + (CASE WHEN f IS NULL OR df1 IS NULL OR df2 IS NULL OR p_r IS NULL OR p_scipy IS NULL THEN 1 ELSE 0 END)
        + (CASE WHEN beta IS NULL OR se IS NULL OR ci_low IS NULL OR ci_high IS NULL THEN 1 ELSE 0 END) + (CASE WHEN v IS NULL OR p_wil IS NULL OR r IS NULL OR dz IS NULL THEN 1 ELSE 0 END)) OVER (PARTITION BY g.manuscript_id, g.dv) n FROM g JOIN a USING (manuscript_id, dv))
    SELECT manuscript_id, dv, f, df1, df2, p_r, p_scipy, beta, se, CASE WHEN ci_high IS NOT NULL THEN ci_low END AS ci_low, CASE WHEN ci_low IS NOT NULL THEN ci_high END AS ci_high, v, p_wil, r, dz,
      CASE WHEN contains(parity, '✗') THEN '✗' WHEN contains(parity, '✓') THEN '✓' ELSE 'unknown' END AS parity, alpha, CAST(n AS INTEGER) AS n_errors FROM e QUALIFY row_number() OVER (PARTITION BY manuscript_id, dv ORDER BY rn DESC) = 1"""
SUMMARY_SQL = f"""WITH {_GT} SELECT manuscript_id, dv, arg_max(m_hq, rn) FILTER (WHERE m_hq IS NOT NULL AND sd_hq IS NOT NULL) AS m_hq, arg_max(sd_hq, rn) FILTER (WHERE m_hq IS NOT NULL AND sd_hq IS NOT NULL) AS sd_hq,
      arg_max(m_lq, rn) FILTER (WHERE m_lq IS NOT NULL AND sd_lq IS NOT NULL) AS m_lq, arg_max(sd_lq, rn) FILTER (WHERE m_lq IS NOT NULL AND sd_lq IS NOT NULL) AS sd_lq FROM g GROUP BY manuscript_id, dv"""


def truth_gate_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the tables: a row only if there are claims and no usable truth."""
    usable = has_usable_truth(_read(spark, sf_dir, "gt_rows").where("parity = '✗'"))  # rows that cannot decide
    return gates.truth_gate(_read(spark, sf_dir, "numerical_claims"), usable).select("target_type", "target_id", "verifier", "status")


def truth_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures with ground truth per manuscript."""
    rows = _read(spark, sf_dir, "gt_rows").where("manuscript_id is not null and dv is not null")
    return gates.truth_coverage(rows, ("manuscript_id",))


# --- references ----------------------------------------------------------------------


def reference_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from an entry beyond authors, year and title."""
    rows = _read(spark, sf_dir, "reference_entries").select(F.col("id").alias("entry_id"), F.col("raw_text").alias("chunk")).where("chunk is not null").distinct()
    parsed = ref.parse_references(rows)
    return parsed.select("entry_id", F.col("id").alias("slug"), "first_author_last", "doi", "journal", "status", F.length("raw_text").alias("n_raw"), "notes", ref.doi_verdict(F.col("status"), F.col("doi")).alias("verdict"))


FIELDS_SQL = rf"""WITH t AS (SELECT DISTINCT id, raw_text r FROM reference_entries WHERE raw_text IS NOT NULL), m AS (SELECT id, r, regexp_extract(r, '{ref.ENTRY.replace("(?mdU)", "(?m)")}', ['a', 'y', 't']) g, regexp_extract(r, '{ref.ENTRY.replace("(?mdU)", "(?m)")}', 0) w FROM t),
    p AS (SELECT *, regexp_split_to_array(trim(string_split(trim(g.a), ',')[1]), '\s+(?:&|and)\s+')[1] f, string_split_regex(r, 'https?://(?:dx\.)?doi\.org/') u, lower(r) low, lower(trim(g.t)) title, substr(r, instr(r, w) + length(w)) rest FROM m WHERE g.y <> ''),
    q AS (SELECT *, CASE WHEN len(u) > 1 THEN nullif(regexp_replace(regexp_extract(u[2], '^\S+', 0), '[.,;]+$', ''), '') END doi FROM p),
    s AS (SELECT *, CASE WHEN contains(low, '[tbd-doi') OR contains(low, 'tbd:') THEN 'tbd-doi' WHEN doi IS NOT NULL THEN 'doi-present'
        WHEN contains(title, 'software') OR contains(title, 'package') OR contains(title, 'r:') OR contains(title, 'python') OR contains(lower(g.a), 'r core team') THEN 'software' ELSE 'draft' END status FROM q)
    SELECT id AS entry_id, replace(replace(trim(f), ' ', ''), '-', '') || CAST(CAST(substr(g.y, 1, 4) AS INTEGER) AS VARCHAR) || substr(g.y, 5, 1) AS slug, trim(f) AS first_author_last, doi, trim(regexp_extract(rest, '\*([^*]+)\*\s*,', 1)) AS journal, status,
      CAST(least(length(r), 300) AS INTEGER) AS n_raw, regexp_extract(r, '(?m)^>\s*(.+)', 1) AS notes, CASE WHEN status = 'tbd-doi' OR (doi IS NULL AND status <> 'software') THEN 'WARN' ELSE 'PASS' END AS verdict FROM s"""


def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a printed list per manuscript: frontmatter, heading and notes dropped, cut at blank lines."""
    rows = _read(spark, sf_dir, "reference_entries").where("manuscript_id is not null and raw_text is not null").select("manuscript_id", "raw_text").distinct()
    body = rows.groupBy("manuscript_id").agg(F.array_join(F.array_sort(F.collect_list("raw_text")), "\n\n> a note\n\n").alias("b"))
    texts = body.select("manuscript_id", F.concat(F.lit("---\ntotal_references: 3\n---\n\n# References\n\n"), F.col("b"), F.lit("\n")).alias("text"))
    return ref.reference_chunks(texts, keep=("manuscript_id",)).select("manuscript_id", "chunk")


LIST_SQL = r"""WITH t AS (SELECT DISTINCT manuscript_id, raw_text r FROM reference_entries WHERE manuscript_id IS NOT NULL AND raw_text IS NOT NULL), p AS (SELECT manuscript_id, trim(unnest(regexp_split_to_array(r, '\n\s*\n')), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) c FROM t)
    SELECT manuscript_id, c AS chunk FROM p WHERE c <> '' AND c NOT LIKE '>%'"""


# --- files and sections -------------------------------------------------------------


def manuscripts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuscripts without the combined files where single sections are present."""
    rows = _read(spark, sf_dir, "manuscripts").select("id", "section").distinct()
    return without_duplicate_manuscripts(rows)


ONCE_SQL = "SELECT DISTINCT id, section FROM manuscripts WHERE section IS DISTINCT FROM 'combined' OR NOT EXISTS (SELECT 1 FROM manuscripts WHERE section IN ('intro', 'methods', 'results', 'discussion', 'conclusion'))"


def frontmatter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the leading block of a file, printed from the entries: quoted, given twice, or in the text only."""
    rows = _read(spark, sf_dir, "reference_entries").select("id", F.coalesce(F.trim("doi"), F.lit("")).alias("d"), F.coalesce(F.trim("journal"), F.lit("")).alias("j")).distinct()
    text = F.concat(F.lit("---\nkind: entry\ndoi: first\ndoi: '"), F.col("d"), F.lit("'\njournal: "), F.col("j"), F.lit("\n---\n# Notes\n\nyear: 2020\n"))
    return rows.select(F.col("id").alias("entry_id"), *[frontmatter(text, k).alias(k) for k in ("doi", "journal", "year")])


FRONTMATTER_SQL = "SELECT DISTINCT id AS entry_id, nullif(trim(doi), '') AS doi, nullif(trim(journal), '') AS journal, CAST(NULL AS VARCHAR) AS year FROM reference_entries"


# --- the library -------------------------------------------------------------------


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file once, with the DOI and title of the entry it was collected for."""
    known = _read(spark, sf_dir, "reference_entries").groupBy("id").agg(F.max("doi").alias("doi"), F.max("title").alias("title"))
    rows = _read(spark, sf_dir, "source_pdfs").where("pdf_path is not null").select("pdf_path", "ref_id").distinct()
    files = rows.join(known, rows["ref_id"] == known["id"], "left").groupBy(F.col("pdf_path").alias("path")).agg(F.max("doi").alias("doi"), F.max("title").alias("title"))
    return files.select("path", F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), "doi", "title")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "reference_entries").select("id", "first_author_last", F.col("ref_year").alias("year"), "title", "doi").distinct()


def library_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference entries against the files, by DOI, title, author and year."""
    found = match_library(_held(spark, sf_dir), _library(spark, sf_dir))
    return found.select("id", "source_kind", "pdf_path", attach_verdict(F.col("source_kind"), F.col("pdf_path")).alias("verdict"))


def library_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of an author and a year alone, if it is the only one."""
    return find_by_author_year(_held(spark, sf_dir), _library(spark, sf_dir))


def _library_sql(meta: bool) -> str:
    words = lambda c: f"regexp_extract_all(replace(lower(nfc_normalize(coalesce({c}, ''))), 'ß', 'ss'), '[\\pL\\pN]+')"
    doi = lambda c: f"nullif(regexp_replace(regexp_replace(lower(trim({c})), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', ''), '[.,;]+$', ''), '')"
    some = (lambda x: x) if meta else (lambda x: "CAST(NULL AS VARCHAR)")
    near = lambda *offs: "(" + " OR ".join(f"list_contains(n, CAST(y + ({o}) AS VARCHAR))" for o in offs) + ")"
    return rf"""r AS (SELECT *, list_filter(tw, lambda x: NOT list_contains(['a', 'an', 'the', 'of', 'and', 'in', 'on', 'for', 'to', 'with'], x)) td, list_filter(regexp_split_to_array(coalesce(rd, ''), '[^\pL\pN]+'), lambda x: x <> '') dt FROM
        (SELECT DISTINCT id, ref_year y, {words("first_author_last")} a, {words(some("title"))} tw, {doi(some("doi"))} rd FROM reference_entries)),
      k AS (SELECT id, max(doi) doi, max(title) title FROM reference_entries GROUP BY id),
      p AS (SELECT pdf_path path, {doi(some("max(doi)"))} fd, {words(some("max(title)"))} fw FROM (SELECT DISTINCT pdf_path, ref_id FROM source_pdfs WHERE pdf_path IS NOT NULL) LEFT JOIN k ON ref_id = k.id GROUP BY pdf_path),
      f AS (SELECT *, {words("regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', '')")} n, lower(regexp_extract(path, '\.([^./]+)$', 1)) ext FROM p),
      x AS (SELECT r.*, f.path, f.ext, contains(' ' || array_to_string(n, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' ') by_author, {near(0)} y0, {near(-1, 0, 1)} y1, coalesce(rd = fd, false) OR (rd IS NOT NULL AND len(n) >= len(dt) AND n[len(n) - len(dt) + 1:] = dt) by_doi,
          (len(list_distinct(td)) >= 2 OR len(list_filter(td, lambda w: length(w) >= 4)) > 0) AND (len(list_filter(td, lambda w: NOT list_contains(n, w))) = 0 OR array_to_string(tw, '') = array_to_string(fw, '')) by_title
        FROM r, f WHERE len(a) > 0 AND NOT coalesce(rd <> fd, false)),
      c AS (SELECT *, CASE WHEN by_doi THEN 0 WHEN by_author AND coalesce(y1, false) AND by_title THEN 1 WHEN by_author AND coalesce(y0, false) THEN 2 WHEN by_author AND coalesce(y1, false) THEN 3 END rank FROM x),
      b AS (SELECT id, y, a, tw, rd, min(rank) low FROM c WHERE rank IS NOT NULL GROUP BY ALL),
      z AS (SELECT b.id, CASE WHEN count(DISTINCT c.path) > 1 THEN 'ambiguous' WHEN any_value(low) = 3 THEN any_value(ext) || '-yearfuzzy' ELSE any_value(ext) END source_kind, CASE WHEN count(DISTINCT c.path) = 1 THEN any_value(c.path) END pdf_path
        FROM b JOIN c ON b.id = c.id AND b.y IS NOT DISTINCT FROM c.y AND b.a = c.a AND b.tw = c.tw AND b.rd IS NOT DISTINCT FROM c.rd AND c.rank = b.low GROUP BY b.id, b.y, b.a, b.tw, b.rd),
      every AS (SELECT DISTINCT e.id, coalesce(z.source_kind, 'not-found') source_kind, z.pdf_path FROM (SELECT DISTINCT id FROM reference_entries) e LEFT JOIN z USING (id))"""


LIBRARY_SQL = f"WITH {_library_sql(True)} SELECT id, source_kind, pdf_path, CASE WHEN source_kind = 'ambiguous' OR source_kind LIKE '%-yearfuzzy' OR pdf_path IS NULL THEN 'WARN' ELSE 'PASS' END AS verdict FROM every"


# --- paraphrases ---------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(_read(spark, sf_dir, "paraphrase_matches").select(F.col("id").alias("match_id"), "paraphrase_text", "extracted_quote").distinct())


def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of a paraphrase and the size of the quote they select, from a source with frontmatter, long enough for windows."""
    words = paraphrase.keywords(F.col("paraphrase_text"))
    source = F.concat(F.lit("---\ntitle: x\n---\n"), F.repeat(F.concat("extracted_quote", F.lit(" ")), 4))
    return _pairs(spark, sf_dir).select("match_id", F.array_join(words, " ").alias("keywords"), paraphrase.source_quote(source, words).alias("quote"))


KEYWORD_SQL = rf"""WITH t AS (SELECT DISTINCT id, paraphrase_text p, extracted_quote q FROM paraphrase_matches),
    w AS (SELECT id, ltrim(repeat(q || ' ', 4), chr(10)) b, list_filter(regexp_extract_all(p, '\b([A-Za-z][A-Za-z\-]{{3,}})\b'), lambda x: NOT list_contains(['{"', '".join(paraphrase.STOPWORDS)}'], lower(x))) ws FROM t),
    k AS (SELECT id, b, lower(b) low, list_filter(ws, lambda x, i: list_position(list_transform(ws, lambda y: lower(y)), lower(x)) = i)[1:{paraphrase.MAX_KEYWORDS}] ks FROM w),
    s AS (SELECT *, unnest(CASE WHEN length(b) > {paraphrase.WINDOW} AND len(ks) > 0 THEN range(0, length(b) - {paraphrase.WINDOW} + 1, {paraphrase.WINDOW // 5}) ELSE [0] END) s FROM k),
    h AS (SELECT *, len(list_filter(ks, lambda x: contains(substr(low, s + 1, {paraphrase.WINDOW}), lower(x)))) n FROM s), m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id, b ORDER BY n DESC, s) = 1)
    SELECT id AS match_id, array_to_string(ks, ' ') AS keywords, CASE WHEN b IS NULL THEN NULL WHEN coalesce(len(ks), 0) = 0 THEN substr(b, 1, 3000) WHEN length(b) <= {paraphrase.WINDOW} THEN b WHEN n < 1 THEN substr(b, 1, 3000)
      ELSE substr(b, greatest(s - {paraphrase.WINDOW // 4}, 0) + 1, least(s + {paraphrase.WINDOW} + {paraphrase.WINDOW // 4}, length(b)) - greatest(s - {paraphrase.WINDOW // 4}, 0)) END AS quote FROM m"""


def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a paraphrase's long words in its quote."""
    return paraphrase.score_pairs(_pairs(spark, sf_dir)).select("match_id", "score")


LEXICAL_SQL = rf"""WITH t AS (SELECT DISTINCT id, paraphrase_text p, extracted_quote q FROM paraphrase_matches), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(p), '{SPACE}+'), lambda x: length(x) > 3)) own FROM t)
    SELECT id AS match_id, CASE WHEN p <> '' AND q <> '' AND len(own) > 0 THEN len(list_filter(own, lambda x: contains(lower(q), x)))::DOUBLE / len(own) END AS score FROM w"""


def json_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of every shape: valid, of a call that failed, text for a number, a broken object before a valid one, no object."""
    rows = _read(spark, sf_dir, "paraphrase_matches").select("id", "score").distinct()
    value = F.coalesce(F.col("score").cast("string"), F.lit("null"))
    kind = F.pmod(F.substring_index("id", "-", -1).cast("int"), F.lit(6))
    good = F.concat(F.lit('The answer: {"note": "a } b", "score": '), value, F.lit("} done"))
    response = F.when(kind == 2, F.concat(F.lit('{"score": "'), value, F.lit('"}'))).when(kind == 3, F.concat(F.lit('{oops} {"score": '), value, F.lit("}"))).when(kind == 4, F.lit("no object")).when(kind == 5, F.concat(F.lit('{"score": true, "other": '), value, F.lit("}"))).otherwise(good)
    return rows.select(F.col("id").alias("match_id"), paraphrase.json_score(response, F.when(kind == 1, 1).otherwise(0)).alias("score"))


JSON_SQL = "SELECT DISTINCT id AS match_id, CASE WHEN CAST(string_split(id, '-')[-1] AS INTEGER) % 6 = 0 AND score BETWEEN 0 AND 1 THEN score END AS score FROM paraphrase_matches"


def paraphrase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches per decided status."""
    rows = _read(spark, sf_dir, "paraphrase_matches").select("id", "status", "score").distinct()
    return gates.ordered_counts(rows.withColumn("status", paraphrase.fold_in(F.col("status"), F.col("score"))), "status", "id")


PARAPHRASE_COUNTS_SQL = "SELECT CASE WHEN NOT coalesce(status IN ('PASS', 'FAIL', 'WARN', 'MANUAL'), false) OR (status = 'PASS' AND NOT coalesce(score BETWEEN 0 AND 1, false)) THEN 'FAIL' ELSE status END AS status, count(*) AS n FROM (SELECT DISTINCT id, status, score FROM paraphrase_matches) GROUP BY 1"


def purpose_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purposes with the answers of a classifier: here the table's own purpose, for every other citation."""
    rows = _read(spark, sf_dir, "in_text_citations").select("id", "citation_purpose", "citation_type").distinct()
    heuristic = F.when(F.col("citation_type") == "narrative", "finding-cite").otherwise("theory-cite")
    purpose, origin = paraphrase.augmented_purpose(heuristic, F.col("citation_purpose"))
    return rows.select(F.col("id").alias("citation_id"), purpose.alias("purpose"), origin.alias("origin"))


ORIGIN_SQL = """SELECT DISTINCT id AS citation_id, CASE WHEN citation_type = 'narrative' THEN CASE WHEN citation_purpose IN ('finding-cite', 'method-cite', 'theory-cite', 'background-cite') THEN citation_purpose ELSE 'finding-cite' END ELSE 'theory-cite' END AS purpose,
      CASE WHEN citation_type = 'narrative' THEN CASE WHEN citation_purpose IN ('finding-cite', 'method-cite', 'theory-cite', 'background-cite') THEN 'classifier' ELSE 'fallback' END ELSE 'heuristic' END AS origin FROM (SELECT DISTINCT id, citation_purpose, citation_type FROM in_text_citations)"""


def page_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a manuscript as the pages of a file, sliced at a hint."""
    docs = _read(spark, sf_dir, "documents").where("manuscript_id is not null").select(F.col("manuscript_id").alias("path"), F.col("doc_id").cast("int").alias("page_no"), "text").distinct()
    hints = docs.groupBy("path").agg(F.min("page_no").alias("page_hint"))
    return paraphrase.page_slice(docs, hints).select("path", F.sha2("text", 256).alias("digest"))


PAGES_SQL = """WITH d AS (SELECT DISTINCT manuscript_id m, doc_id n, coalesce(text, '') t FROM documents WHERE manuscript_id IS NOT NULL), h AS (SELECT m, min(n) h FROM d GROUP BY m)
    SELECT m AS path, sha256(string_agg(t, chr(10) ORDER BY n)) AS digest FROM d JOIN h USING (m) WHERE abs(n - h) <= 1 GROUP BY m"""


def paraphrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with a file compared with its quote: score and status."""
    cited = _read(spark, sf_dir, "in_text_citations").select("id", "ref_id", "citation_purpose", "context_paraphrase").distinct()
    files = _read(spark, sf_dir, "source_pdfs").select("id", "ref_id", "pdf_path").distinct()
    texts = _read(spark, sf_dir, "source_pdfs").where("pdf_path is not null").groupBy(F.col("pdf_path").alias("path")).agg(F.max("extracted_quote").alias("text"))
    return paraphrase.match_paraphrases(cited, files, texts).select("citation_id", "pdf_path", "threshold_applied", "score", "status")


MATCH_SQL = rf"""WITH c AS (SELECT DISTINCT id, ref_id, citation_purpose u, context_paraphrase p FROM in_text_citations WHERE ref_id IS NOT NULL), l AS (SELECT ref_id, arg_max(pdf_path, id) pdf_path FROM source_pdfs WHERE ref_id IS NOT NULL AND pdf_path IS NOT NULL GROUP BY ref_id),
    x AS (SELECT pdf_path, max(extracted_quote) t FROM source_pdfs WHERE pdf_path IS NOT NULL GROUP BY pdf_path), b AS (SELECT c.*, l.pdf_path, x.t FROM c JOIN l USING (ref_id) LEFT JOIN x USING (pdf_path)),
    h AS (SELECT *, CASE WHEN u = 'finding-cite' THEN 0.85::DOUBLE WHEN u IN ('method-cite', 'theory-cite') THEN 0.40::DOUBLE END th, list_distinct(list_filter(regexp_split_to_array(lower(p), '{SPACE}+'), lambda w: length(w) > 3)) own FROM b),
    q AS (SELECT *, CASE WHEN th IS NOT NULL THEN t END quote FROM h), s AS (SELECT *, CASE WHEN p <> '' AND quote <> '' AND len(own) > 0 THEN len(list_filter(own, lambda w: contains(lower(quote), w)))::DOUBLE / len(own) END score FROM q)
    SELECT id AS citation_id, pdf_path, th AS threshold_applied, score, CASE WHEN th IS NULL THEN 'MANUAL' WHEN coalesce(score >= th, false) THEN 'PASS' ELSE 'FAIL' END AS status FROM s"""


def queries() -> dict[str, Query]:
    plain = (
        decide_claims, decide_counts, claim_values, claim_numbers, number_primitives, truth_build, truth_summary, truth_sections, truth_gate_result, truth_coverage, reference_fields, reference_list, library_match, library_by_author,
        keyword_extract, lexical_scores, json_score, paraphrase_counts, purpose_origin, page_slices, paraphrase_match, manuscripts_once, frontmatter_values,
    )
    return {f.__name__: f for f in plain}


def oracle_sql() -> dict[str, str]:
    return {
        "decide_claims": DECIDE_SQL, "decide_counts": f"SELECT matched_dv, status, count(*) AS n FROM ({DECIDE_SQL}) GROUP BY ALL", "claim_values": _values_sql(), "claim_numbers": NUMBERS_SQL, "number_primitives": PRIMITIVES_SQL,
        "truth_build": TRUTH_BUILD_SQL, "truth_summary": SUMMARY_SQL, "truth_sections": SUMMARY_SQL, "truth_coverage": "SELECT manuscript_id, count(DISTINCT dv) AS n_measures, array_to_string(list_sort(list(DISTINCT dv)), ', ') AS measures FROM gt_rows WHERE manuscript_id IS NOT NULL AND dv IS NOT NULL GROUP BY manuscript_id",
        "truth_gate_result": "SELECT 'ground-truth' AS target_type, 'ground-truth' AS target_id, 'ground-truth-gate' AS verifier, 'FAIL' AS status WHERE (SELECT count(*) FROM numerical_claims) > 0",
        "reference_fields": FIELDS_SQL, "reference_list": LIST_SQL, "library_match": LIBRARY_SQL, "library_by_author": f"WITH {_library_sql(False)} SELECT id, pdf_path FROM every", "keyword_extract": KEYWORD_SQL, "lexical_scores": LEXICAL_SQL,
        "json_score": JSON_SQL, "paraphrase_counts": PARAPHRASE_COUNTS_SQL, "purpose_origin": ORIGIN_SQL, "page_slices": PAGES_SQL, "paraphrase_match": MATCH_SQL,
        "manuscripts_once": ONCE_SQL, "frontmatter_values": FRONTMATTER_SQL,
    }
