"""Claims decided against ground truth by one ordered chain of cases."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.functions.text import half_ulp_equal, last_match, printed_digits, rfind, rounded, trie_pattern

NO_TABLE = ("alpha", "N")
NEEDS_SPAN = ("p_value", "CI_pair", "M_mean", "SD", "percent")


@dataclass(frozen=True)
class DecisionRules:
    """What a project configures; the defaults are the generic ones."""

    dv_keywords: tuple[tuple[str, str], ...] = ()
    modifier_keywords: tuple[str, ...] = ("interaction", "×", "approached significance", "spearman", "correlation between")
    condition_labels: tuple[str, ...] = ()
    percent_dvs: tuple[str, ...] = ()
    n_contexts: dict[str, int] = field(default_factory=dict)
    alpha_values: dict[str, float] = field(default_factory=dict)


def infer_measure(text: Column, keywords: tuple[tuple[str, str], ...]) -> Column:
    """The measure whose keywords a text contains, ignoring case; null unless it is exactly one."""
    by_word: dict[str, set[str]] = {}
    for dv, k in keywords:
        if k:
            by_word.setdefault(k.lower(), set()).add(dv)
    everywhere = sorted({dv for dv, k in keywords if not k})
    if not by_word:
        return F.lit(everywhere[0] if len(everywhere) == 1 else None).cast("string")
    # one search gives the longest keyword at each place; shorter ones there are its beginnings
    meant = {k: sorted(set().union(everywhere, *(by_word[k[:n]] for n in range(1, len(k) + 1) if k[:n] in by_word))) for k in by_word}
    measures = F.from_json(F.lit(json.dumps(meant)), "map<string,array<string>>")
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=({trie_pattern(list(by_word))}))"), 1))
    found = F.array_distinct(F.flatten(F.transform(words, lambda w: F.element_at(measures, w))))
    if everywhere:
        found = F.array_union(found, F.array(*map(F.lit, everywhere)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def claim_span(snippet: Column, raw: Column, start: Column, end: Column) -> Column:
    """Start of the claim in its line: by valid offsets, without offsets by its only occurrence; else null."""
    valid = start.isNotNull() & end.isNotNull() & (start >= 0) & (end <= F.length(snippet)) & (start < end)
    by_offset = F.when(valid & (F.substring(snippet, start + 1, end - start) == raw), start)
    times = (F.length(snippet) - F.length(F.replace(snippet, raw, F.lit("")))) / F.greatest(F.length(raw), F.lit(1))
    unique = F.when((F.length(raw) > 0) & (times == 1), F.instr(snippet, raw) - 1)
    return F.when(start.isNull() & end.isNull(), unique).otherwise(by_offset)


def _result(status: str | Column, evidence: str, expected: Column | None = None, computed: Column | None = None, dv: Column | None = None) -> Column:
    null = F.lit(None).cast("double")
    e, c = (null if expected is None else expected.cast("double")), (null if computed is None else computed.cast("double"))
    return F.struct(
        (F.lit(status) if isinstance(status, str) else status).alias("status"), F.lit(evidence).alias("evidence"), e.alias("expected_value"), c.alias("computed_value"),
        F.when(e.isNotNull() & c.isNotNull(), F.abs(c - e)).alias("delta"), (F.lit(None).cast("string") if dv is None else dv).alias("matched_dv"),
    )


def _pass_if(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), "PASS").otherwise("FAIL")


def decide(claims: DataFrame, truth: DataFrame, rules: DecisionRules) -> DataFrame:
    """Exactly one result per claim: ``claims`` columns plus status, evidence, expected_value, computed_value, delta, matched_dv.

    ``claims``: claim_type, parsed_value, raw_text, context_snippet, start_pos,
    end_pos, raw_values.  ``truth`` has one row per measure and is small, so it
    is broadcast when its size allows; the cases are evaluated in order and
    every arm is safe for nulls.
    """
    from quillcheck.session import broadcast_if_small

    snippet = F.coalesce("context_snippet", "raw_text", F.lit(""))
    raw = F.coalesce("raw_text", F.lit(""))
    base = claims.withColumns({"_snippet": snippet, "_raw": raw}).withColumn("_dv", infer_measure(F.concat("_snippet", F.lit(" "), "_raw"), rules.dv_keywords))
    t = truth.select(F.col("dv").alias("_tdv"), F.struct(*[c for c in truth.columns if c != "dv"]).alias("_t"))
    base = base.join(broadcast_if_small(t), F.col("_dv") == F.col("_tdv"), "left")
    base = base.withColumn("_start", claim_span(F.col("_snippet"), F.col("_raw"), F.col("start_pos"), F.col("end_pos")))
    kind, dv, low = F.col("claim_type"), F.col("_dv"), F.lower("_snippet")
    p = lambda f: F.col(f"parsed_value.{f}")
    g = lambda f: F.col(f"_t.{f}")
    digits = printed_digits(F.col("_raw"))

    modifier = F.lit(False)
    for k in rules.modifier_keywords:
        modifier = modifier | F.contains(low, F.lit(k))

    # p values belong to the rank test if it is named nearer before the claim
    scope = F.lower(F.substring("_snippet", F.lit(1), F.col("_start") + F.length("_raw")))
    rank_test = F.greatest(rfind(scope, "wilcoxon"), rfind(scope, "*v*"), last_match(scope, r"(?<![a-z])v\s*="))
    f_test = F.greatest(rfind(scope, "*f*"), last_match(scope, r"(?<![a-z])f\s*\("))
    p_expected = F.when(rank_test > f_test, g("p_wil")).otherwise(g("p_r"))

    # reliabilities
    observed_alpha = p("alpha")
    key = F.when(low.contains("kr-20") | low.contains("test a"), "learning_A").when(low.contains("test b"), "learning_B").when((dv == "learning") & (observed_alpha > 0) & (observed_alpha < 0.05), "learning_A").otherwise(dv)
    alphas = rules.alpha_values
    alpha_truth = F.lit(None).cast("double")
    for k, v in sorted(alphas.items()):
        alpha_truth = F.when(key == k, F.lit(float(v))).otherwise(alpha_truth)
    other_alpha = F.lit(False)
    for v in sorted(set(alphas.values())):
        other_alpha = other_alpha | (F.abs(observed_alpha - float(v)) <= 0.001)

    # sample sizes
    has = lambda *ws: _any(low, ws)
    counts = rules.n_contexts
    n_truth_of = lambda c: F.lit(counts.get(c)).cast("int")
    context = (
        F.when(has("pilot"), "pilot").when(has("g*power", "g power", "a priori"), "power").when(has("analytic", "final", "yielding", "excluded"), "analytic")
        .when(has("recruited", "collected"), "collected").when(p("n") == n_truth_of("analytic"), "analytic")
    )
    n_truth = F.lit(None).cast("int")
    for k, v in sorted(counts.items()):
        n_truth = F.when(context == k, F.lit(int(v))).otherwise(n_truth)
    other_n = p("n").isin(*[int(v) for v in counts.values()]) if counts else F.lit(False)

    # intervals
    before_claim = F.substring("_snippet", F.lit(1), F.col("_start"))
    earlier_pairs = F.regexp_count(before_claim, F.lit(r"(?U)\[\s*[+−-]?\d*\.?\d+\s*,\s*[+−-]?\d*\.?\d+\s*\]"))
    end_text = lambda k, i: F.coalesce(F.element_at("raw_values", F.lit(k)), F.nullif(F.regexp_extract("_raw", r"\[\s*([+−-]?\d*\.?\d+)\s*,\s*([+−-]?\d*\.?\d+)\s*\]", i), F.lit("")))
    both_ends = half_ulp_equal(p("ci_low"), g("ci_low"), printed_digits(end_text("ci_low", 1))) & half_ulp_equal(p("ci_high"), g("ci_high"), printed_digits(end_text("ci_high", 2)))

    # means, deviations, percentages by the nearest preceding condition
    labels = rules.condition_labels
    if len(labels) == 2:
        upto = F.lower(F.substring("_snippet", F.lit(1), F.col("_start")))
        at_a, at_b = rfind(upto, labels[0].lower()), rfind(upto, labels[1].lower())
        slot = F.when(at_a > at_b, "a").when(at_b > at_a, "b")
        label = F.when(slot == "a", labels[0]).when(slot == "b", labels[1])
    else:
        slot, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    wanted = F.when(kind == "SD", F.when(slot == "a", g("sd_hq")).otherwise(g("sd_lq"))).otherwise(F.when(slot == "a", g("m_hq")).otherwise(g("m_lq")))
    seen = F.when(kind == "M_mean", p("m")).when(kind == "SD", p("sd")).otherwise(p("pct"))
    tolerance = F.when(digits > 0, F.pow(F.lit(10.0), -digits) * 0.5 + 1e-9).otherwise(0.05)
    printed = F.when(digits > 0, rounded(wanted, digits)).otherwise(wanted)
    group = kind.isin("M_mean", "SD", "percent")

    # everything else compares one number
    expected = F.when(kind == "F_stat", g("f")).when(kind == "p_value", p_expected).when(kind == "beta", g("beta")).when(kind == "effect_dz", g("dz")).when(kind == "V_wilcoxon", g("v")).when(kind == "r_corr", g("r"))
    observed = F.when(kind == "F_stat", p("f")).when(kind == "p_value", p("p")).when(kind == "beta", p("beta")).when(kind == "effect_dz", p("dz")).when(kind == "V_wilcoxon", p("v")).when(kind == "r_corr", p("r"))
    close = F.abs(observed - expected) <= F.when(digits > 0, F.pow(F.lit(10.0), -digits) * 0.5 + 1e-9).otherwise(1e-9)
    df_differs = lambda f: F.coalesce(p(f) != g(f), F.lit(False))
    table = ~kind.isin(*NO_TABLE)

    decided = (
        F.when(kind.isNull() | F.col("parsed_value").isNull(), _result("WARN", "malformed claim"))
        .when((kind == "p_value") & p("op").isNotNull() & (p("op") != "="), _result("MANUAL", "an inequality", dv=dv))
        .when((kind == "p_value") & modifier, _result("MANUAL", "not a main effect", dv=dv))
        .when(table & F.col("_tdv").isNull(), _result("MANUAL", "no measure with ground truth"))
        .when(table & ((F.coalesce(F.size(g("validation_errors")), F.lit(0)) > 0) | (g("parity") == "✗")), _result("WARN", "ground truth invalid", dv=dv))
        .when(kind.isin(*NEEDS_SPAN) & F.col("_start").isNull(), _result("MANUAL", "claim not located in its line", dv=dv))
        .when((kind == "F_stat") & (df_differs("df1") | df_differs("df2")), _result("FAIL", "degrees of freedom differ", dv=dv))
        .when(kind == "p_adj", _result("MANUAL", "an adjusted p value", dv=dv))
        .when((kind == "CI_pair") & (low.contains("d_z") | low.contains(" dz ") | F.col("_snippet").contains("~z~")), _result("MANUAL", "an interval of an effect size", dv=dv))
        .when((kind == "CI_pair") & (earlier_pairs >= 1), _result("MANUAL", "a later interval of its line", dv=dv))
        .when((kind == "CI_pair") & (g("ci_low").isNull() | g("ci_high").isNull()), _result("MANUAL", "no interval in ground truth", dv=dv))
        .when((kind == "CI_pair") & (p("ci_low").isNull() | p("ci_high").isNull()), _result("WARN", "interval not read", dv=dv))
        .when((kind == "CI_pair") & (end_text("ci_low", 1).isNull() | end_text("ci_high", 2).isNull()), _result("WARN", "printed ends unknown", dv=dv))
        .when(kind == "CI_pair", _result(_pass_if(both_ends), "both ends at their printed digits", dv=dv))
        .when((kind == "alpha") & alpha_truth.isNull(), _result("MANUAL", "no reliability in ground truth", dv=key))
        .when((kind == "alpha") & (F.abs(observed_alpha - alpha_truth) <= 0.001), _result("PASS", "reliability", alpha_truth, observed_alpha, key))
        .when((kind == "alpha") & other_alpha, _result("MANUAL", "the reliability of another measure", alpha_truth, observed_alpha, key))
        .when(kind == "alpha", _result("FAIL", "reliability", alpha_truth, observed_alpha, key))
        .when((kind == "N") & n_truth.isNull(), _result("MANUAL", "no such sample in ground truth", dv=context))
        .when((kind == "N") & (p("n") == n_truth), _result("PASS", "sample size", n_truth, p("n"), context))
        .when((kind == "N") & other_n, _result("MANUAL", "the size of another sample", n_truth, p("n"), context))
        .when(kind == "N", _result("FAIL", "sample size", n_truth, p("n"), context))
        .when((kind == "percent") & ~_in(dv, rules.percent_dvs), _result("MANUAL", "not a measure in percent", dv=dv))
        .when(group & F.lit(len(labels) != 2), _result("MANUAL", "conditions are not configured", dv=dv))
        .when(group & slot.isNull(), _result("MANUAL", "condition unknown", dv=dv))
        .when(group & wanted.isNull(), _result("MANUAL", "no such mean in ground truth", dv=dv))
        .when(group & seen.isNull(), _result("WARN", "value not read", dv=dv))
        .when(group, _result(_pass_if(F.abs(printed - seen) <= tolerance), "at its printed digits", wanted, seen, F.concat_ws("_", dv, label)))
        .when(~kind.isin("F_stat", "p_value", "beta", "effect_dz", "V_wilcoxon", "r_corr"), _result("MANUAL", "no ground truth for this type", dv=dv))
        .when(expected.isNull() | observed.isNull(), _result("WARN", "value missing", expected, observed, dv))
        .otherwise(_result(_pass_if(close), "at its printed digits", expected, observed, dv))
    )
    return base.withColumn("_r", decided).select(*[F.col(f"`{c}`") for c in claims.columns], "_r.*")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _in(column: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(column.isin(*values), F.lit(False)) if values else F.lit(False)
