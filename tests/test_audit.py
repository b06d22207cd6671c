"""A small study audited from files to exit code."""

import json
import sys
from dataclasses import replace

import pytest

from quillcheck.plans import audit as A
from quillcheck.sources.config import load_config

MANUSCRIPT = """# Tea and typing

## Methods

We recruited 44 clerks (N = 44).
After exclusions the final analytic sample was N = 40.
The alertness scale was reliable (Cronbach's α = .77).

## Results

Alertness was higher with tea (TEA *M* = 6.10, *SD* = 1.02) than with water (WATER *M* = 5.20, *SD* = 1.11).
The effect on alertness was clear, *F*(1, 38) = 9.12, *p* = .005, β = 0.61, 95% CI [0.21, 1.01].
A Wilcoxon test on alertness agreed, *V* = 501, *p* = .004, *r* = .44, d_z = 0.48.

## Discussion

Earlier work found the same (Abel & Brown, 2019; Dvorak, 2021).
"""
REFERENCES = """# References

Abel, A., & Brown, B. (2019). Tea at work. *Desk Studies*, *3*(1), 1–9. https://doi.org/10.1234/desk.2019.1

Dvorak, C. (2021). Water at work. *Desk Studies*, *5*(2), 10–19. [TBD-DOI]

Ekman, D. (2018). Typing faster. *Desk Studies*, *2*(1), 5–8. https://doi.org/10.1234/desk.2018.7.
"""
STATS = """# Statistics

## p-value check

| DV | F | df1 | df2 | R p | scipy p | match |
|----|---|-----|-----|-----|---------|-------|
| Alertness | 9.121 | 1 | 38 | .004512 | .004513 | ✓ |
| Typing | 2.100 | 1 | 38 | .1555 | .1555 | ✗ |

## beta check

| DV | β | SE | CI | ok |
|----|---|----|----|----|
| Wachheit | +0.608 | 0.2 | [0.208, 1.008] | ✓ |

## Wilcoxon check

| DV | V | p | r | r CI | dz | dz CI | n |
|----|---|---|---|------|----|-------|---|
| Alertness | 501.0 | .004102 | +0.440 | [0.1, 0.7] | 0.482 | [0.1, 0.8] | 40 |
"""
SUMMARY = """## Alertness means

| Metric | TEA | WATER |
|--------|-----|-------|
| M (SD) | 6.10 (1.02) | 5.20 (1.11) |
"""
CONFIG = """
[project]
name = "tea"
manuscripts = ["*.ms.md"]
references = "refs.md"
stats = "stats.md"
summary_stats = "summary.md"
reports_dir = "out"

[stats]
condition_labels = ["TEA", "WATER"]

[stats.headings]
p_table = "p-value check"
beta_table = "beta check"
wilcoxon_table = "Wilcoxon check"

[stats.dv_keywords]
alertness = ["alertness", "alert"]
typing = ["typing speed"]

[stats.dv_aliases]
"Alertness" = "alertness"
"Wachheit" = "alertness"
"Typing" = "typing"

[stats.alpha]
alertness = 0.77

[stats.n]
analytic = 40
collected = 44

[stats.summary_sections]
"Alertness means" = "alertness"
"""


@pytest.fixture
def project(tmp_path):
    for name, text in (("study.ms.md", MANUSCRIPT), ("refs.md", REFERENCES), ("stats.md", STATS), ("summary.md", SUMMARY), ("q.toml", CONFIG)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    return tmp_path


def outcome(spark, project, **kw):
    a = A.run(spark, load_config(project / "q.toml"), **kw)
    return a, [(r.target_type, r.status, r.target_id) for r in a.results.collect()]


def test_everything_holds(spark, project):
    a, rows = outcome(spark, project)
    claims = {r.id: (r.claim_type, r.raw_text) for r in a.claims.collect()}
    bad = [(claims.get(i, i), s) for t, s, i in rows if t == "numerical-claim" and s != "PASS"]
    assert bad == []
    # 2 N, 1 α, 2 M, 2 SD, F, p, β, CI, V, p, r, dz
    assert sum(t == "numerical-claim" for t, _, _ in rows) == 15
    assert sorted(s for t, s, _ in rows if t == "reference-entry") == ["PASS", "PASS", "WARN", "WARN", "WARN", "WARN", "WARN"]
    assert not any(s == "FAIL" for _, s, _ in rows)
    # ids are numbered in order
    assert [r.id for r in a.results.orderBy("id").collect()] == [f"vr-{i:04d}" for i in range(1, len(rows) + 1)]
    assert sorted(r.id for r in a.citations.collect()) == ["cite-0001", "cite-0002"]
    assert sorted((r.id, r.ref_id) for r in a.files.collect()) == [("pdf-001", "Abel2019"), ("pdf-002", "Dvorak2021"), ("pdf-003", "Ekman2018")]
    assert [r.id for r in a.claims.orderBy("id").collect()] == [f"claim-{i:04d}" for i in range(1, 16)]


def test_errors_are_found(spark, project):
    text = MANUSCRIPT.replace("*p* = .005", "*p* = .050").replace("Abel & Brown, 2019", "Abell & Brown, 2019").replace("*SD* = 1.11", "*SD* = 1.91")
    (project / "study.ms.md").write_text(text, encoding="utf-8")
    _, rows = outcome(spark, project)
    assert sorted(t for t, s, _ in rows if s == "FAIL") == ["in-text-citation", "numerical-claim", "numerical-claim"]


def test_broken_truth_closes_the_gate(spark, project):
    (project / "stats.md").write_text(STATS.replace("| .004513 | ✓ |", "| — | ✓ |"), encoding="utf-8")
    _, rows = outcome(spark, project, phase=2)
    assert any(s == "WARN" and t == "numerical-claim" for t, s, _ in rows)
    assert ("phase-2", "FAIL", "phase-2") in rows  # no file, so no score


def test_nothing_found_is_a_failure(spark, project):
    (project / "study.ms.md").write_text("No numbers.\n", encoding="utf-8")
    _, rows = outcome(spark, project)
    assert ("coverage", "FAIL", "numerical-claims") in rows


def test_command_line(spark, project, capsys):
    (project / "long.md").write_text("x\n" * 86, encoding="utf-8")
    assert A.main(["--config", str(project / "q.toml"), "--check-summary-length", str(project / "long.md")]) == 1
    assert "Audit of tea" in capsys.readouterr().out
    assert list((project / "out").glob("*/summary.md"))
    assert A.main(["--config", str(project / "none.toml")]) == 2
    assert A.main(["--manuscript", str(project / "missing.md")]) == 2
    assert A.main(["--manuscript", str(project / "*.nothing")]) == 2
    folder = next((project / "out").glob("*"))
    assert json.loads((folder / "manifest.json").read_text())["project"] == "tea"
    text = (folder / "summary.md").read_text()
    assert "## Ground truth\n\n2 measures: alertness, typing" in text and "## Library\n\n- not-found: 3" in text
    for extra in ('[library]\nroot = "nowhere"\n', '[llm]\nprovider = "nobody"\n'):
        (project / "bad.toml").write_text(CONFIG + extra, encoding="utf-8")
        assert A.main(["--config", str(project / "bad.toml")]) == 2


def test_an_error_in_phase_2_is_a_failed_result(spark, project):
    def broken(paraphrase, raw):
        raise ValueError("the classifier broke")

    (project / "lib").mkdir()
    (project / "lib" / "2019_Abel_Tea_at_work.md").write_text("Earlier work found the same.", encoding="utf-8")
    config = replace(load_config(str(project / "q.toml")), library=str(project / "lib"))
    b = A.run(spark, config, phase=2, classifier=broken)
    failed = [r for r in b.results.collect() if r.target_type == "phase-2"]
    assert [(r.target_id, r.status) for r in failed] == [("paraphrase-matching", "FAIL")] and b.matches is None
    assert "ValueError: the classifier broke" in failed[0].evidence
    assert any(r.target_type == "numerical-claim" and r.status == "PASS" for r in b.results.collect())
    # without a scorer nothing is scored, and what needs a score fails
    c = A.run(spark, config, phase=2, scorer=None)
    assert {(r.status, r.score) for r in c.matches.where("citation_purpose <> 'background-cite'").collect()} <= {("FAIL", None)}
    assert ("phase-2", "FAIL") in {(r.target_type, r.status) for r in c.results.collect()}


def test_providers():
    from quillcheck.sources import providers as P

    assert P.resolve("none") is None and P.resolve(None) is None and P.resolve("lexical") is None
    assert P.resolve("codex").argv[0] == "codex" and P.resolve("none", ("x",)).name == "custom"
    with pytest.raises(ValueError):
        P.resolve("nobody")
    answers = lambda text, code=0: P.Provider("x", (sys.executable, "-c", f"import sys; sys.stdin.read(); print({text!r}); sys.exit({code})"))
    assert P.scorer_of(answers('{"score": 0.5}'))("a", "b") == 0.5
    assert P.scorer_of(answers('{"score": 0.5}', 1))("a", "b") is None
    assert P.scorer_of(P.Provider("x", ("/no/such/program",)))("a", "b") is None
    assert P.scorer_of(P.Provider("x", (sys.executable, "-c", "import time; time.sleep(9)"), 1))("a", "b") is None
    assert P.scorer_of(None) is None and P.scorer_of(None, "lexical") is not None
    assert P.classifier_of(answers('{"purpose": "method-cite"}'))("a", "b") == "method-cite"
    assert P.classifier_of(answers('{"purpose": "fun-cite"}'))("a", "b") is None and P.classifier_of(None) is None


def test_paraphrase_is_scored_whole(spark):
    from quillcheck.operators import paraphrase

    line = "shared words here " * 20 + "elsewhere unmatched telescope"
    cited = spark.createDataFrame([("c1", "r1", "finding-cite", line)], "id string, ref_id string, citation_purpose string, context_paraphrase string")
    files = spark.createDataFrame([("f1", "r1", "/l/a.md")], "id string, ref_id string, pdf_path string")
    got = paraphrase.match_paraphrases(cited, files, spark.createDataFrame([("/l/a.md", "shared words here " * 40)], "path string, text string")).first()
    assert (got.score, got.status) == (0.5, "FAIL")
    assert got.paraphrase_text == line[:300] and len(got.extracted_quote) == 300


def test_pdf_sources_and_classifier_in_phase_2(spark, project):
    (project / "lib").mkdir(exist_ok=True)
    (project / "lib" / "2019_Abel_Tea_at_work.pdf").write_bytes(b"%PDF-1.4")
    config = replace(load_config(str(project / "q.toml")), library=str(project / "lib"))
    told = "Earlier work found the same (Abel & Brown, 2019; Dvorak, 2021)."
    read = lambda spark, paths: spark.createDataFrame([(p, n, told if n == 15 else f"page {n}") for p in paths for n in range(1, 18)], "path string, page_no int, text string")

    def ask(purpose):
        return A.run(spark, config, phase=2, classifier=lambda paraphrase, raw: purpose, pages=read).matches.where("pdf_path like '%.pdf'").collect()

    got = ask("finding-cite")
    assert got and all(r.citation_purpose == "background-cite" or ("Earlier work" in r.extracted_quote and r.score is not None) for r in got)
    assert any(r.status == "PASS" and r.citation_purpose == "finding-cite" for r in got)
    assert {r.status for r in ask("background-cite")} == {"MANUAL"}
