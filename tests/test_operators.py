"""Extraction, truth, decisions, references, citations, library, paraphrases, gates and sources."""

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import text as X
from quillcheck.operators import citations as cit
from quillcheck.operators import gates, paraphrase
from quillcheck.operators import references as ref
from quillcheck.operators.claims import PATTERNS, extract_claims, number_claims, text_lines, without_duplicate_manuscripts
from quillcheck.operators.decide import DecisionRules, decide, infer_measure
from quillcheck.operators.library import attached, find_by_author_year, match_library
from quillcheck.operators.truth import has_usable_truth, mean_sd_cell, table_rows
from quillcheck.schemas import CLAIM, TRUTH
from quillcheck.session import numbered
from quillcheck.sources import files as src


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_text_primitives(spark):
    lines = values(spark, X.lines_of(F.col("t")), [("a\r\nb\x0bc\n",), ("",), ("x",), (None,), ("\n\n",)], "t string")
    assert lines == [["a", "b", "c"], [], ["x"], None, ["", ""]]
    spans = values(spark, X.spans(F.col("t"), r"a+"), [("🙂aa-a",), ("b",)], "t string")
    assert [[(s.raw, s.start, s.end) for s in r] for r in spans] == [[("aa", 1, 3), ("a", 4, 5)], []]
    assert values(spark, X.rfind(F.col("t"), "ab"), [("abcab",), ("x",)], "t string") == [3, -1]
    assert values(spark, X.to_number(F.col("t")), [("−.5",), ("*3*",), ("—",), ("5f",), ("NaN",), ("1e3",), ("✓",)], "t string") == [-0.5, 3.0, None, None, None, 1000.0, None]
    assert values(spark, X.rounded(F.col("x"), F.col("d")), [(2.675, 2), (0.435, 2), (1234.5678, 1), (2.5, 0)], "x double, d int") == [2.67, 0.43, 1234.6, 2.0]
    assert values(spark, X.half_ulp_equal(F.col("a"), F.col("b"), F.lit(2)), [(0.43, 0.435), (0.44, 0.435), (0.42, 0.435), (None, 1.0)], "a double, b double") == [True, True, False, False]


@pytest.mark.parametrize(
    "text, kind, raw, parsed",
    [
        ("*F*(1, 36) = 7.63", "F_stat", "*F*(1, 36) = 7.63", {"df1": 1, "df2": 36, "f": 7.63}), ("p_adj = .04", "p_adj", "p_adj = .04", {"p_adj": 0.04}), ("*p* < .001", "p_value", "*p* < .001", {"op": "<", "p": 0.001}),
        ("β = −4.16", "beta", "β = −4.16", {"beta": -4.16}), ("*d_z* = −0.13", "effect_dz", "*d_z* = −0.13", {"dz": -0.13}), ("α = .689", "alpha", "α = .689", {"alpha": 0.689}), ("partial η² = .12", "eta_squared", "partial η² = .12", {"eta_sq": 0.12}),
        ("N = 38", "N", "N = 38", {"n": 38}), ("*V* = 455.0", "V_wilcoxon", "*V* = 455.0", {"v": 455.0}), ("*M* = 4.5", "M_mean", "*M* = 4.5", {"m": 4.5}), ("*SD* = 1", "SD", "*SD* = 1", {"sd": 1.0}), ("[0.1, −.2]", "CI_pair", "[0.1, −.2]", {"ci_low": 0.1, "ci_high": -0.2}),
        ("8.52 %", "percent", "8.52 %", {"pct": 8.52}), ("ρ = −.108", "rho", "ρ = −.108", {"rho": -0.108}), ("IRR = 0.7", "IRR", "IRR = 0.7", {"irr": 0.7}), ("*r* = .53", "r_corr", "*r* = .53", {"r": 0.53}),
    ],
)
def test_claim_types(spark, text, kind, raw, parsed):
    rows = [r for r in extract_claims(spark.createDataFrame([("m", text)], "manuscript_id string, text string")).collect() if r.claim_type == kind]
    assert [r.raw_text for r in rows] == [raw]
    assert {k: v for k, v in rows[0].parsed_value.asDict().items() if v is not None} == parsed
    assert rows[0].context_snippet[rows[0].start_pos : rows[0].end_pos] == raw


def test_claims_are_numbered_over_manuscripts(spark):
    ms = spark.createDataFrame([("m1", 1, "body", "N = 1 and N = 2\nN = 3"), ("m2", 2, "combined", "N = 4"), ("m3", 3, "results", None)], "manuscript_id string, ms_ord int, section string, text string")
    claims = number_claims(extract_claims(text_lines(ms)))
    assert [(r.id, r.raw_text) for r in claims.orderBy("id").collect()] == [(f"claim-000{i}", f"N = {i}") for i in range(1, 5)]
    assert without_duplicate_manuscripts(text_lines(ms)).where("section = 'combined'").count() == 1
    sections = text_lines(ms.withColumn("section", F.when(F.col("section") == "body", "intro").otherwise(F.col("section"))))
    assert without_duplicate_manuscripts(sections).where("section = 'combined'").count() == 0
    assert extract_claims(text_lines(ms.limit(0))).count() == 0


def test_markdown_tables(spark):
    text = "## T one\nintro\n| DV | x |\n|----|---|\n| a | 1 |\n| :-: | - |\n| T one | 2 |\n| b | 3 |\n\n| c | 4 |"
    lines = text_lines(spark.createDataFrame([(text,)], "text string"), keep=())
    assert [r.cells for r in table_rows(lines, "T one").collect()] == [["a", "1"], ["b", "3"]]
    assert table_rows(lines, "absent").count() == 0
    cells = values(spark, mean_sd_cell(F.col("c")), [("8.52% (1.2)",), ("−.5 (.1)",), ("x",)], "c string")
    assert [(c.m, c.sd) if c else None for c in cells] == [(8.52, 1.2), (-0.5, 0.1), None]


RULES = DecisionRules(
    dv_keywords=(("ecl", "extraneous"), ("learning", "learning")), condition_labels=("HQ", "LQ"), percent_dvs=("learning",), n_contexts={"analytic": 38, "collected": 40, "excluded": 2, "power": 34, "pilot": 8},
    alpha_values={"ecl": 0.938, "learning": 0.582, "learning_A": 0.010},
)
ECL = {"dv": "ecl", "f": 7.634, "df1": 1, "df2": 36, "p_r": 0.008965, "p_scipy": 0.008966, "beta": -4.161, "se": 0.2, "ci_low": 0.167, "ci_high": 0.982, "v": 455.0, "p_wil": 0.007223, "r": 0.529, "dz": 0.44, "parity": "✓", "m_hq": 8.52, "sd_hq": 1.1, "m_lq": 4.60, "sd_lq": 1.2, "validation_errors": []}
BAD = {"dv": "learning", "f": 1.0, "parity": "✗", "validation_errors": ["x"]}


def verdicts(spark, text, kind, rows=(ECL, BAD)):
    truth = spark.createDataFrame([tuple(r.get(f.name) for f in TRUTH) for r in rows], TRUTH)
    claims = extract_claims(spark.createDataFrame([("m", text)], "manuscript_id string, text string")).where(F.col("claim_type") == kind)
    return [(r.status, r.matched_dv) for r in decide(claims, truth, RULES).orderBy("start_pos").collect()]


@pytest.mark.parametrize(
    "text, kind, want",
    [
        ("extraneous load *F*(1, 36) = 7.63", "F_stat", ["PASS"]), ("extraneous load *F*(1, 36) = 6.50", "F_stat", ["FAIL"]), ("extraneous load *F*(2, 36) = 7.63", "F_stat", ["FAIL"]), ("some load *F*(1, 36) = 7.63", "F_stat", ["MANUAL"]),
        ("learning *F*(1, 36) = 7.63", "F_stat", ["WARN"]), ("extraneous β = −4.16", "beta", ["PASS"]), ("extraneous 95% CI [0.16, 0.98]", "CI_pair", ["FAIL"]), ("extraneous 95% CI [0.2, 0.98]", "CI_pair", ["PASS"]), ("extraneous [0, 0.98]", "CI_pair", ["PASS"]),
        ("extraneous [0.17, 0.98] and [0.17, 0.98]", "CI_pair", ["PASS", "MANUAL"]), ("extraneous *F*(1, 36) = 7.63, *p* = .009; Wilcoxon *V* = 455, *p* = .009", "p_value", ["PASS", "FAIL"]), ("extraneous *p* < .05", "p_value", ["MANUAL"]),
        ("extraneous interaction *p* = .009", "p_value", ["MANUAL"]), ("analytic sample N = 38", "N", ["PASS"]), ("analytic sample N = 37", "N", ["FAIL"]), ("analytic sample N = 40", "N", ["MANUAL"]), ("recruited N = 40", "N", ["PASS"]),
        ("extraneous α = .938", "alpha", ["PASS"]), ("extraneous α = .582", "alpha", ["MANUAL"]), ("extraneous α = .7", "alpha", ["FAIL"]), ("extraneous HQ *M* = 8.52 ; LQ *M* = 8.52", "M_mean", ["PASS", "FAIL"]), ("extraneous *M* = 8.52", "M_mean", ["MANUAL"]),
        ("extraneous HQ 8.52%", "percent", ["MANUAL"]), ("extraneous η² = .1", "eta_squared", ["MANUAL"]), ("extraneous p_adj = .1", "p_adj", ["MANUAL"]), ("extraneous *r* = .53, *d_z* = 0.44, *V* = 455", "r_corr", ["PASS"]),
    ],
)
def test_decisions(spark, text, kind, want):
    assert [s for s, _ in verdicts(spark, text, kind)] == want


def test_malformed_claims_and_empty_truth(spark):
    rows = [("c1", None, None, None), ("c2", "beta", None, "β = 1")]
    claims = spark.createDataFrame(rows, "id string, claim_type string, raw_text string, context_snippet string").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in CLAIM if f.name in ("parsed_value", "start_pos", "end_pos", "raw_values")])
    assert [r.status for r in decide(claims, spark.createDataFrame([], TRUTH), RULES).collect()] == ["WARN", "WARN"]
    assert not has_usable_truth(spark.createDataFrame([], TRUTH)).first().usable


def test_references(spark):
    text = "---\ntotal: 3\n---\n# References\n\nAbel-Moe, A., & Brown, B. (2024a). Tea. At work. *Desk*, *3*(1), 1–9. https://doi.org/10.1/x.y.\n\n> note\n\nR Core Team (2023). R: A language. https://doi.org/10.2/r\n\nÉmile (2020). Lost. *J*, 1.\n\nDahl, C. (2021). Water [TBD-DOI]. *Desk*, 5.\n> see also"
    rows = ref.parse_references(ref.reference_chunks(spark.createDataFrame([(text,), (None,)], "text string"))).orderBy("ref_ord").collect()
    assert [(r.id, r.doi, r.status, r.journal, r.notes) for r in rows] == [("AbelMoe2024a", "10.1/x.y", "doi-present", "Desk", ""), ("RCoreTeam2023", "10.2/r", "doi-present", "", ""), ("Dahl2021", None, "tbd-doi", "Desk", "see also")]


def test_citations(spark):
    lines = [
        (1, "As (CTML; Mayer, 2009) and (Xu et al., 2022; Li & Moe, 2024a) found"), (2, "García (2019) and Mori (1970/2012) used a scale"), (3, "> Quoted (Xu, 2022)"), (4, "(N = 38), (in fact), (DHAs)"), (5, "Inline > kept (Xu, 2022, p. 14)"), (6, None), (7, "Abel et al.'s (2020) theory"),
    ]
    rows = cit.extract_citations(spark.createDataFrame(lines, "line_no int, text string")).orderBy("line_no", "kind", "pos", "sub").collect()
    got = [(r.line_no, r.citation_type[0], r.first_author_last, r.year, r.year_suffix, r.year_alt) for r in rows]
    assert got == [(1, "p", "Mayer", 2009, "", None), (1, "p", "Xu", 2022, "", None), (1, "p", "Li", 2024, "a", None), (2, "n", "García", 2019, "", None), (2, "n", "Mori", 1970, "", 2012), (5, "p", "Xu", 2022, "", None), (7, "n", "Abel", 2020, "", None)]
    assert [r.citation_purpose for r in rows][:4] == ["theory-cite", "finding-cite", "finding-cite", "method-cite"]


def test_links(spark):
    refs = spark.createDataFrame([("Smith2024a", 1, "Smith", 2024, "a"), ("Smith2024b", 2, "Smith", 2024, "b"), ("Mori2012", 3, "Mori", 2012, ""), ("Xu2020a", 4, "Xu", 2020, "a"), ("Orphan1999", 5, "Orphan", 1999, "")], "id string, ref_ord int, first_author_last string, year int, year_suffix string")
    cites = spark.createDataFrame([("c1", "smith", 2024, "a", None), ("c2", "Smith", 2024, "", None), ("c3", "Mori", 1970, "", 2012), ("c4", "Xu", 2020, "", None), ("c5", "Nobody", 2000, "", None), ("c6", None, None, None, None)], "id string, first_author_last string, year int, year_suffix string, year_alt int")
    linked = cit.link_citations(cites, refs)
    assert {r.id: r.ref_id for r in linked.collect()} == {"c1": "Smith2024a", "c2": None, "c3": "Mori2012", "c4": "Xu2020a", "c5": None, "c6": None}
    assert {r.id for r in cit.dangling(linked).collect()} == {"c2", "c5", "c6"}
    assert {r.id for r in cit.uncited(refs, linked).collect()} == {"Smith2024b", "Orphan1999"}


def test_library(spark):
    refs = [("r1", "Abel", 2020, "Tea at work", None), ("r2", "김", 2021, "x", None), ("r3", "Li", 2019, "y", None), ("r4", "Dahl", 2018, "Deep water study", "10.5/abc"), ("r5", "---", 2020, "z", None), ("r6", "Egg", 2015, "q", None)]
    files = [("/l/2020_Abel_tea.pdf", "2020_Abel_tea", "pdf", None, None), ("/l/김_2022.md", "김_2022", "md", None, None), ("/l/Li_2019.md", "Li_2019", "md", None, None), ("/l/2019_Li_b.md", "2019_Li_b", "md", None, None), ("/l/unnamed.md", "unnamed", "md", "https://doi.org/10.5/ABC", None), ("/l/Dahl_2018.md", "Dahl_2018", "md", "10.9/other", None), ("/l/Egg_120156.md", "Egg_120156", "md", None, None)]
    got = match_library(spark.createDataFrame(refs, "id string, first_author_last string, year int, title string, doi string"), spark.createDataFrame(files, "path string, stem string, ext string, doi string, title string")).collect()
    assert {r.id: (r.pdf_path, r.source_kind) for r in got} == {
        "r1": ("/l/2020_Abel_tea.pdf", "pdf"), "r2": ("/l/김_2022.md", "md-yearfuzzy"), "r3": (None, "ambiguous"), "r4": ("/l/unnamed.md", "md"), "r5": (None, "not-found"), "r6": (None, "not-found"),
    }


@pytest.mark.parametrize(
    "response, rc, score",
    [('{"score": 1e-3}', 0, 0.001), ('text ```{"score": 0.85}```', 0, 0.85), ('{"a": "} {", "score": 1}', 0, 1.0), ('{"score": "0.9"}', 0, None), ('{"score": true}', 0, None), ('{"score": NaN}', 0, None), ('{"score": 1.5}', 0, None), ('{"score": .9}', 0, None), ('{"score": 0.9', 0, None), ('{oops} {"score": 0.9}', 0, None), ('{"a": {"score": 0.9}', 0, None), ("", 0, None), (None, 0, None), ('{"score": 0.9}', 1, None)],
)
def test_scores(response, rc, score):
    assert paraphrase.valid_score(response, rc) == score


def test_paraphrases(spark):
    words = values(spark, paraphrase.keywords(F.col("t")), [("The Tea with tea and self-paced Learning, learning that one",), (None,)], "t string")
    assert words == [["self-paced", "Learning"], None]
    text = "x" * 2000 + " alpha beta " + "y" * 2000
    window = values(spark, paraphrase.keyword_window(F.col("t"), F.array(F.lit("alpha"), F.lit("beta"))), [(text,), ("short alpha",), ("",), (None,)], "t string")
    assert "alpha beta" in window[0] and 1000 <= len(window[0]) <= 1500 and window[1:] == ["short alpha", None, None]
    assert values(spark, paraphrase.strip_frontmatter(F.col("t")), [("---\na: 1\n---\n\nBody --- x",), ("Body",)], "t string") == ["Body --- x", "Body"]
    pairs = spark.createDataFrame([("c1", "tea helps work", "tea helps work"), ("c2", "tea helps work", None)], "citation_id string, paraphrase_text string, extracted_quote string")
    assert {r.citation_id: r.score for r in paraphrase.score_pairs(pairs).collect()} == {"c1": 1.0, "c2": None}
    folded = values(spark, paraphrase.fold_in(F.col("s"), F.col("x")), [("PASS", None), ("PASS", 0.9), ("PENDING", 0.9), (None, None), ("MANUAL", None)], "s string, x double")
    assert folded == ["FAIL", "PASS", "FAIL", "FAIL", "MANUAL"]


def test_pages(spark):
    rows = [("a", "x\n" * 70), ("b", "x\n" * 85), ("c", "x\n" * 86), ("d", None), ("e", "")]
    assert {r.p: (r.line_count, r.status) for r in gates.page_check(spark.createDataFrame(rows, "p string, text string")).collect()} == {"a": (70, "PASS"), "b": (85, "WARN"), "c": (86, "FAIL"), "d": (None, "FAIL"), "e": (0, "PASS")}
    pages = spark.createDataFrame([("f", i, f"p{i}") for i in range(1, 21)], "path string, page_no int, text string")
    hint = lambda h: paraphrase.page_slice(pages, spark.createDataFrame([("f", h)], "path string, page_hint int")).first().text
    assert hint(5) == "p4\np5\np6" and hint(None).endswith("p15")


def test_sources(spark, tmp_path):
    (tmp_path / "b_intro.md").write_bytes(b"one two\r\nthree")
    (tmp_path / "a full+x.md").write_text('---\ntitle: "T"\ndoi: 10.1/a\ndoi: 10.1/b\n---\nBody', encoding="utf-8")
    paths = src.expand_specs(["b_intro.md", "*.md"], tmp_path)
    texts = src.read_texts(spark, paths)
    records = src.manuscripts(texts).orderBy("ord").collect()
    assert [(r.id, r.section, r.word_count) for r in records] == [("mss-001", "intro", 3), ("mss-002", "combined", 9)]
    import hashlib

    digest = hashlib.sha256("".join(hashlib.sha256(open(p, "rb").read()).hexdigest() for p in paths).encode()).hexdigest()[:8]
    assert src.manifest(src.manuscripts(texts), "p", "t").first().manifest_sha256_prefix8 == digest
    assert src.manifest(src.manuscripts(texts.limit(0)), "p", "t").first().manifest_sha256_prefix8 == "empty"
    lib = {r.stem: (r.doi, r.title) for r in src.library(spark, str(tmp_path)).collect()}
    assert lib == {"b_intro": (None, None), "a full+x": ("10.1/b", "T")}
    schema = spark.createDataFrame([("x", 1)], "a string, b int").schema
    (tmp_path / "r.jsonl").write_text('{"a": "é", "b": 1}\n\nbroken\n', encoding="utf-8")
    good, bad = src.read_jsonl(spark, str(tmp_path / "r.jsonl"), schema)
    assert [tuple(r) for r in good.collect()] == [("é", 1)]
    assert [(r.file.rsplit("/", 1)[1], r.line_no, r._corrupt) for r in bad.collect()] == [("r.jsonl", 3, "broken")]
    assert src.read_jsonl(spark, str(tmp_path / "none.jsonl"), schema)[0].count() == 0
    src.write_jsonl(spark.createDataFrame([("x", None)], schema), str(tmp_path / "o.jsonl"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "o.jsonl").glob("*.json"))


def test_measures_by_overlapping_keywords(spark):
    words = (("a", "gaze"), ("b", "gaze dwell"), ("c", "dwell time"), ("d", "time (s)"), ("d", "x+y"), ("a", "ga"))
    texts = ["Gaze here", "gaze dwell", "a dwell time of 3", "TIME (S)", "x+y", "gag", "nothing", "", None, "xtime (s)x+y"]
    want = ["a", None, "c", "d", "d", "a", None, None, None, "d"]
    assert values(spark, infer_measure(F.col("t"), words), [(t,) for t in texts], "t string") == want
    assert values(spark, infer_measure(F.col("t"), ()), [("x",)], "t string") == [None]


def test_spans_against_python(spark):
    import random
    import re

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1 é😀") for _ in range(rng.randrange(0, 60))) for _ in range(60)] + ["1" * 3000, "", None]
    got = values(spark, X.spans(F.col("t"), r"1+|ab"), [(t,) for t in texts], "t string")
    for t, g in zip(texts, got, strict=True):
        assert [(x.raw, x.start, x.end) for x in g or []] == [(m[0], *m.span()) for m in re.finditer(r"1+|ab", t or "")]


def test_numbers_in_global_order(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.lit(5000) - F.col("id")).alias("k"), F.pmod("id", F.lit(3)).alias("x"))
    got = numbered(rows, ["x", "k"], "n-%04d").collect()
    order = sorted((r.x, r.k) for r in got)
    assert {(r.x, r.k): r.id for r in got} == {key: f"n-{i + 1:04d}" for i, key in enumerate(order)}
    assert numbered(rows.limit(0), ["x"], "n-%04d").count() == 0


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from quillcheck import session

    chosen = []
    fake = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=chosen.append))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake("spark://host:7077", None))
    session.ensure_checkpoint_dir(fake("spark://host:7077", "/shared"))
    session.ensure_checkpoint_dir(fake("local[4]", None))
    assert chosen[0] == "/shared" and len(chosen) == 2
    table = session.stored(spark.createDataFrame([(1, None)], "a int, b string"))
    assert [tuple(r) for r in table.collect()] == [(1, None)]


def test_files_by_author_and_their_records(spark):
    refs = spark.createDataFrame([("r1", 1, "Abel", 2020, "Tea", None), ("r2", 2, "Li", 2019, "y", None), ("r3", 3, "Egg", None, "q", "10.5/a-b")], "id string, ref_ord int, first_author_last string, year int, title string, doi string").withColumn("pdf_attached", F.lit(False))
    files = spark.createDataFrame([("/l/2021_Abel.pdf", "2021_Abel", "pdf"), ("/l/2020_Abel.pdf", "2020_Abel", "pdf"), ("/l/Li_2018.md", "Li_2018", "md"), ("/l/Li_2020.md", "Li_2020", "md"), ("/l/x_10.5_a_b.pdf", "x_10.5_a_b", "pdf")], "path string, stem string, ext string").withColumns({"doi": F.lit(None).cast("string"), "title": F.lit(None).cast("string")})
    assert {r.id: r.pdf_path for r in find_by_author_year(refs, files).collect()} == {"r1": "/l/2020_Abel.pdf", "r2": None, "r3": None}
    found = match_library(refs, files)
    records, marked = attached(refs, found)
    assert [(r.id, r.ref_id, r.source_kind) for r in records.orderBy("id").collect()] == [("pdf-001", "r1", "pdf"), ("pdf-002", "r2", "ambiguous"), ("pdf-003", "r3", "pdf")]
    assert {r.id: r.pdf_attached for r in marked.collect()} == {"r1": True, "r2": False, "r3": True}


def test_stream_equals_batch(spark, tmp_path):
    from quillcheck.streaming.claims import claims_stream, read_line_stream, write_stream

    lines = spark.createDataFrame([("m", 1, "N = 3 and *p* = .04"), ("m", 2, "none")], "manuscript_id string, line_no int, text string")
    lines.write.parquet(str(tmp_path / "in"))
    stream = claims_stream(read_line_stream(spark, str(tmp_path / "in"), "manuscript_id string, line_no int, text string"))
    q = write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == extract_claims(lines).count() == 2


def test_every_pattern_has_keys():
    assert len({p.claim_type for p in PATTERNS}) == 16


def test_llm_is_optional():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quillcheck"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "quillcheck.llm" in p.read_text()]
