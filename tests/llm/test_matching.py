"""Catalog values, scanned pages and author variants."""

import pytest
from pyspark.sql import functions as F

from quillcheck.llm import catalog as C
from quillcheck.llm import name_variants as V
from quillcheck.llm import scan_repair as S

ENTRIES = [
    ("recall_accuracy", "Recall accuracy", ["free recall score"], "회상 정확도"), ("delayed_recall", "Delayed recall", ["one-week recall"], "지연 회상"), ("state_anxiety", "State anxiety", ["anxiety right now"], "상태 불안"),
    ("trait_anxiety", "Trait anxiety", ["general anxiousness"], "특성 불안"), ("self_efficacy", "Self-efficacy", ["belief in own ability"], "자기 효능감"), ("gaze_dwell_text", "Gaze dwell on text", ["looking time on text"], "본문 응시 시간"),
    ("gaze_dwell_avatar", "Gaze dwell on avatar", ["looking time on avatar"], "아바타 응시 시간"), ("task_time", "Time on task", ["completion duration"], "과제 수행 시간"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ENTRIES, "dv string, label string, aliases array<string>, label_ko string")


@pytest.fixture(scope="module")
def known(table):
    return C.Catalog(C.written_forms(table), {}, frozenset({("mean",), ("t2",), ("self", "rated"), ("hq",)}))


@pytest.mark.parametrize(
    "typed, dv",
    [
        ("Recall accuracy", "recall_accuracy"), ("recal_acuracy", "recall_accuracy"), ("recall_accuracy_HQ", "recall_accuracy"), ("mean staet anxiety", "state_anxiety"), ("anxiety, trait", "trait_anxiety"), ("self-rated self-eficacy", "self_efficacy"),
        ("gaze dwel on avatar T2", "gaze_dwell_avatar"), ("looking time on txet", "gaze_dwell_text"), ("dlyd rcll", "delayed_recall"), ("dela. reca.", "delayed_recall"), ("본문응시시간", "gaze_dwell_text"), ("상태 불", "state_anxiety"), ("self.", "self_efficacy"),
        ("roof load", "unmatched"), ("task lamp height", "unmatched"), ("n/a", "unmatched"), ("—", "unmatched"), ("???", "unmatched"), ("anxiety", "unmatched"), ("측정 없음", "unmatched"), ("x" * 20_000, "unmatched"),
    ],
)
def test_typed_values(known, typed, dv):
    assert known.value(typed) == dv


@pytest.mark.parametrize(
    "text, dv",
    [
        ("We found a drop for recal accuracy (*p* = .04) in one site.", "recall_accuracy"), ("분석 결과 지연회상에서 N = 30을 얻었다.", "delayed_recall"), ("참가자의 state anxeity에 대한 효과", "state_anxiety"), ("For task (time on), the model gave 3.", "task_time"),
        ("In the task, tide height reached 3.", None), ("The overall model was robust, 2.1%.", None), ("", None),
    ],
)
def test_named_in_prose(known, text, dv):
    assert known.inside(text) == dv


def test_similarity_join_is_exact():
    import random

    rng = random.Random(8)
    sets = [frozenset(rng.sample("abcdefghij", rng.randrange(1, 8))) for _ in range(60)]
    join = C.SetJoin(sets, {c: rng.randrange(9) for c in "abcdefghij"}, 0.5)
    for _ in range(300):
        q = frozenset(rng.sample("abcdefghijkl", rng.randrange(1, 9)))
        assert {k for _, k in join.similar(q)} == {k for k, s in enumerate(sets) if C.jaccard(q, s) >= 0.5}


def test_phrase_join_is_complete(known):
    """The prefix, length and positional filters lose no name that all pairs would find."""
    import random

    rng = random.Random(3)
    pool = [*known.words, "roof", "of", "x"]
    for _ in range(400):
        words = [rng.choice(pool) for _ in range(rng.randrange(1, 6))]
        near = [known.near(w) for w in words]
        size = sum(0.4 if w in C.SMALL or len(w) <= 2 else 1.0 for w in words)
        every = {(round(s, 9), n.entry) for k, n in enumerate(known.names) if (s := known._score(near, size, k)) >= C.PHRASE_SIMILARITY}
        assert {(round(s, 9), e) for s, e in known._whole(words) if s >= C.PHRASE_SIMILARITY} == every


def test_indexed_beginnings_and_skeletons():
    words = ["accuracy", "acceptance", "recall", "recognition", "rec"]
    begin = C.Beginnings(words)
    assert sorted(begin.exact("rec")) == ["recall", "recognition"]
    assert {w for w in words if len(w) > 4 and C.edit_distance("acuc", w[:4], 1) <= 1} == set(begin.close("acuc"))


def test_frequencies_only_of_catalog_tokens(spark, table):
    """A corpus of very many different pairs of signs does not enlarge the table; repeated letters are counted by number."""
    texts = spark.createDataFrame([("".join(chr(0xAC00 + (i * 7919 + k * 104729) % 11172) for k in range(50)) + " recall recall",) for i in range(200)], "t string")
    tokens = C.catalog_tokens(C.written_forms(table))
    counted = C.token_frequency((texts, "t"), tokens=tokens)
    assert set(counted) <= tokens
    assert counted["=recall"] == 400 and counted["l2"] == 400 and counted["re"] == 400


def test_learnt_affixes(spark, table):
    values = spark.createDataFrame([(f"{w} zeta",) for w in ("recall accuracy", "delayed recall", "state anxiety", "trait anxiety")] + [("roof delayed recall",), ("zeta anxiety right know now zeta",)], "v string")
    got = {r.v: r.dv for r in C.map_values(values, "v", table).collect()}
    assert got["state anxiety zeta"] == "state_anxiety" and len(got) == 6
    known = C.Catalog(C.written_forms(table), {})
    mapped = spark.createDataFrame([(known.value(r.v), known.beside(r.v)) for r in values.collect()], "dv string, beside array<array<string>>")
    assert C.learnt_affixes(mapped, C.written_forms(table)) == {("zeta",)}
    rated = spark.createDataFrame([(f"self-rated {w}",) for w in ("recall accuracy", "delayed recall", "state anxiety", "self-efgicacy")], "v string")
    assert {r.v: r.dv for r in C.map_values(rated, "v", table).collect()}["self-rated self-efgicacy"] == "self_efficacy"


def test_catalog_frames(spark, table):
    values = spark.createDataFrame([("recal accuracy", 1), ("recal accuracy", 2), (None, 3), (" ", 4), ("recall_accuracy", 5), ("roof", 6)], "matched_dv string, dv int")
    assert {(r.matched_dv, r.dv) for r in C.map_values(values, "matched_dv", table).collect()} == {("recal accuracy", "recall_accuracy"), ("roof", "unmatched")}
    assert C.map_values(values.limit(0), "matched_dv", table).count() == 0
    texts = spark.createDataFrame([(1, "for Recall Accuracy we got 3"), (2, "for recаll acuracy we got 3"), (3, None), (4, "nothing")], "i int, t string")
    assert [(r.i, r.dv) for r in C.named_measures(texts, "i", "t", table).collect()] == [(2, "recall_accuracy")]
    assert C.named_measures(texts.limit(0), "i", "t", table).count() == 0


# --- scanned pages -------------------------------------------------------------

BODY = [
    "The effect of the color-coded outline on recall was clear in the first wave.",
    "Each of the second-year nurses read the outline before the short test began.",
    "In the second wave the effect on recall was clear for the nurses as well.",
    "Nothing in the logs explains why the nurses skipped the short test at home.",
]


def _quotes(spark):
    plain = [("t", f"p{i}", f"{BODY[i % 4]} {BODY[(i + 1) % 4]}") for i in range(40)]
    odd = [
        ("t", "hyphen", "The effect of the color-\ncoded outline on recall was clear in the first wave. Each of the\nsecond-year nurses read the out¬\nline before the short test began."),
        ("t", "misread", "The effcct of the color-coded outline on reca11 was clear in the first wave."),
        ("t", "space", "Each of the second-year nurses read theoutline before the short test began."),
        ("t", "header", "The effect of the color-coded outline on recall was clear\nQuarterly of Tutor Studies\nin the first wave. Each of the second-year nurses read the\noutline before the short test began."),
        ("t", "capitals", "The effect of the color-coded outline on recall was clear\nPEER HINTS AT WORK | p. 33\nin the first wave. Each of the second-year nurses read the\noutline before the short test began."),
        ("t", "number", "The effect of the color-coded outline on recall was clear\n— 12 —\nin the first wave. Each of the second-year nurses read the\noutline before the short test began."),
        ("t", "inside", "The effect of the color-coded outline on recall was clear in the sec-\n\nxii\n\nond wave for the nurses as well."),
        ("t", "breaks", "The effect of the color-coded outline on recall was clear in the first wave.\nEach of the second-year nurses read the outline before the short\ntest began."),
        ("t", "null", None), ("t", "empty", ""), ("t", "blank", " \n "),
    ]
    return spark.createDataFrame([*plain, *odd, odd[0]], "record_table string, record_id string, quote string")


def test_scan_defects(spark):
    got: dict[str, set] = {}
    for r in S.scan_defects(_quotes(spark)).collect():
        got.setdefault(r.record_id, set()).add(r.defect)
    assert got == {
        "hyphen": {"hyphen_break"}, "misread": {"misread"}, "space": {"misread"}, "header": {"running_header"}, "capitals": {"running_header", "page_number"}, "number": {"page_number"}, "inside": {"hyphen_break", "page_number"},
    }


def test_scan_repair(spark):
    text = {r.record_id: r.paragraph for r in S.repaired(_quotes(spark)).collect()}
    assert text["hyphen"] == f"{BODY[0]} {BODY[1]}"
    assert text["misread"] == BODY[0]
    assert text["space"] == BODY[1]
    assert text["header"] == text["number"] == text["capitals"] == f"{BODY[0]} {BODY[1]}"
    assert "null" not in text and "blank" not in text


def test_scan_of_a_quote_in_many_records(spark):
    odd = [("outlinc", "The effect of the color-coded outlinc on recall was clear in the first wave."), ("theoutline", "Each of the second-year nurses read theoutline before the short test began.")]
    copies = [("u", f"{word}{i}", quote) for word, quote in odd for i in range(40)]
    quotes = _quotes(spark).unionByName(spark.createDataFrame(copies, "record_table string, record_id string, quote string"))
    got = {(r.record_id, r.defect) for r in S.scan_defects(quotes).where("record_table = 'u'").collect()}
    assert got == {(f"{word}{i}", "misread") for word, _ in odd for i in range(40)}
    text = {r.record_id: r.paragraph for r in S.repaired(quotes).where("record_table = 'u'").collect()}
    assert len(text) == 80 and all(text[f"outlinc{i}"] == BODY[0] and text[f"theoutline{i}"] == BODY[1] for i in range(40))


def test_scan_of_nothing(spark):
    assert S.scan_defects(_quotes(spark).limit(0)).count() == 0


# --- author variants --------------------------------------------------------------


def test_long_chains_of_spellings_have_one_author(spark):
    """Each spelling is near to the next, more frequent one only."""
    names = ["Abcdefghijkl"]
    for i in range(0, 12, 2):
        names.append(names[-1][:i] + "xy" + names[-1][i + 2 :])
    rows = [("m", n) for k, n in enumerate(names) for _ in range(k + 1)] + [("m", "Qrstuvwz"), ("m", None), ("n", names[0])]
    got = {(r.manuscript_id, r.name): r.author for r in V.author_of_names(spark.createDataFrame(rows, "manuscript_id string, name string")).collect()}
    assert got == {("m", n): names[-1] for n in names} | {("m", "Qrstuvwz"): "Qrstuvwz", ("n", names[0]): names[0]}


def test_variants_against_brute_force(spark):
    entries = [
        ("e1", "m", "Zhaestelo", "Zhaestelo, E. F., & Moe, A."), ("e2", "m", "E. F. Zhaestelo", "E. F. Zhaestelo, & Moe, A."), ("e3", "m", "Zhaestelo", "Zhaestelo, Beth, & Moe, A."), ("e4", "m", "Zhaestelos", "Zhaestelos, R. Q."),
        ("e5", "m", "Tea Council for Cups", "Tea Council for Cups"), ("e6", "n", "Zhaestelo", "Zhaestelo, E."), ("e7", "m", "Zhaesttelo", "Zhaesttelo, E."), ("e1", "m", "Zhaestelo", "Zhaestelo, E. F., & Moe, A."), ("e8", "m", None, None), ("e9", None, "Brown", "Brown, B."),
    ]
    cites = [("c1", "m", "Zhaesteloo"), ("c2", "m", "Zhaestelo"), ("c3", "m", "TCC"), ("c4", "m", "Zhaestelos"), ("c5", "m", None), ("c6", "n", "zhaestelo"), ("c7", "m", "")]
    e = spark.createDataFrame([(*r, 2001, "") for r in entries], "id string, manuscript_id string, first_author_last string, authors_raw string, ref_year int, year_suffix string").withColumn("name", F.lit("clash"))
    c = spark.createDataFrame([(*r, 2001, None, "") for r in cites], "id string, manuscript_id string, first_author_last string, cite_year int, year_alt int, year_suffix string").withColumn("author", F.lit("clash"))
    got = {(r.id_a, r.id_b) for r in V.link_variants(e, c).collect()}
    want = {("e1", "e2"), ("e1", "e3"), ("e1", "e7"), ("e2", "e3"), ("e2", "e7"), ("e3", "e7"), ("c1", "e1"), ("c1", "e2"), ("c1", "e3"), ("c1", "e7"), ("c2", "e2"), ("c2", "e7"), ("c3", "e5"), ("c6", "e6")}
    assert got == want
    assert V.link_variants(e.limit(0), c).count() == 0
    assert V.link_variants(e, c.limit(0)).count() == 6
