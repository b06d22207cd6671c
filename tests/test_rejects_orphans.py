"""Rows that fail to parse, and references to records that do not exist."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillcheck.functions import grammars as G
from quillcheck.functions import names as N
from quillcheck.operators import orphans as O
from quillcheck.operators import rejects as R

GOOD = "dv,1.5,1,20,.04,4e-2,−0.2,0.1,-0.5,N/A,30,✓,"


@pytest.mark.parametrize(
    "line, reason",
    [
        (GOOD, None),
        ('"a ""b"" c",1.5,1,20,.04,0.04,,—,N/A,,30,✗,"x, y"', None),
        (GOOD.replace("dv", '"dv'), "quoting"),
        (GOOD.replace("dv", 'dv"'), "quoting"),
        (GOOD.replace("dv", '"dv" (post)'), "quoting"),
        (GOOD + '"see ""it"" now" x', "quoting"),
        (GOOD + ",", "column_count"),
        ("a,b", "column_count"),
        ("", "column_count"),
        (GOOD.replace(",20,", ",20.5,"), "value"),
        (GOOD.replace(",1.5,", ",inf,"), "value"),
        (GOOD.replace(",0.1,", ",0,"), "value"),
        (GOOD.replace("✓", "ok"), "value"),
        (GOOD.replace("N/A", "-0.9"), "value"),
        (GOOD.replace("dv,1.5", '"dv,x'), "quoting"),
    ],
)
def test_lines(line, reason):
    assert [r.reason for r in G.read_export(line)] == [reason]


def test_parser_resumes_at_the_next_record():
    records = G.read_export("\n".join([GOOD, GOOD.replace("dv", '"broken'), GOOD, "x,y", GOOD]))
    assert [r.reason for r in records] == [None, "quoting", None, "column_count", None]
    assert records[1].problems[0].position == len(GOOD) + 1


REF = "Abel, A., & Brown, B. (2019). Tea at work: A study. *Desk Studies*, *3*(1), 1–9. https://doi.example/10.1234/desk.1"


@pytest.mark.parametrize(
    "text, reason",
    [
        (REF, None),
        (REF.replace(" https://doi.example/10.1234/desk.1", ""), None),
        (REF.replace("Tea at work: A study.", "“Tea at work.”").replace("2019", "2019b").replace(" *Desk", "\n*Desk"), None),
        (REF.replace("A study.", "A study [Software manual]."), None),
        (REF.replace("(1)", "(1"), "quoting"),
        (REF.replace("*3*", "*3"), "quoting"),
        (REF.replace("Tea", "“Tea"), "quoting"),
        (REF.replace("Tea", "Tea's"), None),
        (REF.replace("Abel, A., & Brown, B. ", ""), "column_count"),
        (REF.replace(" (2019).", "."), "column_count"),
        (REF.replace("Tea at work: A study. ", ""), "column_count"),
        (REF.replace("2019", "2119"), "value"),
        (REF.replace("2019", "20I9"), "value"),
        (REF.replace("10.1234/desk.1", "10.12/desk"), "value"),
        ("", "column_count"),
        (None, "column_count"),
    ],
)
def test_references(text, reason):
    assert G.read_reference(text).reason == reason


def test_reject_frames(spark):
    rows = spark.createDataFrame([(1, GOOD, "r"), (1, GOOD, "r"), (2, None, None), (3, "a" * 200_000 + '"', "x")], "row_id long, raw_line string, reason string")
    out = {(r.source.row_id, r.reason) for r in R.statistics_records(rows).collect()}
    assert out == {(1, None), (2, "column_count"), (3, "quoting")}
    good = R.statistics_records(rows).where("reason is null").first()
    assert (good.f, good.df2, good.beta, good.ci_high, good.source.reason) == (1.5, 20, -0.2, None, "r")
    assert R.statistics_records(rows.limit(0)).count() == 0
    assert R.reference_records(spark.createDataFrame([("a", REF), ("b", None)], "id string, raw_text string")).where("reason is null").count() == 1


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_orphans_against_brute_force(spark):
    import random

    rng = random.Random(3)
    deliveries = [(f"k{rng.randrange(8)}", day(rng.randrange(40), rng.randrange(24)), rng.choice([None, day(rng.randrange(10, 60))])) for _ in range(60)] + [("k1", None, None), (None, day(1), None), ("only-null", None, None)]
    events = [(rng.choice([f"k{i}" for i in range(9)] + ["only-null", None]), rng.choice([day(rng.randrange(50), rng.randrange(24)), None] if i % 9 == 0 else [day(rng.randrange(50), rng.randrange(24))]), i, "kind") for i in range(300)]
    got = {(r.event_id, r.reason) for r in O.late_or_missing(spark.createDataFrame(events, "key string, at timestamp, event_id int, until string"), spark.createDataFrame(deliveries, "key string, loaded_at timestamp, deleted_at timestamp")).collect()}
    want = set()
    for key, at, i, _ in events:
        if key is None:
            continue
        own = [(a, d) for k, a, d in deliveries if k == key]
        before = [d for a, d in own if a is not None and at is not None and a <= at]
        if not own:
            want.add((i, "missing"))
        elif not any(d is None or d > at for d in before):
            want.add((i, "deleted" if before else "late"))
    assert got == want


def test_citations_without_key(spark):
    entries = spark.createDataFrame(
        [("e1", "m", "Zhaestelo", "Zhaestelo, E. F.", 2001, ""), ("e2", "m", "Tea Council for Cups", "Tea Council for Cups", 2002, "a"), ("e3", "n", "Brown", "Brown, B.", 2003, None)],
        "id string, manuscript_id string, first_author_last string, authors_raw string, ref_year int, year_suffix string",
    )
    cited = spark.createDataFrame(
        [
            ("c1", "m", "Zhaesteloo", 2001, "", None), ("c2", "m", "Zhaestelo", 1999, "", 2001), ("c3", "m", "Zhaestelo", 1999, "", None), ("c4", "m", "TCC", 2002, "a", None), ("c5", "m", "Liz Zhaestelo", 2001, None, None),
            ("c6", "m", "Q. Zhaestelo", 2001, "", None), ("c7", "m", "Brown", 2003, "", None), ("c8", None, None, None, None, None),
        ],
        "id string, manuscript_id string, first_author_last string, cite_year int, year_suffix string, year_alt int",
    )
    assert {r.id for r in O.unmatched_citations(cited, entries).collect()} == {"c3", "c6", "c7", "c8"}
    assert O.unmatched_citations(cited, entries.limit(0)).count() == 8
    assert O.unmatched_citations(cited.limit(0), entries).count() == 0


def test_cascade(spark):
    f = lambda rows, cols: spark.createDataFrame(rows, cols)
    tables = {"a": f([("a1",), ("A2 ",), (None,)], "id string"), "b": f([("b1", "A1"), ("b2", "zz"), ("b3", " "), ("b4", "a2")], "id string, a string"), "c": f([("c1", "b2"), ("c2", "b1"), ("c3", "b9"), ("c4", None)], "id string, b string"), "d": f([("d1", "c1"), ("d2", "c3"), ("d3", "c2")], "id string, c string")}
    graph = (O.ForeignKey("b", "a", "a"), O.ForeignKey("c", "b", "b"), O.ForeignKey("d", "c", "c"))
    got = {(r.record_id, r.kind) for r in O.cascade(tables, graph).collect()}
    assert got == {("b2", "direct"), ("c3", "direct"), ("c1", "inherited"), ("d1", "inherited"), ("d2", "inherited")}


def test_cascade_from_deleted_late_and_unnamed_references(spark, tmp_path):
    t = lambda rows, name, cols: spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/{name}.parquet")
    t([("m",)], "manuscripts", "id string")
    t([("n1", "m", day(1))], "numerical_claims", "id string, manuscript_id string, extracted_at timestamp")
    t([("live", "m", "Brown", "Brown, B.", 2003, "", day(1), None), ("gone", "m", "Moe", "Moe, A.", 2004, "", day(1), day(5)), ("later", "m", "Rot", "Rot, A.", 2005, "", day(50), None)], "reference_entries", "id string, manuscript_id string, first_author_last string, authors_raw string, ref_year int, year_suffix string, loaded_at timestamp, deleted_at timestamp")
    cites = [("c1", "LIVE", "Brown", 2003), ("c2", "Gone", "Moe", 2004), ("c3", "later", "Rot", 2005), ("c4", "nowhere", "Li", 2006), ("c5", None, "Zhaestelo", 2007), ("c6", " ", "Brown", 2003)]
    t([(i, "m", a, y, "", None, day(10), r) for i, r, a, y in cites], "in_text_citations", "id string, manuscript_id string, first_author_last string, cite_year int, year_suffix string, year_alt int, cited_at timestamp, ref_id string")
    t([("f1", "gone", day(40)), ("f2", None, day(40))], "source_pdfs", "id string, ref_id string, extracted_at timestamp")
    t([(f"x{i}", f"c{i}", None) for i in range(1, 7)], "paraphrase_matches", "id string, citation_id string, ref_id string")
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("manuscripts", "numerical_claims", "reference_entries", "in_text_citations", "source_pdfs", "paraphrase_matches")}
    month, far = (spark.createDataFrame([(day(d),)], "t timestamp").select(O.period("t")).first()[0] for d in (10, 40))
    reasons = {2: "deleted", 3: "late", 4: "missing", 5: "missing"}
    via = {2: "ref_id", 3: "ref_id", 4: "ref_id", 5: "first_author_last"}
    want = {("in_text_citations", f"c{i}", via[i], "direct", reasons[i], month) for i in reasons} | {("paraphrase_matches", f"x{i}", "citation_id", "inherited", reasons[i], month) for i in reasons} | {("source_pdfs", "f1", "ref_id", "direct", "deleted", far)}
    got = O.cascade(tables).select("record_table", "record_id", "via", "kind", "reason", "period").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r[c] for c in ("record_table", "record_id", "via", "kind", "reason", "period")) for r in O.p5_cascade(spark, str(tmp_path)).collect()} == want
    keys = {(r.record_table, r.record_id) for r in O.p5_key_cascade(spark, str(tmp_path)).collect()}
    assert ("in_text_citations", "c5") not in keys and ("in_text_citations", "c4") in keys
    found = {(r.record_table, r.record_id, r.reason, r.period) for r in O.p5_found(spark, str(tmp_path)).collect()}
    assert found == {(t, i, r, p) for t, i, _, kind, r, p in want if kind == "direct"}


def test_period_is_utc(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
    try:
        df = spark.sql("SELECT timestamp'2024-03-01 05:00:00' AS t").select(O.period("t").alias("p"))
        assert df.first().p == "2024-02"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Nazkik, E. T.", "Nazkij", True), ("Nazkik, E. T.", "Nazkik’s, E.", True), ("Zhaestelo, Beth", "Zhaestelo, E. F.", True), ("Zhaestelo, Beth", "Zhaestelo, B.", True), ("Zhaestelo, Beth", "Zhaestelo, C.", False), ("le Resmen CC", "Resmen, le", True),
        ("van der Rot, A.", "VanderRot", True), ("Dr. Brown", "Brown, B.", True), ("Brown, B.", "Brown, C.", False), ("Brownson, Q.", "Brown, B.", False), ("Gitzow-Treldeyra, A.", "G.-Treldeyra", True), ("Jorløtt", "Jorlott", True),
        ("Tea Lab. for Cup Studies", "Tea Laboratory for Cup Studies", True), ("TLCS", "Tea Laboratory for Cup Studies", True), ("Laboratory for Cup Studies, Tea", "The Tea Laboratory for Cup Studies", True), ("Tea Lab. for Cup Studies", "Tea Lab. for Pot Studies", False),
        ("", "Brown", False), (None, None, False), ("Brart0w", "Brartow", True), ("Tea Laboratory ffor Cup Studies", "Tea Laboratory for Cup Studies", True), ("Tea Laboratory forr Cup Studies", "Tea Laboratory for Cups Studies", True),
        ("Gitzowtreldeyra", "G.-Treldeyra", True), ("Gitzowtreldeyra, A.", "G.-Treldeyr", True), ("Mitzowtreldeyra", "G.-Treldeyra", False), ("Gitzowtreldeyra", "G.-Melderrow", False),
    ],
)
def test_names(a, b, same):
    assert (N.compare(a, b) is not None) == same
    assert (N.compare(b, a) is not None) == same
    if same:
        assert set(N.name_index(a)) & set(N.name_probe(b))
        assert set(N.name_index(b)) & set(N.name_probe(a))


def test_edit_distance_and_segments():
    import random

    rng = random.Random(5)

    def full(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(3000):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
        want = full(a, b)
        assert N.edit_distance(a, b, 2) == min(3, want)


def test_segments_lose_no_pair_within_the_slips():
    """Insertions, deletions, substitutions and swaps, also across the cuts: every pair that verification would accept shares an entry."""
    import random

    rng, seen = random.Random(6), 0

    def slip(k):
        i = rng.randrange(len(k) + 1)
        return rng.choice((k[:i] + rng.choice("abc") + k[i:], k[:i] + k[i + 1 :], k[:i] + rng.choice("abc") + k[i + 1 :], k[:i] + k[i + 1 : i + 2] + k[i : i + 1] + k[i + 2 :]))

    for _ in range(40_000):
        a = "".join(rng.choice("abcdef"[: rng.choice((2, 3, 6))]) for _ in range(rng.randrange(1, 16)))
        b = a
        for _ in range(rng.randrange(0, 3)):
            b = slip(b)
        if b and N.edit_distance(a, b, most := N.slips(min(a, b, key=len))) <= most:
            seen += 1
            assert N.key_entries(a) & N.key_lookups(b) and N.key_entries(b) & N.key_lookups(a), (a, b)
    assert seen > 20_000


def test_empty_tables(spark, small):
    entries = spark.read.parquet(f"{small}/reference_entries.parquet")
    assert R.reference_records(entries.limit(0)).count() == 0
    events = spark.createDataFrame([], "key string, at timestamp, event_id int")
    assert O.late_or_missing(events, entries.select(F.col("id").alias("key"), "loaded_at", "deleted_at")).count() == 0
