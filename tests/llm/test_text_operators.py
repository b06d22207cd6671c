"""Tokens, sentences, leaks, plain forms: exact round trips, brute force, and difficult inputs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillcheck.llm import bpe, leakage, lookalike, sentences


# --- encoding ---------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.DEFAULT_VOCABULARY, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_encoding_is_exact(encoder, reference_encoder):
    rng = random.Random(2)
    texts = ["", "<|endoftext|> x", "a\u0000b", "   ", "\n \n", "x" * 3000, "🙂𝟛" * 40, "Ελληνικά", "데이터 분석", "ข้อความ", "it's they'll I'M"]
    texts += ["".join(rng.choice("abcdeinorst ABC'  0123éüβ한국\n\t🙂") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference_encoder(t)
        assert encoder.vocabulary.decode(ids) == t
    assert encoder.encode(None) == []


def test_encoding_of_a_table(spark):
    df = spark.createDataFrame([(1, "tea", "z"), (2, None, "z"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, ids string")
    rows = [(r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()]
    assert sorted(rows)[1:] == [(2, []), (3, []), (3, [])]
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# --- sentences ----------------------------------------------------------------

CASES = [
    ("en", 'Dr. Hill left at 9 a.m. on Monday, i.e. early. "Why? Tell me." The end.', ["Dr. Hill left at 9 a.m. on Monday, i.e. early.", '"Why? Tell me."', "The end."]),
    ("en", 'One said: "It is. It was." As K. L. Moe (cf. No. 4, pp. 8 ff.) put it, no. (A side note.) Go.', ['One said: "It is. It was."', "As K. L. Moe (cf. No. 4, pp. 8 ff.) put it, no.", "(A side note.)", "Go."]),
    ("en", "Pens, cards, etc. Stop! was said... and p values of .05 at 3.5 ms. β was low. eTutor ran.", ["Pens, cards, etc.", "Stop! was said... and p values of .05 at 3.5 ms.", "β was low.", "eTutor ran."]),
    ("en", "## Head\nText one.\nStill two\nlines. Done.\n\n- item one. two\n- item b\n\n\nNo stop", ["## Head", "Text one.", "Still two\nlines.", "Done.", "- item one. two", "- item b", "No stop"]),
    ("de", "Am 8. März kam z. B. Dr. Au. „Warum? Wie?“, fragte er. Nr. 6 fehlt.", ["Am 8. März kam z. B. Dr. Au.", "„Warum? Wie?“, fragte er.", "Nr. 6 fehlt."]),
    ("fr", "« Quoi ? » demanda M. Roy. Il dit : « Bien. Oui. » Voir p. 5.", ["« Quoi ? » demanda M. Roy.", "Il dit : « Bien. Oui. »", "Voir p. 5."]),
    ("es", "¿Qué? «¿Será?», dijo la Sra. Paz. Escribió: «No. Sí». Fin.", ["¿Qué?", "«¿Será?», dijo la Sra. Paz.", "Escribió: «No. Sí».", "Fin."]),
    ("ja", "彼は「低い。増やせ。」と書いた。v2.5を使う！次。", ["彼は「低い。増やせ。」と書いた。", "v2.5を使う！", "次。"]),
    ("zh", "他写道：“低。请扩大。”值为3.5。“好吗？”王教授问道。", ["他写道：“低。请扩大。”", "值为3.5。", "“好吗？”王教授问道。"]),
    ("ko", "그는 “낮다. 늘려라.”라고 적었다. 값은 .5이다. 끝", ["그는 “낮다. 늘려라.”라고 적었다.", "값은 .5이다.", "끝"]),
    ("hi", 'डॉ. राम ने लिखा, "कम है। बढ़ाएँ।" क्या? हाँ।', ['डॉ. राम ने लिखा, "कम है। बढ़ाएँ।"', "क्या?", "हाँ।"]),
    ("ar", "كتب د. سامي. لماذا؟ نعم؛ لا.", ["كتب د. سامي.", "لماذا؟", "نعم؛ لا."]),
    ("th", "ผู้เรียนอ่าน 3คนออก\nจบแล้ว", ["ผู้เรียนอ่าน", "3คนออก", "จบแล้ว"]),
    (None, "x", ["x"]),
]


@pytest.mark.parametrize("language, text, want", CASES)
def test_sentences(language, text, want):
    assert [text[a:b] for a, b in sentences.sentences(text, language)] == want


def test_sentences_cover_every_text():
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "B", " ", ".", "!", "“", "”", '"', "(", ")", "\n", "。", "ก", "한", "1", "'", "«", "»", "* ", "# "]) for _ in range(rng.randrange(0, 60)))
        spans = sentences.sentences(text, "en")
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        covered = "".join(text[a:b] for a, b in spans)
        assert re.sub(r"\s", "", covered) == re.sub(r"\s", "", text)
    long = "This is one. " * 40_000
    assert len(sentences.sentences(long, "en")) == 40_000


def test_language_of_long_prose_is_that_of_all_of_it():
    text = "The reader was in the house and it was late. " * 100 + "Danach wurde der 3. Teil der Arbeit mit dem Rest gelesen. " * 300
    spans = [text[a:b] for a, b in sentences.sentences(text, None)]
    assert sentences.language_of(text, None) == "de"
    assert len(spans) == 400 and spans[-1] == "Danach wurde der 3. Teil der Arbeit mit dem Rest gelesen."


@pytest.mark.parametrize("text", ["\n".join(f"{i % 900}. item number" for i in range(20_000)), "(" * 20_000 + "a.", "word goes on. " * 20_000, "“a.” " * 20_000, "(a. " * 20_000, "ไทย(a)bcdefghijklmnopqrs " * 20_000])
def test_sentences_in_linear_time(text):
    began = time.process_time()
    assert sentences.sentences(text, "en")[-1][1] == len(text.rstrip())
    assert time.process_time() - began < 5


def test_sentence_context_is_not_cut_off():
    far = "한국어 " + "1 " * 200 + "2. 3."  # the last letter stands far before the mark
    assert len(sentences.sentences(far, None)) == 2
    thai = "ไทย" + "(1234567890abcdef) " + "ไทย"
    assert len(sentences.sentences(thai, None)) == 2


def test_sentences_of_a_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "en", 9), (2, None, None, 9), (3, " \n ", "de", 9), (4, "", "xx", 9)], "doc_id long, text string, lang string, start_pos int")
    assert sorted((r.doc_id, r.start_pos, r.end_pos) for r in sentences.split_sentences(df).collect()) == [(1, 0, 4), (1, 5, 9)]
    assert sentences.split_sentences(df.limit(0)).count() == 0


# --- leaks ----------------------------------------------------------------------


def test_index_against_brute_force():
    rng = random.Random(6)
    import numpy as np

    for _ in range(30):
        values = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 200))] + [0])
        index = leakage.FMIndex(values, 5)
        patterns = np.array([[rng.randrange(1, 5) for _ in range(3)] for _ in range(20)])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(values) - 2) if (values[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def _brute(item, doc, least=15, per=8):
    """Whether some passage of the item of at least ``least`` words is within an error in ``per`` words of some stretch."""
    n, m = len(item), len(doc)
    for i in range(n):
        row = [0] * (m + 1)
        for j in range(i, n):
            new = [row[0] + 1] + [0] * m
            for k in range(1, m + 1):
                new[k] = min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (item[j] != doc[k - 1]))
            row = new
            length = j - i + 1
            if length >= least and per * min(row) <= length:
                return True
    return False


def test_passages_against_brute_force():
    rng = random.Random(7)
    wrong = 0
    for _ in range(150):
        item = [f"w{rng.randrange(400)}" for _ in range(40)]
        size = rng.randrange(8, 30)
        at = rng.randrange(0, 40 - size)
        copy = []
        for w in item[at : at + size]:
            r = rng.random()
            copy += [] if r < 0.04 else ["x"] if r < 0.08 else [w, "y"] if r < 0.12 else [w]
        doc = ["a"] * 5 + copy + ["b"] * 5
        items = leakage.Items([(1, " ".join(item))])
        found = bool(list(leakage.shard_leaks([(0, [items.ids.get(w, 1) for w in doc])], items)))
        wrong += found != _brute(item, doc)
    assert wrong == 0


def test_leaks_as_a_reader_sees_them(spark):
    item = "One patient glazier later repainted nine salted hinges near the windy nursery while seven visitors counted brass lanterns behind an old toll house"
    shown = "Intro. *One* patient GLAZIER later re-\npainted nine​ salted hinges, near the windy nursery... while seven quiet visitors counted brass lanterns. End."
    words = item.split()
    random.Random(1).shuffle(words)
    docs = spark.createDataFrame([(1, shown, 0), (2, " ".join(words), 0), (3, "nine salted hinges near the windy nursery", 0), (4, None, 0), (5, "", 0), (6, item, 0), (6, item, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, None), (9, "short text")], "item_id long, text string")
    found = leakage.find_leaks(docs.select("doc_id", "text"), items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 7), (6, 7)}
    spans = {r.doc_id: (r.start_pos, r.end_pos) for r in leakage.merge_spans(found.select("doc_id", "start_pos", "end_pos")).collect()}
    assert shown[slice(*spans[1])].startswith("One*") and shown[slice(*spans[1])].endswith("lanterns")
    assert leakage.find_leaks(docs.limit(0), items).count() == 0
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0


# --- plain forms ------------------------------------------------------------------


@pytest.fixture(scope="module")
def plainer(spark):
    clean = ["the condition effect on recall was robust after controlling for age", "a naive resume task in the café", "*p* = .05 and ρ = .3, β = 2, α = .9, η² = .1", "внимание память", "Größe"] * 20
    return lookalike.Plainer(lookalike.character_pairs(spark.createDataFrame([(t,) for t in clean], "t string"), "t"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("the recаll tаѕk", "the recall task"), ("ｒｅｃａｌｌ ＝ １", "recall = 1"), ("re­call​", "recall"), ("café", "café"), ("a b c", "a b c"), ("eﬀect", "effect"), ("한", "한"), ("back‑two", "back-two"), ("𝟛", "3"), ("ĳs", "ijs"), ("ſet", "set"), ("Ŀ", "L·"), ("ŉ", "ʼn"),
    ],
)
def test_plain_form(plainer, text, want):
    assert not plainer.is_plain(text)
    assert plainer.plain(text) == want


@pytest.mark.parametrize("text", ["", "plain text", "café ρ = .3, η² = −.1", "«внимание»", "한국어 데이터", "β = 2", "Größe", "x" * 100_000])
def test_already_plain(plainer, text):
    assert plainer.is_plain(text) and plainer.plain(text) == text


def test_letters_that_are_taken_apart_are_looked_at(spark):
    df = spark.createDataFrame([(str(i), c, "Łódź žluť") for i, c in enumerate("ĳĲŀĿŉſ")], "claim_id string, raw_text string, context_snippet string")
    found = lookalike.plain_forms(df, "claim_id", ("raw_text", "context_snippet")).collect()
    assert sorted((r.claim_id, r.field_name) for r in found) == [(str(i), "raw_text") for i in range(6)]


def test_plain_forms_of_a_table(spark):
    rows = [("c1", "p = .05", "the tаsk"), ("c1", "p = .05", "the tаsk"), ("c2", None, None), ("c3", "", "the task at hand"), ("c4", "ｐ = .05", "task")]
    df = spark.createDataFrame(rows, "claim_id string, raw_text string, context_snippet string").withColumn("plain_text", F.lit(1))
    got = {(r.claim_id, r.field_name, r.plain_text) for r in lookalike.plain_forms(df, "claim_id", ("raw_text", "context_snippet")).collect()}
    assert got == {("c1", "context_snippet", "the task"), ("c4", "raw_text", "p = .05")}
    assert lookalike.plain_forms(df.limit(0), "claim_id", ("raw_text", "context_snippet")).count() == 0
