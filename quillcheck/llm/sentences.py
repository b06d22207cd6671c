"""Sentence units of multilingual documents by cascading tables of break rules.

A text is cut in three steps.  Blank lines end a unit; heading lines and list
items are units of their own.  In what remains every run of sentence-final
marks, together with the quotes and brackets that close there, is a candidate
position.  Rule tables then decide each candidate: a rule is a pair of regular
expressions for the text before and after the position and says break or no
break; tables are cascaded by the language of the paragraph and the first rule
that matches decides.  Quotations and brackets that are open at a position
forbid a break there.  In Thai, white space between Thai words is the candidate.

Positions count code points from 0, the end is exclusive, outer white space is
left out.  Null, empty and blank texts give no row.  Long texts are processed
whole, in time linear in their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.session import spread

BLANK_LINE = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[^\S\n\r\x0b\x0c\x85\u2028\u2029]*(?:(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[^\S\n\r\x0b\x0c\x85\u2028\u2029]*)+|\u2029")
LINE = regex.compile(r"[^\n\r\x0b\x0c\x85\u2028\u2029]+")
HEADING = regex.compile(r"\s*#{1,6}(?:\s|$)")
ITEM = regex.compile(r"\s*(?:[-*•‣◦▪–—·]\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})\)\s+|\d{1,3}\.\s+(?=\S))")
#: A number with a full stop opens a list item only if its neighbours in the block count as well.
NUMBERED = regex.compile(r"\s*(\d{1,3})\.\s+(?=\S)")

MARKS = ".!?…。！？｡．؟۔।॥‼⁇⁈⁉"
CANDIDATE = regex.compile(rf"[{MARKS}]+")
#: Closing marks that may stand after the final mark even without a partner.
LONE_CLOSERS = set("”’»」』）)]】〉》")
THAI_GAP = regex.compile(r"(?<=[\u0e00-\u0e7f][^\s\u0e00-\u0e7f]*)\s+(?=[^\s\w]*[\u0e00-\u0e7f])|(?<=[\u0e00-\u0e7f])\s+(?=\S)")
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉"}
ENDS = {c for ends in PAIRS.values() for c in ends}
BRACKETS = set("([（【")
MARK_OR_PAIR = regex.compile(r"[\"'‘’“”„«»‹›「」『』()\[\]（）【】《》〈〉]")

# Abbreviations that never end a sentence before a following word.
STRICT = {
    "latin": "e.g i.e viz cf vs approx incl excl resp ca Approx Cf Dr Drs Mr Mrs Ms Prof Rev Hon Gen Col Capt Lt Sgt St Mt Ft Dept Univ eds",
    "de": "nr Nr Abb vgl Vgl bzw sog wg ggf evtl inkl bspw z.b z.B d.h u.a u.Ä i.d.R o.ä Hrsg Aufl Bd Kap Hr Fr Dipl Ing Tab",
    "fr": "M MM Mme Mlle Mlles env tabl p.ex c.-à-d chap éd av boul n° fig cf",
    "es": "Sr Sra Sres Srta Dra Ud Uds núm pág págs aprox cap ej p.ej EE.UU fig",
}
# Abbreviations that stand before a number and otherwise end a sentence like any word.
COUNTED = "No Nos no nos Vol vol vols Fig Figs fig figs Tab Eq Eqs eq eqs Sec sec Ch ch p pp P S art Art col"
# Abbreviations that may also be the last word of a sentence.
LOOSE = {
    "latin": "etc al Jr Sr Inc Ltd Co Corp ff f a.m p.m A.M P.M U.S U.K min max sek std ed ibid seq",
    "de": "usw ff f etc",
    "fr": "etc",
    "es": "etc",
}


def _either(words: str) -> str:
    return "|".join(regex.escape(w).replace(r"\.", r"\.[ \u00a0\u202f]?") for w in sorted(set(words.split()), key=lambda w: (-len(w), w)))


def _abbreviation(words: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}])(?:{_either(words)})\.[*_]*$"


OPENING = r"[\"'“„«‹‘¿¡(\[（「『*_#]*"
STARTS = rf"\s+{OPENING}\s?(?:\p{{Lu}}|\p{{Lt}}|\p{{Lo}}|\p{{N}}|\p{{So}}|[\p{{Greek}}§$€£@+−–—-]|\p{{Ll}}\p{{Lu}}|\.\p{{N}})"
#: A symbol of statistics, lower-case by nature, that opens a sentence.
SYMBOL_STARTS = r"\s+[*_]*[pnrtdz][*_]*[- ](?:values?|Werte?|valeurs?|valores?)\b"
ANY = r""

# Each rule: (breaks, text before, text after). The first that matches decides.
TABLES: dict[str, list[tuple[bool, str, str]]] = {
    "inner": [
        (False, ANY, r"\s*[,;:،؛、，；：]"),
        (False, r"[!?！？؟]+[\p{Pe}\p{Pf}\"'»*_\s]*$", r"\s+[*_\"'(]*\p{Ll}(?!\p{Lu})"),
        (False, r"(?:\.{2,}|…)[\p{Pe}\p{Pf}\"'»*_\s]*$", r"\s*[*_\"'(]*\p{Ll}(?!\p{Lu})"),
        (False, r"[.．]$", r"\p{N}|\p{L}"),
    ],
    "de": [
        (False, r"(?i:\b(?:am|im|vom|zum|beim|seit|bis|ab|der|die|das|den|dem|des|jede[rmns]?|einem|ihrem|seinem))\s+\p{N}{1,3}\.$", r"\s+\p{L}"),
        (False, r"\p{N}{1,2}\.$", r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert)\b"),
        (False, _abbreviation(STRICT["de"]), r"\s+\S"),
        (True, _abbreviation(LOOSE["de"]), STARTS),
    ],
    "fr": [
        (False, _abbreviation(STRICT["fr"]), r"\s+\S"),
        (True, _abbreviation(LOOSE["fr"]), STARTS),
    ],
    "es": [
        (False, _abbreviation(STRICT["es"]), r"\s+\S"),
        (True, _abbreviation(LOOSE["es"]), STARTS),
    ],
    "en": [],
    "latin": [
        (False, _abbreviation(STRICT["latin"]), r"\s+\S"),
        (False, _abbreviation(COUNTED), r"\s+\p{N}"),
        (False, r"\b(?:al|AL)\.[*_]*$", r"\s+[(\[]?\p{N}"),
        (False, _abbreviation(" ".join(STRICT[k] for k in ("de", "fr", "es"))), r"\s+\S"),
        (False, r"(?<!\p{L})\p{L}\.$", r"\s+\p{L}\."),
        (False, r"\b[Ii]m\s+\p{N}{1,3}\.$|\b(?:[Vv]o|[Zz]u|[Bb]ei)m\s+\p{N}{1,3}\.$", r"\s+\p{Lu}"),
        (False, r"(?<![.,\p{N}])\p{N}{1,2}\.$", r"\s+(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\s+\p{N}"),
        (True, _abbreviation(LOOSE["latin"]), STARTS),
        (False, _abbreviation(LOOSE["latin"]), r"\s+\S"),
        (False, r"(?<![\p{L}\p{N}*_])\p{Lu}\.$", r"\s+[(\[]?\p{L}"),
        (False, r"(?<![\p{L}\p{N}*_])\p{L}\.[ \u00a0]?\p{L}\.$", r"\s+\p{Ll}"),
        (True, ANY, SYMBOL_STARTS),
        (True, ANY, STARTS),
        (False, ANY, r"\s+\S"),
    ],
    "cjk": [
        (False, ANY, r"\s*(?:と|って|という|との|とは)"),
        (True, r"[。！？｡．!?…][」』”’）)\"'»\]]*$", ANY),
    ],
    "hangul": [
        (False, r"(?<![\p{L}\p{N}])\p{Lu}\.$", r"\s+\p{L}"),
        (True, ANY, r"\s+\S"),
    ],
    "arabic": [
        (False, r"(?<![\p{L}\p{N}])(?:[\p{Arabic}]|أ\.د|ص|ج|م|ه)\.$", r"\s+\S"),
        (True, ANY, r"\s+\S"),
        (True, r"[؟!۔]+[\p{Pe}\p{Pf}\"']*$", ANY),
    ],
    "devanagari": [
        (False, r"(?<![\p{L}\p{M}\p{N}])(?:डॉ|प्रो|श्री|श्रीमती|कु|पं|सं|क्र|उदा)\.$", r"\s+\S"),
        (True, r"[।॥]+[\p{Pe}\p{Pf}\"']*$", ANY),
        (True, ANY, r"\s+\S"),
    ],
    "thai": [(True, r"[!?…]+[\p{Pe}\p{Pf}\"']*$", r"\s+\S"), (False, _abbreviation(STRICT["latin"]), r"\s+\S"), (True, r"\.$", r"\s+\S")],
}
CASCADES = {
    "en": ("inner", "en", "latin"),
    "de": ("inner", "de", "latin"),
    "fr": ("inner", "fr", "latin"),
    "es": ("inner", "es", "latin"),
    "cjk": ("inner", "cjk", "latin"),
    "hangul": ("inner", "hangul"),
    "arabic": ("inner", "arabic"),
    "devanagari": ("inner", "devanagari"),
    "thai": ("inner", "thai"),
}
# Frequent function words that tell the Latin-script languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in was for is that with as by were not from on it or this which at be an who how we",
    "de": "der die das und ist nicht von mit den dem des ein eine auf für sich im zu als auch bei wurde nach war am aus wie laut",
    "fr": "le la les des du une et est dans que qui pour par sur au aux avec selon pas ne chez ont était cette se d l",
    "es": "el los las una y en que con por para del al se su es no según fue entre más como qué la",
}
SCRIPTS = (
    ("thai", regex.compile(r"\p{Thai}")),
    ("cjk", regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}。！？]")),
    ("hangul", regex.compile(r"\p{Hangul}")),
    ("arabic", regex.compile(r"[\p{Arabic}]")),
    ("devanagari", regex.compile(r"[\p{Devanagari}।॥]")),
    ("latin", regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Hebrew}]")),
)
WORD = regex.compile(r"\p{L}+")


@cache
def _cascade(name: str) -> list[tuple[bool, regex.Pattern | None, regex.Pattern | None]]:
    """The rules of a language; what stands before is matched backwards from the position, however long it is."""
    return [
        (breaks, regex.compile(f"(?r){before}") if before else None, regex.compile(after) if after else None)
        for table in CASCADES[name]
        for breaks, before, after in TABLES[table]
    ]


@cache
def _voters() -> dict[str, frozenset[str]]:
    votes: dict[str, set[str]] = {}
    for language, words in FUNCTION_WORDS.items():
        for w in words.split():
            votes.setdefault(w, set()).add(language)
    return {w: frozenset(v) for w, v in votes.items()}


def language_of(paragraph: str, declared: str | None) -> str:
    """The Latin-script language of a paragraph by its function words; the declared one breaks ties."""
    votes, counts = _voters(), dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in WORD.findall(paragraph.lower()):
        for language in votes.get(w, ()):
            counts[language] += 1
    declared = (declared or "").lower()[:2]
    if declared in counts:
        counts[declared] += 0.5
    best = max(counts, key=lambda k: (counts[k], k == "en"))
    return best


def _script_of(text: str, at: int, floor: int) -> tuple[int, str] | None:
    """Position and rule family of the last letter or typical mark in [floor, at), or None."""
    for i in range(at - 1, floor - 1, -1):
        c = text[i]
        if c < "\u0250":
            if c.isalpha():
                return i, "latin"
            continue
        for name, pattern in SCRIPTS:
            if pattern.match(c):
                return i, name
    return None


def enclosures(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Matched quotations and brackets as (opening, closing) positions; what lacks its partner is ignored."""
    stack: list[tuple[int, str]] = []
    waiting: dict[str, list[int]] = {}  # places in the stack that each closing mark would close
    found: list[tuple[int, int]] = []

    def push(at: int, closers: str) -> None:
        for e in closers:
            waiting.setdefault(e, []).append(len(stack))
        stack.append((at, closers))

    def close(place: int, at: int) -> None:
        found.append((stack[place][0], at))
        while len(stack) > place:
            for e in stack.pop()[1]:
                waiting[e].pop()

    for m in MARK_OR_PAIR.finditer(text, start, end):
        i, c = m.start(), m[0]
        before = text[i - 1] if i > start else " "
        after = text[i + 1] if i + 1 < end else " "
        places = waiting.get(c)
        if c in "'‘’":
            if places and c != "‘" and not before.isspace() and not after.isalnum() and before in ".,!?…;:*)":
                close(places[-1], i)
            elif c != "’" and not before.isalnum() and (after.isalnum() or after in "¿¡*"):
                push(i, "'" if c == "'" else "’")
        elif c == '"':
            if places and not (before.isspace() and after.isalnum()):
                close(places[-1], i)
            else:
                push(i, '"')
        elif places and (c not in PAIRS or c == "“"):
            close(places[-1], i)
        elif c in PAIRS:
            push(i, PAIRS[c])
    return sorted(found)


def _after_closers(text: str, at: int, end: int, closings: set[int]) -> int:
    """The position behind the quotations, brackets and emphasis that close at a final mark."""
    while at < end:
        c = text[at]
        if at in closings or c in LONE_CLOSERS:
            at += 1
        elif c in " \u00a0\u202f" and at + 1 in closings and text[at + 1] in "»›":
            at += 2
        elif c in "*_\"" and (at + 1 == end or text[at + 1].isspace() or at + 1 in closings):
            at += 1
        else:
            break
    return at


def _paragraph(text: str, start: int, end: int, declared: str | None) -> Iterator[tuple[int, int]]:
    """Sentences of one run of prose."""
    whole = text[start:end]
    language = language_of(whole, declared)
    spans = enclosures(text, start, end)
    opened = {b: a for a, b in spans}
    closings = set(opened)
    cuts: list[tuple[int, bool]] = [(_after_closers(text, m.end(), end, closings), False) for m in CANDIDATE.finditer(text, start, end)]
    if SCRIPTS[0][1].search(whole):
        cuts = sorted({*cuts, *((m.start(), True) for m in THAI_GAP.finditer(text, start, end))})
    begin, at_span, reach = start, 0, start - 1
    seen, letter, family_there = start, -1, "latin"
    for at, gap in cuts:
        if at <= begin or at >= end:
            continue
        while at_span < len(spans) and spans[at_span][0] < at:
            reach = max(reach, spans[at_span][1])
            at_span += 1
        if reach >= at:
            continue  # inside a quotation or bracket
        if gap:
            yield begin, at
            begin = at
            continue
        if hit := _script_of(text, at, seen):
            letter, family_there = hit
        seen = at
        family = family_there if letter >= begin else "latin"
        first = begin
        while first < at and text[first].isspace():
            first += 1
        mark = at
        while text[mark - 1] not in MARKS:
            mark -= 1
        around = min((opened[p] for p in range(mark, at) if p in opened and opened[p] < mark), default=None)
        if around is not None:
            if text[around] in BRACKETS and around != first:
                continue
            if family == "cjk" and around == first and text[around] not in BRACKETS and not text[at].isspace():
                continue
            if family in ("hangul", "arabic", "devanagari") and not text[at].isspace():
                continue
        for breaks, before, after in _cascade(language if family == "latin" else family):
            if (after is None or after.match(text, at, end)) and (before is None or before.match(text, begin, at)):
                if breaks:
                    yield begin, at
                    begin = at
                break
    yield begin, end


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BLANK_LINE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _numbered_run(lines: list[tuple[int, int]], text: str) -> set[int]:
    """Indexes of lines that belong to a numbered list: neighbours counting up, or a list that opens its block."""
    numbers = {k: int(m[1]) for k, (a, b) in enumerate(lines) if (m := NUMBERED.match(text, a, b))}
    values = set(numbers.values())
    return {k for k, n in numbers.items() if n - 1 in values or n + 1 in values or (k == 0 and n == 1)}


def sentences(text: str | None, declared: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit; null, empty and blank texts have none."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []

    def keep(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for start, end in _blocks(text):
        lines = [m.span() for m in LINE.finditer(text, start, end)]
        numbered = _numbered_run(lines, text)
        prose = start
        item: int | None = None
        for k, (a, b) in enumerate(lines):
            heading = HEADING.match(text, a, b)
            marker = ITEM.match(text, a, b)
            if marker and NUMBERED.match(text, a, b) and k not in numbered:
                marker = None
            if not heading and not marker:
                continue
            if item is not None:
                keep(item, a)
            elif prose < a:
                for s in _paragraph(text, prose, a, declared):
                    keep(*s)
            item = None
            if heading:
                keep(a, b)
                prose = b
            else:
                item = a
        if item is not None:
            keep(item, end)
        elif prose < end:
            for s in _paragraph(text, prose, end, declared):
                keep(*s)
    return out


def split_sentences(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str | None = "lang") -> DataFrame:
    """``id_column``, ``start_pos`` and ``end_pos`` of every sentence unit; map-only, nothing is shuffled."""

    @F.pandas_udf("array<struct<start_pos:int,end_pos:int>>")
    def units(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([[{"start_pos": a, "end_pos": b} for a, b in sentences(t, g)] for t, g in zip(texts, languages, strict=True)], dtype=object)

    language = F.col(language_column) if language_column else F.lit(None).cast("string")
    rows = spread(documents.select(F.col(id_column), F.col(text_column).alias("_text"), language.alias("_lang")))
    rows = rows.where(F.col("_text").rlike(r"\S"))
    return rows.select(F.col(id_column), F.inline(units("_text", "_lang")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence of every document."""
    return split_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
