"""Paraphrases compared with their sources through a pluggable scorer."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no keywords.
STOPWORDS = tuple(
    "the and for with that this from their have been are was were may can not but all these those such which who what when where how more less than into over also they them "
    "its his her some any our your out off yet via per due between within across during while about above below would could should will shall must might does did had has "
    "having being other same each much many most few either neither both two three four".split()
)
PURPOSES = ("finding-cite", "method-cite", "theory-cite", "background-cite")
MAX_KEYWORDS = 8
WINDOW = 1000
PAGES = 15
#: Characters of a paraphrase and a quote in a stored match.
STORED = 300


def threshold_for(purpose: Column) -> Column:
    """The score from which a paraphrase passes; null for background citations."""
    return F.when(purpose == "finding-cite", F.lit(0.85)).when(purpose.isin("method-cite", "theory-cite"), F.lit(0.40))


def strip_frontmatter(text: Column) -> Column:
    """A text without the block between its first two rule lines."""
    parts = F.split(text, r"(?md)^---\s*$", 3)
    return F.when(text.startswith("---") & (F.size(parts) >= 3), F.regexp_replace(F.get(parts, F.lit(2)), r"^\n+", "")).otherwise(text)


def keywords(text: Column, most: int = MAX_KEYWORDS) -> Column:
    """Words of four letters and more in order of appearance, each once ignoring case, without stopwords."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z\-]{3,})\b"), 1), lambda w: ~F.lower(w).isin(*STOPWORDS))
    low = F.transform(found, F.lower)
    first = F.filter(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_position(low, F.lower(s["w"])) == s["i"] + 1)
    return F.slice(F.transform(first, lambda s: s["w"]), 1, most)


def keyword_window(text: Column, words: Column, window: int = WINDOW, least: int = 1) -> Column:
    """The stretch of a text with most different keywords, widened by a quarter on both sides; null without enough.

    Windows start at every fifth of their width; the first of the best is taken.
    """
    step = max(100, window // 5)
    low, wanted = F.lower(text), F.transform(words, F.lower)
    hits = lambda part: F.size(F.filter(wanted, lambda w: F.contains(part, w)))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - window, F.lit(0)), F.lit(step))
    scored = F.transform(starts, lambda s: F.struct(hits(F.substring(low, s + 1, F.lit(window))).alias("n"), (-s).alias("s")))
    best = F.array_max(scored)
    begin = F.greatest(-best["s"] - window // 4, F.lit(0))
    end = F.least(-best["s"] + window + window // 4, F.length(text))
    some = (F.size(words) > 0) & (F.length(text) > 0)
    whole = F.when(hits(low) >= 0, text)
    return F.when(~some | text.isNull(), None).when(F.length(text) <= window, whole).when(best["n"] < least, None).otherwise(F.substring(text, begin + 1, end - begin))


def source_quote(text: Column, words: Column) -> Column:
    """The keyword window, else the first 3,000 characters."""
    body = strip_frontmatter(text)
    return F.coalesce(keyword_window(body, words), F.left(body, F.lit(3000)))


def page_slice(pages: DataFrame, hints: DataFrame) -> DataFrame:
    """Text of the pages next to a hint, else of the first fifteen; ``pages``: path, page_no, text; ``hints``: path, page_hint."""
    joined = pages.join(hints, "path")
    near = F.when(F.col("page_hint").isNotNull(), F.abs(F.col("page_no") - F.col("page_hint")) <= 1).otherwise(F.col("page_no") <= PAGES)
    rows = joined.where(near).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return rows.select("path", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def first_json_object(response: str | None) -> str | None:
    """The first balanced object of a response, strings and escapes respected.

    Closed to failure: none if that object is not valid JSON or never ends,
    whatever comes behind it.
    """
    at = (response or "").find("{")
    if at < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(at, len(response)):
        c = response[i]
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), not (c == '"' and not escaped)
            continue
        if c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                try:
                    json.loads(response[at : i + 1])
                except ValueError:
                    return None
                return response[at : i + 1]
    return None


def valid_score(response: str | None, returncode: int | None = 0) -> float | None:
    """``score`` of a response: a finite JSON number in [0, 1] of a call that succeeded; else null."""
    found = first_json_object(response) if returncode == 0 else None
    if found is None:
        return None
    score = json.loads(found).get("score")
    if isinstance(score, bool) or not isinstance(score, int | float) or not math.isfinite(score) or not 0 <= score <= 1:
        return None
    return float(score)


@F.pandas_udf(T.DoubleType())
def json_score(responses: pd.Series, returncodes: pd.Series) -> pd.Series:
    """The validated score of each response."""
    return pd.Series([valid_score(r, None if pd.isna(c) else int(c)) for r, c in zip(responses, returncodes, strict=True)], dtype="float64")


Scorer = Callable[[str, str], float | None]


def lexical_score(paraphrase: str, quote: str) -> float | None:
    """A deterministic scorer without any service: the share of the paraphrase's long words in the quote."""
    own = {w for w in paraphrase.lower().split() if len(w) > 3}
    return sum(w in quote.lower() for w in own) / len(own) if own else None


def score_pairs(pairs: DataFrame, scorer: Scorer = lexical_score) -> DataFrame:
    """``score`` of each distinct (paraphrase_text, extracted_quote); equal pairs are scored once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = [scorer(p, q) if p and q else None for p, q in zip(b["paraphrase_text"], b["extracted_quote"], strict=True)]
            yield b.assign(score=pd.Series(scores, index=b.index, dtype="float64"))

    distinct = pairs.select("paraphrase_text", "extracted_quote").distinct()
    scored = distinct.mapInPandas(run, "paraphrase_text string, extracted_quote string, score double")
    joined = pairs.alias("p").join(scored.alias("s"), F.col("p.paraphrase_text").eqNullSafe(F.col("s.paraphrase_text")) & F.col("p.extracted_quote").eqNullSafe(F.col("s.extracted_quote")), "left")
    return joined.select("p.*", F.when((F.col("s.score") >= 0) & (F.col("s.score") <= 1), F.col("s.score")).alias("score"))


def paraphrase_status(purpose: Column, quote: Column, score: Column) -> Column:
    """MANUAL for background, FAIL without a quote or score, else by the threshold."""
    t = threshold_for(purpose)
    return F.when(t.isNull(), "MANUAL").when(F.coalesce(F.trim(quote), F.lit("")) == "", "FAIL").when(F.coalesce(score >= t, F.lit(False)), "PASS").otherwise("FAIL")


def fold_in(status: Column, score: Column) -> Column:
    """Closed to failure: an unknown status, or a pass without a valid score, fails."""
    valid = F.coalesce((score >= 0) & (score <= 1) & ~F.isnan(score), F.lit(False))
    known = F.coalesce(status.isin("PASS", "FAIL", "WARN", "MANUAL"), F.lit(False))
    return F.when(~known, "FAIL").when((status == "PASS") & ~valid, "FAIL").otherwise(status)


def augmented_purpose(heuristic: Column, answered: Column) -> tuple[Column, Column]:
    """Purpose and its origin: background and theory stay; else a known answer of the classifier; else the heuristic."""
    stays = heuristic.isin("background-cite", "theory-cite")
    known = answered.isin(*PURPOSES)
    use = ~stays & F.coalesce(known, F.lit(False))
    return F.when(use, answered).otherwise(heuristic), F.when(stays, "heuristic").when(use, "classifier").otherwise("fallback")


#: Asks for the purpose of (paraphrase, raw text); an unknown or no answer leaves the heuristic one.
Classifier = Callable[[str, str], str | None]


def reclassified(citations: DataFrame, classifier: Classifier) -> DataFrame:
    """``citations`` with ``citation_purpose`` by ``augmented_purpose`` and its ``purpose_origin``; equal pairs are asked for once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_answer=pd.Series([classifier(p, r) for p, r in zip(b["_p"], b["_r"], strict=True)], index=b.index, dtype=object))

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    keyed = citations.withColumns({"_p": text("context_paraphrase"), "_r": text("raw_text")})
    asked = keyed.where(~F.coalesce(F.col("citation_purpose").isin("background-cite", "theory-cite"), F.lit(False))).select("_p", "_r").distinct()
    answers = asked.mapInPandas(run, "_p string, _r string, _answer string")
    purpose, origin = augmented_purpose(F.col("citation_purpose"), F.col("_answer"))
    joined = keyed.join(answers, ["_p", "_r"], "left").withColumns({"purpose_origin": origin, "citation_purpose": purpose})
    return joined.select(*citations.columns, "purpose_origin")


def match_paraphrases(citations: DataFrame, files: DataFrame, texts: DataFrame, scorer: Scorer = lexical_score) -> DataFrame:
    """One match per citation with a file: quote, score, status.

    ``citations``: id, ref_id, citation_purpose, context_paraphrase; ``files``:
    ref_id, pdf_path, with the last of a reference winning; ``texts``: path, text.
    """
    last = files.where(F.col("ref_id").isNotNull() & F.col("pdf_path").isNotNull()).groupBy("ref_id").agg(F.max_by("pdf_path", "id").alias("pdf_path"))
    base = citations.where(F.col("ref_id").isNotNull()).join(last, "ref_id").join(texts.withColumnRenamed("path", "pdf_path"), "pdf_path", "left")
    base = base.withColumn("_words", keywords(F.col("context_paraphrase")))
    quote = F.when(threshold_for(F.col("citation_purpose")).isNotNull(), F.left(source_quote(F.col("text"), F.col("_words")), F.lit(2000)))
    pairs = base.select(F.col("id").alias("citation_id"), "ref_id", "pdf_path", "citation_purpose", F.col("context_paraphrase").alias("paraphrase_text"), quote.alias("extracted_quote"))
    scored = score_pairs(pairs, scorer)
    status = paraphrase_status(F.col("citation_purpose"), F.col("extracted_quote"), F.col("score"))
    judged = scored.withColumns({"status": fold_in(status, F.col("score")), "threshold_applied": threshold_for(F.col("citation_purpose"))})
    # only the stored row is short, what is scored is whole
    return judged.withColumns({c: F.left(c, F.lit(STORED)) for c in ("paraphrase_text", "extracted_quote")})
