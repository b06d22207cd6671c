"""Text that looks ordinary but is made of other characters, brought to one plain form.

A text is first normalised for compatibility (full-width forms, ligatures,
mathematical digits, loose combining marks, unusual spaces) and freed of
ignorable characters.  Each remaining word that holds a character with a
look-alike then becomes a lattice: every character may stay or be read as one
of its look-alikes.  Viterbi search finds the best path under a character
n-gram model learnt from the consistent words of the whole corpus; a path pays
for each change of script and for each character read differently.  A genuine
word of another script has a consistent path of its own and stays.

Plain form: printable ASCII, precomposed accented letters, whole Hangul
syllables, the statistic symbols, a superscript two, the minus sign, angle
quotation marks, and genuine words of other scripts.

Null texts give no row; empty ones are plain.  Repeated rows are one record.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.session import collect_bounded, once_per_worker, spread

# Characters and the plain ones they are mistaken for.
LOOK_ALIKES = {
    # Cyrillic
    "а": "aα", "е": "e", "о": "o", "р": "pρ", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "к": "k", "ё": "ë", "ї": "ï", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "υ": "u", "κ": "k", "α": "a", "ρ": "p", "η": "n", "γ": "y", "τ": "t", "ω": "w", "χ": "x", "β": "ß", "ϲ": "c", "ϳ": "j", "σ": "o", "ε": "e",
    # Armenian
    "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "զ": "q", "ք": "f", "յ": "j", "Ս": "U", "Տ": "S", "Օ": "O", "Լ": "L",
    # Latin letters outside plain form
    "ı": "i", "ɑ": "aα", "ɡ": "g", "ɩ": "i", "ɪ": "i", "ß": "β", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴄ": "c", "ꜱ": "s", "ƅ": "b", "ƿ": "p", "ǀ": "l", "ɴ": "n", "ʏ": "y",
    # Cherokee
    "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮃ": "W", "Ꮓ": "Z", "Ꮯ": "C", "Ᏼ": "B",
}
# Marks of other shapes for plain ones.
MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "﹣": "-", "－": "-", "⁃": "-", "‘": "'", "’": "'", "‚": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"', "∗": "*", "⁎": "*", "∼": "~", "⁄": "/", "∕": "/", "ˆ": "^", "∶": ":", "։": ":", "․": ".", "꞊": "=", "՝": "'"}
SYMBOLS = "βαρη²−«»"
#: Characters whose bare presence needs no closer look; the rest is examined.
#: Of the accented letters those are left out that compatibility normalisation takes apart (ĳ ŀ ŉ ſ) and the sharp s and dotless i, which others look like.
ACCENTED = "À-ÖØ-Þà-öø-İĴ-ľŁ-ňŊ-ž"
SAFE = rf"^[\x20-\x7E가-힣βαρη²−«»{ACCENTED}]*$"
#: Greek symbols inside a word, or the sharp s, are letters read as others.
SYMBOL_IN_WORD = r"[βαρη][\p{L}\p{Nd}]|[\p{L}][βαρη]|ß"
LATTICE_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Distinct character pairs of the scripts that have look-alikes; alphabets bound it.
MAX_PAIRS = 400_000
SWITCH_COST = 7.0
CHANGE_COST = 2.5
FLOOR = 1e-6


def script_of(c: str) -> str:
    """Coarse script of a character; symbols of statistics count as Greek."""
    o = ord(c)
    if o < 0x250 or 0x1D00 <= o < 0x2000 or 0xA720 <= o < 0xA800 or 0x250 <= o < 0x2B0:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x530 <= o < 0x590:
        return "armenian"
    if 0x13A0 <= o < 0x1400:
        return "cherokee"
    return "other"


def _plain_letter(c: str) -> bool:
    if c.isascii() or "가" <= c <= "힣" or ("À" <= c <= "ſ" and c not in "ı×÷"):
        return True
    if script_of(c) == "latin":
        base = unicodedata.normalize("NFD", c)
        return len(base) > 1 and base[0].isascii()
    return True


class Plainer:
    """Decoder with a character model: pairs of neighbouring characters and how often they occur."""

    def __init__(self, pairs: dict[str, int]) -> None:
        left: dict[str, int] = {}
        for pair, n in pairs.items():
            left[pair[0]] = left.get(pair[0], 0) + n
        self.score = {pair: math.log(n / left[pair[0]]) for pair, n in pairs.items()}
        self.unseen = math.log(FLOOR)
        self.known: dict[str, str] = {}

    def word(self, word: str) -> str:
        """The best reading of one word."""
        if (hit := self.known.get(word)) is not None:
            return hit
        options = [(c, *LOOK_ALIKES.get(c, "")) for c in word]
        if all(len(o) == 1 for o in options):
            best = word
        else:
            layer: dict[str, tuple[float, str]] = {"^": (0.0, "")}
            score, unseen = self.score, self.unseen
            for original, choices in zip(word, options, strict=True):
                following: dict[str, tuple[float, str]] = {}
                for c in choices:
                    cost = 0.0 if c == original else CHANGE_COST
                    if c == original and not _plain_letter(c):
                        cost += SWITCH_COST
                    for before, (so_far, path) in layer.items():
                        s = so_far - cost + score.get(before + c, unseen)
                        if before != "^" and script_of(before) != script_of(c):
                            s -= SWITCH_COST
                        if c not in following or s > following[c][0]:
                            following[c] = (s, path + c)
                layer = following
            best = max((s + score.get(c + "$", unseen), path) for c, (s, path) in layer.items())[1]
        if len(self.known) < 100_000:
            self.known[word] = best
        return best

    def plain(self, text: str) -> str:
        """The plain form; equal to the text exactly if every character is in plain form already."""
        out = []
        for c in text:
            if c == "²":
                out.append(c)
                continue
            kind = unicodedata.category(c)
            if kind == "Cf" or c in "ᅟᅠ឴឵ㅤﾠ͏" or "︀" <= c <= "️":
                continue
            if kind in ("Zs", "Zl", "Zp", "Cc"):
                out.append(" ")
                continue
            out.append(c)
        pieces = unicodedata.normalize("NFC", "".join(out)).split("²")
        folded = "²".join(unicodedata.normalize("NFKC", p) for p in pieces)
        folded = "".join(MARKS.get(c, c) for c in folded)
        return LATTICE_WORD.sub(lambda m: self.word(m[0]), folded)

    def is_plain(self, text: str) -> bool:
        """Whether every character of the text is in plain form."""
        if self.plain(text) != text:
            return False
        return all(c.isascii() or c in SYMBOLS or unicodedata.category(c)[0] in "LMN" for c in text)


def character_pairs(texts: DataFrame, *columns: str) -> dict[str, int]:
    """Counts of neighbouring characters in consistent words, with ``^`` and ``$`` at the ends, over all rows.

    Words are counted first, so only distinct words are taken apart.  A word
    counts if it is Latin, a single statistic symbol, or of one other script
    with at least one character that nothing plain looks like.
    """
    latin = rf"^[A-Za-zß{ACCENTED}]+$"
    lone = "".join(c for c in LOOK_ALIKES if script_of(c) in ("greek", "cyrillic", "armenian"))
    foreign = [rf"^\p{{{s}}}*[\p{{{s}}}&&[^{lone}]]\p{{{s}}}*$" for s in ("IsCyrillic", "IsGreek", "IsArmenian")]
    words = None
    for c in columns:
        part = texts.select(F.explode(F.regexp_extract_all(F.col(c), F.lit(r"(\p{L}+)"), 1)).alias("w"))
        words = part if words is None else words.unionByName(part)
    keep = F.col("w").rlike(latin) | F.col("w").isin(*"βαρη")
    for pattern in foreign:
        keep = keep | F.col("w").rlike(pattern)
    counted = words.where(keep).groupBy("w").count()
    padded = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    pairs = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("pair"), "count")
    rows = collect_bounded(pairs.groupBy("pair").agg(F.sum("count").alias("n")), MAX_PAIRS, "the table of character pairs")
    return {r["pair"]: r["n"] for r in rows}


def suspicious(column: F.Column) -> F.Column:
    """Whether a text holds anything that the decoder has to look at; decided in the JVM."""
    return ~column.rlike(SAFE) | column.rlike(SYMBOL_IN_WORD)


def plain_forms(texts: DataFrame, id_column: str, columns: tuple[str, ...]) -> DataFrame:
    """(id, field_name, text, plain_text) of every field that is not in plain form."""
    spark = texts.sparkSession
    shared, key = spark.sparkContext.broadcast(character_pairs(texts, *columns)), uuid.uuid4().hex
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns])).alias("_field")
    rows = texts.select(F.col(id_column), fields).select(id_column, "_field.field_name", "_field.text")
    rows = spread(rows).where(F.col("text").isNotNull() & suspicious(F.col("text")))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        plainer = once_per_worker(key, lambda: Plainer(shared.value))
        for batch in batches:
            yield pd.Series([None if plainer.is_plain(t) else plainer.plain(t) for t in batch], dtype=object)

    return rows.withColumn("plain_text", decode("text")).where(F.col("plain_text").isNotNull())


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/numerical_claims.parquet").select(F.col("id").alias("claim_id"), "raw_text", "context_snippet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of numerical_claims with a character that is not in plain form."""
    return plain_forms(_claims(spark, sf_dir), "claim_id", ("raw_text", "context_snippet")).select("claim_id", "field_name").distinct()


def p3_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain text of those fields."""
    return plain_forms(_claims(spark, sf_dir), "claim_id", ("raw_text", "context_snippet")).select("claim_id", "field_name", "plain_text").distinct()
