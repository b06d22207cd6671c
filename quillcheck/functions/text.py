"""Text primitives as Spark expressions.  A null input gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every line boundary that text files know, CR LF first.
LINE_BREAK = "\r\n|[\n\r\u000b\f\u001c\u001d\u001e\u0085  ]"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WIDE_DIGITS = ("０１２３４５６７８９", "0123456789")


def lines_of(text: Column) -> Column:
    """Lines without their breaks; no empty line after a final break, none for an empty text."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def spans(text: Column, pattern: str) -> Column:
    """Matches of a literal pattern as array<struct<raw, start, end>>, code-point offsets, end exclusive.

    Offsets are running sums of what stands between and in the matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, z: F.struct((a["at"] + F.length(z["g"]) + F.length(z["m"])).alias("at"), F.concat(a["starts"], F.array(a["at"] + F.length(z["g"]))).alias("starts"))
    starts = F.aggregate(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), matches.alias("m")), none, step, lambda a: a["starts"])
    built = F.transform(F.arrays_zip(matches.alias("m"), starts.alias("s")), lambda z: F.struct(z["m"].alias("raw"), z["s"].alias("start"), (z["s"] + F.length(z["m"])).alias("end")))
    return F.when(F.size(matches) > 0, built).otherwise(F.array().cast("array<struct<raw:string,start:int,end:int>>"))


def trie_pattern(words: list[str]) -> str:
    """One regular expression for the longest of some words at a place, in which common beginnings are tried once."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        branches = [(c if c.isalnum() else rf"\x{{{ord(c):x}}}") + written(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        return f"(?:{'|'.join(branches)}){'?' if '' in node else ''}"

    return written(root)


def rfind(haystack: Column, needle: Column | str) -> Column:
    """Last position of a substring from 0, -1 if it is absent."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    back = F.instr(F.reverse(haystack), F.reverse(n)) if not isinstance(needle, str) else F.locate(needle[::-1], F.reverse(haystack))
    return F.when(back == 0, -1).otherwise(F.length(haystack) - F.length(n) - back + 1)


def last_match(text: Column, pattern: str) -> Column:
    """Start of the last match, -1 if there is none."""
    return F.coalesce(F.array_max(F.transform(spans(text, pattern), lambda s: s["start"])), F.lit(-1))


def printed_digits(raw: Column) -> Column:
    """Digits behind the first decimal point of a printed number; 0 without one."""
    return F.length(F.regexp_extract(raw, r"\.(\d+)", 1))


def half_ulp_equal(a: Column, b: Column, digits: Column) -> Column:
    """Equal within half a unit of the last printed digit; false if either is null."""
    return F.coalesce(F.abs(a - b) <= F.pow(F.lit(10.0), -digits) * 0.5 + 1e-9, F.lit(False))


def approx_equal(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    """Equal within an absolute tolerance; false if either is null."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def rounded(value: Column, digits: Column) -> Column:
    """Rounded as a printed decimal of the binary value, half to even in exact arithmetic: the nearest printed number."""
    return F.coalesce(
        F.when(digits <= 0, F.rint(value)),
        *[F.when(digits == d, F.replace(F.format_number(value, d), F.lit(","), F.lit("")).try_cast("double")) for d in range(1, 10)],
        value,
    )


def to_number(cell: Column) -> Column:
    """A table cell as a finite double: minus signs, emphasis and missing marks as tables print them; else null."""
    c = F.replace(F.replace(F.trim(cell), F.lit("−"), F.lit("-")), F.lit("*"), F.lit(""))
    c = F.trim(F.translate(c, *WIDE_DIGITS))
    c = F.when(c.isin("", "—", "-", "✓", "✗", "N/A"), None).when(c.startswith("."), F.concat(F.lit("0"), c)).otherwise(c)
    value = F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def claim_number(raw: Column) -> Column:
    """A number of running text: a Unicode minus and a missing leading zero allowed; null if none."""
    c = F.translate(F.replace(raw, F.lit("−"), F.lit("-")), *WIDE_DIGITS)
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))


def whole_number(raw: Column) -> Column:
    """Digits as an int; null beyond its range."""
    return F.translate(raw, *WIDE_DIGITS).try_cast("int")


def word_count(text: Column) -> Column:
    """Words separated by white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))
