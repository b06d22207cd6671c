"""Extraction of typed numeric claims from lines of manuscripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcheck.functions.text import claim_number, lines_of, spans, whole_number
from quillcheck.schemas import PARSED_VALUE
from quillcheck.session import numbered


@dataclass(frozen=True)
class ClaimPattern:
    """One claim type: a regular expression and the names of its groups."""

    claim_type: str
    pattern: str
    keys: tuple[str, ...]


# A printed number, and the claim types in the order in which a line is searched.
NUM = r"([+−-]?\d*\.?\d+)"
PATTERNS = (
    ClaimPattern("F_stat", rf"\*?F\*?\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)\s*=\s*{NUM}", ("df1", "df2", "f")),
    ClaimPattern("p_adj", rf"\*?p[_ ]?adj\*?\s*=\s*{NUM}", ("p_adj",)),
    ClaimPattern("p_value", rf"\*?p\*?\s*([=<>])\s*{NUM}", ("op", "p")),
    ClaimPattern("beta", rf"β\s*=\s*{NUM}", ("beta",)),
    ClaimPattern("effect_dz", rf"\*?d[_ ]?z\*?\s*=\s*{NUM}", ("dz",)),
    ClaimPattern("alpha", rf"α\s*=\s*{NUM}", ("alpha",)),
    ClaimPattern("eta_squared", rf"(?:partial\s+)?η\s*[ₚp]?\s*[²2]?\s*=\s*{NUM}", ("eta_sq",)),
    ClaimPattern("N", r"\bN\s*=\s*(\d+)", ("n",)),
    ClaimPattern("V_wilcoxon", rf"\*?V\*?\s*=\s*{NUM}", ("v",)),
    ClaimPattern("M_mean", rf"\*M\*\s*=\s*{NUM}", ("m",)),
    ClaimPattern("SD", rf"\*SD\*\s*=\s*{NUM}", ("sd",)),
    ClaimPattern("CI_pair", rf"\[\s*{NUM}\s*,\s*{NUM}\s*\]", ("ci_low", "ci_high")),
    ClaimPattern("percent", r"(\d+\.\d+)\s*%", ("pct",)),
    ClaimPattern("rho", rf"ρ\s*=\s*{NUM}", ("rho",)),
    ClaimPattern("IRR", rf"IRR\s*=\s*{NUM}", ("irr",)),
    ClaimPattern("r_corr", rf"\*r\*\s*=\s*{NUM}", ("r",)),
)
SECTIONS = ("intro", "methods", "results", "discussion", "conclusion")
_SLOT = "array<struct<pat_ord:int,claim_type:string,raw_text:string,start_pos:int,end_pos:int,v:array<string>>>"


def text_lines(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("manuscript_id", "ms_ord", "section")) -> DataFrame:
    """One row per line of each text, numbered from 1; null and empty texts have none."""
    return texts.select(*keep, F.posexplode(lines_of(F.col(text))).alias("_at", "text")).select(*keep, (F.col("_at") + 1).alias("line_no"), "text")


def _found(text: Column, k: int, p: ClaimPattern) -> Column:
    unicode = f"(?U){p.pattern}"
    groups = [F.regexp_extract_all(text, F.lit(unicode), g + 1) for g in range(len(p.keys))]
    zipped = F.arrays_zip(spans(text, unicode).alias("s"), *[g.alias(f"g{i}") for i, g in enumerate(groups)])
    built = F.transform(
        zipped,
        lambda z: F.struct(
            F.lit(k).alias("pat_ord"), F.lit(p.claim_type).alias("claim_type"), z["s"]["raw"].alias("raw_text"), z["s"]["start"].alias("start_pos"), z["s"]["end"].alias("end_pos"),
            F.array(*[z[f"g{i}"] for i in range(len(p.keys))]).alias("v"),
        ),
    )
    return F.when(text.rlike(unicode), built.cast(_SLOT)).otherwise(F.array().cast(_SLOT))


def _parsed() -> Column:
    def value(field: str) -> Column:
        out = F.lit(None).cast(PARSED_VALUE[field].dataType)
        for p in PATTERNS:
            if field in p.keys:
                raw = F.get("v", F.lit(p.keys.index(field)))
                typed = raw if field == "op" else whole_number(raw) if field in ("df1", "df2", "n") else claim_number(raw)
                out = F.when(F.col("claim_type") == p.claim_type, typed).otherwise(out)
        return out.alias(field)

    return F.struct(*[value(f) for f in PARSED_VALUE.fieldNames()])


def extract_claims(lines: DataFrame, patterns: tuple[ClaimPattern, ...] = PATTERNS) -> DataFrame:
    """Claims of every line: all patterns in order, each match from left to right; no pattern consumes text.

    The columns of ``lines`` are kept; ``text`` becomes ``context_snippet``.
    One generator over one array, so the text is read once and not copied per
    pattern.  Null and empty lines have no claims.
    """
    kept = [c for c in lines.columns if c != "text"]
    found = F.concat(*[_found(F.col("text"), PATTERNS.index(p) if p in PATTERNS else len(PATTERNS), p) for p in patterns])
    rows = lines.where(F.col("text").isNotNull()).select(*kept, F.col("text").alias("context_snippet"), F.inline(found))
    keys = F.lit(None).cast("array<string>")
    for p in patterns:
        keys = F.when(F.col("claim_type") == p.claim_type, F.array(*map(F.lit, p.keys))).otherwise(keys)
    raw = F.map_filter(F.map_from_arrays(keys, "v"), lambda k, v: k != "op")
    return rows.select(*kept, "pat_ord", "claim_type", "raw_text", _parsed().alias("parsed_value"), "context_snippet", "start_pos", "end_pos", raw.alias("raw_values"))


def without_duplicate_manuscripts(lines: DataFrame) -> DataFrame:
    """Without combined files where single sections are present."""
    sections = lines.where(F.col("section").isin(*SECTIONS)).limit(1).select(F.lit(1).alias("_any"))
    return lines.join(F.broadcast(sections), F.col("section") == "combined", "left_anti")


def number_claims(claims: DataFrame) -> DataFrame:
    """``id`` in the order of manuscript, line, pattern and position, over all manuscripts.

    """
    return numbered(claims, ["ms_ord", "line_no", "pat_ord", "start_pos"], "claim-%04d")
