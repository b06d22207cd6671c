"""Text from scanned pages repaired into continuous paragraphs, with each defect reported.

Lines are placed in SQL windows per text.  Digits are masked so that running
headers of different pages become one form, whose frequency over all texts,
shape and break of the line flow tell it from prose; page numbers stand alone
or beside a header.  The remaining lines are reflowed: a word divided over two
lines is joined, or kept as a compound where only its parts are known.  Words
are grouped by a skeleton in which confusable glyphs fall together; a rare form
is a misreading of the group's frequent form if that form is supported by the
neighbouring words anywhere in the corpus.  A rare form that is two words of a
known sequence has lost its space.  Digits among letters, and letters among
digits, are misreadings by themselves.

What counts as frequent, known or shared is a share of all words or texts, or a
ratio of two counts, so it means the same at every size; only where a corpus is
so small that the share is less than a few occurrences do these decide.

Many records may carry the same quote, so equal quotes are one text: forms,
neighbours and headers are counted over distinct texts, each text is judged
once, and what is found is joined back to all its records.

Null, empty and blank quotes have no defects and no paragraph.  Repeated rows
are one record.  Words are counted before they are shuffled, pairs of words as
hashes.  Of the words as they occur only those are shuffled that are no frequent
form; these forms, at most one in ``FREQUENT`` of all words, are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillcheck.session import checkpointed, stored

DIVIDERS = "\\-‐‑¬\u00ad"
JOINT = "\u2060"
#: A frequent form is so many times as frequent as a misreading of it.
TIMES = 8
#: The same for forms that are only written with a capital: names resemble each other by nature.
NAME_TIMES = 24
#: Share of all words from which a form or a sequence is known, and its floor in small corpora; a leading form needs twice as much.
KNOWN, KNOWN_FLOOR = 1.5e-6, 2
#: Share of all words from which a form is frequent, and its floor in small corpora; at most 1 / FREQUENT forms can be.
FREQUENT, FREQUENT_FLOOR = 1e-5, 100
#: Share of all texts in which a masked line stands that is a header, and its floor in small corpora.
SHARED, SHARED_FLOOR = 5e-4, 4
KEY = ("text_id",)
RECORD = ("record_table", "record_id")

# Single glyphs that scanners take for each other, and glyphs that look like several others side by side.
CONFUSABLE = ("012456789elfh", "otzbsbtbgcttb")
STROKES = (("d", "ct"), ("m", "iii"), ("n", "ii"), ("u", "ii"), ("r", "i"), ("w", "vv"))
PAGE_ONLY = r"^(?:\[\s*\w{1,4}\s*\]|[—–-]\s*[\dOlIZSB]{1,4}\s*[—–-]|\d{1,4}|(?i:p(?:age|p)?\.?\s*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?)|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})$"
PAGE_BEHIND = r"(?:\s*\|\s*(?:p\.?|page|S\.)?\s*\d{1,4}|\s{3,}\d{1,4}|\s+(?:p\.|S\.)\s*\d{1,4})$"
PAGE_BEFORE = r"^\d{1,4}(?:\s{3,}|\s*\|\s*)"
VOLUME_LINE = r"^\p{Lu}[^()]*,\s*\p{L}{1,4}\.\s*\d+,\s*\p{L}{1,4}[.°]\s*\d+$"
#: Share of the longer words that are capitalised in a title; where it is not all of them, other texts must share the line.
TITLE_WORDS = 0.8
CAPITALS = r"^[^\p{Ll}]*\p{Lu}{3,}[^\p{Ll}]*$"
SPACED = r"^(?:\S\s+){5,}\S$"
SHORT_NAME = r"^(?:\p{L}[\p{L}’'-]*\s+){1,3}et al\.?$"
WORD = r"([\p{L}\p{N}\p{M}⁠]+(?:['’-][\p{L}\p{N}⁠]+)*)"


def skeleton(word: Column) -> Column:
    """The form in which confusable glyphs fall together."""
    out = F.translate(F.lower(word), *CONFUSABLE)
    for glyph, strokes in STROKES:
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return out


def text_key() -> Column:
    """What identifies a quote."""
    return F.unhex(F.md5("quote")).alias("text_id")


def records_of(quotes: DataFrame) -> DataFrame:
    """``record_table, record_id, text_id`` of the quotes that are not blank; equal quotes have one text."""
    return quotes.where(F.col("quote").rlike(r"\S")).select(*RECORD, text_key())


def _next(value: Column) -> Column:
    """The first non-null value of the lines below; windows run upwards, so the time is linear."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*KEY).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1))


def quote_lines(quotes: DataFrame) -> DataFrame:
    """Non-blank lines of each distinct text with ``page_number`` and ``running_header`` flags; all lines of a text in one partition.

    ``quotes``: record_table, record_id, quote.
    """
    texts = quotes.where(F.col("quote").rlike(r"\S")).select(text_key(), "quote").groupBy(*KEY).agg(F.first("quote").alias("quote"))
    texts = texts.repartition(int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)
    lines = texts.select(*KEY, F.posexplode(F.split("quote", r"\r\n|[\n\r\u000B\f\u0085\u2028\u2029]")).alias("line_no", "raw")).where(F.col("raw").rlike(r"\S"))
    lines = lines.select(*KEY, "line_no", F.btrim(F.col("raw"), F.lit(" \t\u00a0")).alias("text"))
    behind, before = F.col("text").rlike(PAGE_BEHIND), F.col("text").rlike(PAGE_BEFORE)
    core = F.btrim(F.regexp_replace(F.regexp_replace("text", PAGE_BEHIND, ""), PAGE_BEFORE, ""))
    lines = lines.withColumns({"core": core, "affix": behind | before, "page_only": F.col("text").rlike(PAGE_ONLY)})
    letters = F.regexp_replace("core", r"[^\p{L}]", "")
    strong = (F.col("core").rlike(CAPITALS) & (F.length(letters) >= 6) & F.col("core").rlike(r"\s")) | (F.col("core").rlike(SPACED) & (F.length(letters) >= 6)) | F.col("core").rlike(SHORT_NAME)
    strong = strong | F.col("core").rlike(r"^\p{Lu}[\p{Lu}’'.\s-]*\s+[·•]\s+\S") | F.col("core").rlike(VOLUME_LINE)
    ends = F.col("core").rlike(r"[.!?…:;,][\p{Pe}\p{Pf}\"']*$")
    long_words, capitals = F.regexp_count("core", F.lit(r"\p{L}{4,}")), F.regexp_count("core", F.lit(r"(?<!\p{L})\p{Lu}\p{L}{3,}"))
    named = F.col("core").rlike(r"^\p{Lu}[^()]*\s[^()]*$") & ~ends & F.col("core").rlike(r"\p{Ll}") & ~F.col("core").rlike(r"[.!?;:]\s|://")
    titled = named & (long_words == capitals)
    lines = lines.withColumns({"strong": strong, "titled": titled, "partly": named & (long_words >= 2) & (capitals >= TITLE_WORDS * long_words), "ends": ends, "masked": F.lower(F.regexp_replace("core", r"\d+", "#"))})

    prose = ~F.col("page_only") & ~F.col("strong")
    above = Window.partitionBy(*KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({
        "width": F.max(F.when(prose & ~F.col("titled"), F.length("text"))).over(Window.partitionBy(*KEY)),
        "last_prose": F.max(prose).over(above),
        "next_prose": _next(F.when(prose, F.length(F.regexp_extract("text", r"^(\S+)", 1)))),
    })
    # a line that would have had room for the next word did not end by wrapping
    broken_after = F.col("next_prose").isNotNull() & (F.length("core") + 1 + F.col("next_prose") <= F.col("width") * 0.95)
    lone_end = F.col("next_prose").isNull() & F.coalesce("last_prose", F.lit(False))
    out_of_flow = broken_after | lone_end | F.col("width").isNull()
    lines = lines.withColumn("loose", out_of_flow & ~F.col("ends") & ~F.col("text").contains("://"))
    # masked lines of so large a share of the texts are few: at most the lines of a text by SHARED
    least = F.greatest(F.lit(SHARED_FLOOR), SHARED * F.col("texts_all"))
    all_texts = texts.agg(F.count("*").alias("texts_all"))
    shared = lines.where(~F.col("page_only") & (F.col("titled") | F.col("partly"))).groupBy("masked").agg(F.count_distinct(*KEY).alias("texts")).crossJoin(F.broadcast(all_texts)).where(F.col("texts") >= least).select("masked", F.lit(True).alias("shared"))  # one row
    lines = lines.join(F.broadcast(shared), ["masked"], "left")
    header = ~F.col("page_only") & (F.col("strong") | (F.col("titled") & F.col("loose")) | ((F.col("titled") | F.col("partly")) & F.col("shared").isNotNull()) | (F.col("affix") & F.col("loose") & F.col("core").rlike(r"\p{Lu}")))
    lines = lines.withColumn("running_header", header)
    return lines.select(*KEY, "line_no", "text", "running_header", (F.col("page_only") | (header & F.col("affix"))).alias("page_number"))


def reflowed(lines: DataFrame) -> DataFrame:
    """``running_header, page_number, divided``, continuous ``prose`` and its words ``t`` of each text; divided words hold a joint where the line ended."""
    body = ~F.col("running_header") & ~F.col("page_number")
    following = _next(F.when(body, F.col("text")))
    divided = body & F.col("text").rlike(rf"[\p{{L}}\p{{N}}][{DIVIDERS}]$") & F.coalesce(following.rlike(r"^[\p{L}\p{N}]"), F.lit(False))
    lines = lines.withColumn("divided", divided)
    piece = F.when(F.col("divided"), F.concat(F.regexp_replace("text", rf"[{DIVIDERS}]$", ""), F.lit(JOINT))).otherwise(F.concat("text", F.lit(" ")))
    flags = [F.max(c).alias(c) for c in ("running_header", "page_number", "divided")]
    collected = lines.groupBy(*KEY).agg(*flags, F.array_sort(F.collect_list(F.when(body, F.struct("line_no", piece.alias("piece"))))).alias("pieces"))
    prose = collected.select(*KEY, "running_header", "page_number", "divided", F.btrim(F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).alias("prose"))
    return prose.withColumn("t", F.regexp_extract_all("prose", F.lit(WORD), 1))


WHOLE = r"^[\p{L}\p{M}'’-]+$"


def _occurrences(prose: DataFrame) -> DataFrame:
    """Words as they occur, with their neighbours in lower case; a word in digits keeps its digits."""
    tokens = prose.where(F.size("t") > 0).select(*KEY, "t")
    at = F.transform("t", lambda w, i: F.struct(w.alias("word"), F.lower(F.get("t", i - 1)).alias("before"), F.lower(F.get("t", i + 1)).alias("after")))
    return tokens.select(*KEY, F.inline(at)).withColumn("form", F.lower("word"))


def _pairs(prose: DataFrame, key) -> DataFrame:
    """``h, n_pair``: how often words whose ``key`` has this hash follow each other; only hashes are shuffled."""
    both = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.struct(F.lower(F.get("t", i - 1)).alias("a"), F.lower(F.get("t", i)).alias("b")))
    rows = prose.where(F.size("t") > 1).select(F.inline(both)).where(F.col("a").rlike(WHOLE) & F.col("b").rlike(WHOLE))
    return rows.select(F.xxhash64(key(F.col("a")), key(F.col("b"))).alias("h")).groupBy("h").agg(F.count("*").alias("n_pair"))


def misread_words(prose: DataFrame) -> DataFrame:
    """``text_id, word, meant`` of words recognised wrongly or run together; ``prose`` as ``reflowed`` gives it."""
    # forms with the leading form of their skeleton
    words = prose.select(F.explode("t").alias("word"))
    forms = words.select(F.lower("word").alias("form"), F.col("word").rlike(r"^\p{Ll}").alias("small")).where(F.col("form").rlike(WHOLE)).groupBy("form").agg(F.count("*").alias("n"), F.count_if("small").alias("n_small"))
    lead = F.max(F.struct("n", "form", "n_small")).over(Window.partitionBy("skeleton"))
    forms = checkpointed(forms.withColumn("skeleton", skeleton(F.col("form"))).withColumn("lead", lead))
    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known_from = max(KNOWN_FLOOR, KNOWN * total)
    times = F.when(F.col("lead.n_small") > 0, TIMES).otherwise(NAME_TIMES)
    leads = F.col("lead.n") >= 2 * known_from
    leading = forms.where(leads & (F.col("form") == F.col("lead.form"))).select("skeleton", F.col("form").alias("meant"))
    is_rare = leads & (F.col("form") != F.col("lead.form")) & (F.col("lead.n") >= times * F.col("n"))
    rare = forms.where(is_rare).select("form", F.col("lead.form").alias("meant"))

    # a frequent form is judged as a form; of the others every occurrence is looked at
    frequent = forms.where((F.col("n") >= max(FREQUENT_FLOOR, FREQUENT * total)) & ~is_rare).select("form")
    words = stored(_occurrences(prose).join(F.broadcast(frequent), ["form"], "left_anti"))
    whole = words.where(~F.col("form").contains(JOINT) & F.col("form").rlike(WHOLE))

    # letters among digits and digits among letters
    has_both = F.col("form").rlike(r"\p{Nd}") & F.col("form").rlike(r"\p{L}")
    lawful = F.col("form").rlike(r"^(?:1[5-9]|20)\d\d[a-z]$|^(?:1[5-9]|20)\d0s$|^\d+(?:st|nd|rd|th|er|ère|ème|º|ª|ms|mm|px)$|^v\d{1,2}$|^\d{1,3}-\p{L}{3,}$")
    digits = F.translate("form", "olizsbgq", "01125699")
    mixed = words.where(~F.col("form").contains(JOINT) & has_both & ~lawful).select(*KEY, "word", F.when(digits.rlike(r"^\d+$") & (2 * F.length(F.regexp_replace("form", r"\d", "")) <= F.length("form")), digits).alias("number"), skeleton(F.col("form")).alias("skeleton"))

    # a divided word is known joined, or as a compound of known parts; else it is judged joined
    parts = F.split("form", JOINT)
    divided = words.where(F.col("form").contains(JOINT)).withColumns({"joined": F.replace("form", F.lit(JOINT), F.lit("")), "head": F.element_at(F.split(F.get(parts, F.lit(0)), "-"), -1), "tail": F.get(F.split(F.get(parts, F.size(parts) - 1), "-"), F.lit(0))})
    odd = divided.where(F.col("joined").rlike(r"\p{Nd}") & F.col("joined").rlike(r"\p{L}") & ~F.col("joined").rlike(r"^\d+\p{L}{3,}$")).select(*KEY, "word", F.lit(None).cast("string").alias("meant"))
    known = forms.where((F.col("n") >= known_from) & ~is_rare).select("form")
    parts_known = _known_parts(forms, known_from)
    lone = divided.where(F.col("joined").rlike(WHOLE))
    lone = lone.join(known.select(F.col("form").alias("joined")), ["joined"], "left_anti")
    # both parts are looked up at once: a division whose two parts are known is a compound
    ends = lone.select("head", "tail").distinct().select("head", "tail", F.explode(F.array("head", "tail")).alias("form")).join(parts_known, ["form"], "left_anti").select("head", "tail").distinct()
    lone = lone.join(ends, ["head", "tail"], "left_semi").select(*KEY, "word", "before", "after", F.col("joined").alias("form"), F.lit(0).cast("long").alias("n"), skeleton(F.col("joined")).alias("skeleton"))
    lone = checkpointed(lone)

    suspects = whole.join(rare, ["form"]).select(*KEY, "word", "before", "after", "meant")
    suspects = suspects.unionByName(lone.join(leading, ["skeleton"]).where(F.col("form") != F.col("meant")).select(*KEY, "word", "before", "after", "meant"))
    # support of the frequent form by either neighbour
    sides = F.array(F.xxhash64("before", "meant"), F.xxhash64("meant", "after"))
    asked = suspects.select(*KEY, "word", "meant", F.explode(sides).alias("h"))
    wrong = asked.join(_pairs(prose, lambda w: w), ["h"], "left_semi").select(*KEY, "word", "meant")

    # two known words that follow each other elsewhere, without their space: every way to part the skeleton is looked up
    unknown = forms.select("form", "n", "skeleton").unionByName(lone.select("form", "n", "skeleton").distinct()).where(F.length("form") >= 5)
    cut = F.transform(F.sequence(F.lit(1), F.length("skeleton") - 1), lambda i: F.struct(F.substring("skeleton", F.lit(1), i).alias("first"), F.substring("skeleton", i + 1, F.length("skeleton")).alias("second")))
    halves = unknown.select("form", "n", F.inline(cut)).withColumn("h", F.xxhash64("first", "second"))
    hits = halves.join(_pairs(prose, skeleton), ["h"]).where(F.col("n_pair") >= F.greatest(2 * F.greatest("n", F.lit(1)), F.lit(known_from)))
    best = hits.groupBy("form").agg(F.max_by(F.struct("first", "second"), F.struct("n_pair", "first")).alias("p")).select("form", "p.*")
    lead_of = lambda c, to: forms.where(F.col("form") == F.col("lead.form")).select(F.col("skeleton").alias(c), F.col("form").alias(to))
    unspaced = best.join(lead_of("first", "a"), ["first"]).join(lead_of("second", "b"), ["second"])
    unspaced = checkpointed(unspaced.where((F.col("form") == F.concat("a", "b")) | (F.length("form") >= 8)).select("form", F.concat_ws(" ", "a", "b").alias("meant")))
    glued = whole.select(*KEY, "word", "form").unionByName(lone.select(*KEY, "word", "form")).join(unspaced, ["form"]).select(*KEY, "word", "meant")
    often = F.broadcast(unspaced.join(F.broadcast(frequent), ["form"], "left_semi"))  # some of the frequent forms
    glued = glued.unionByName(_occurrences(prose).join(often, ["form"]).select(*KEY, "word", "meant"))
    mixed = mixed.join(leading, ["skeleton"], "left").select(*KEY, "word", F.coalesce("number", "meant").alias("meant"))
    return mixed.unionByName(odd).unionByName(wrong).unionByName(glued)


def _known_parts(forms: DataFrame, known_from: float) -> DataFrame:
    """Parts of forms, compounds taken apart, that are known."""
    return forms.select(F.explode(F.split("form", "-")).alias("form"), "n").groupBy("form").agg(F.sum("n").alias("n")).where(F.col("n") >= known_from).select("form")


#: Letters read for digits that stand alone inside a number.
LONE_IN_NUMBER = r"(?<![\p{L}\p{N}])[lOIZSB](?=[.,]\d)|(?<=\d[.,])[lOIZSB]{1,3}(?![\p{L}\p{N}])|\([lOIZSB], ?\d|[=<>] ?[−-]?\.[lOIZSB]{1,3}(?![\p{L}\p{N}])"


def judged(quotes: DataFrame) -> DataFrame:
    """The distinct texts as ``reflowed`` gives them, written once for the passes that count and judge."""
    return stored(reflowed(quote_lines(quotes)))


def scan_defects(quotes: DataFrame) -> DataFrame:
    """``record_table, record_id, defect`` of every record, once per kind of defect."""
    prose = judged(quotes)
    misread = misread_words(prose).select(*KEY).unionByName(prose.where(F.col("prose").rlike(LONE_IN_NUMBER)).select(*KEY)).distinct().select(*KEY, F.array(F.lit("misread")).alias("defects"))
    kinds = F.array_compact(F.array(*[F.when(F.col(c), F.lit(d)) for c, d in (("running_header", "running_header"), ("page_number", "page_number"), ("divided", "hyphen_break"))]))
    out = prose.select(*KEY, kinds.alias("defects")).where(F.size("defects") > 0).unionByName(misread)
    return records_of(quotes).distinct().join(out, list(KEY)).select(*RECORD, F.explode("defects").alias("defect")).distinct()


def quotes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes of library files and paraphrase matches."""
    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("record_table"), F.col("id").alias("record_id"), F.col("extracted_quote").alias("quote")) for t in ("source_pdfs", "paraphrase_matches")]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of the quotes."""
    return scan_defects(quotes_of(spark, sf_dir))


def repaired(quotes: DataFrame) -> DataFrame:
    """``record_table, record_id, paragraph``: the prose reflowed, divided words joined, misread words replaced."""
    prose = judged(quotes)
    capital = F.concat(F.upper(F.substring("meant", 1, 1)), F.substring("meant", 2, 1 << 20))
    fixes = misread_words(prose).where(F.col("meant").isNotNull()).groupBy(*KEY, "word").agg(F.min("meant").alias("meant"))
    fixes = fixes.withColumn("as_written", F.when(F.col("word").rlike(r"^\p{Lu}"), capital).otherwise(F.col("meant"))).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("word", "as_written"))).alias("fixes"))
    words = prose.select(F.explode("t").alias("word")).select(F.lower("word").alias("form")).where(~F.col("form").contains(JOINT)).groupBy("form").agg(F.count("*").alias("n"))
    words = checkpointed(words)
    known_from = max(KNOWN_FLOOR, KNOWN * words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    parts_known = _known_parts(words, known_from)
    words = words.where(F.col("n") >= known_from).select("form")
    joints = prose.select(*KEY, F.explode(F.regexp_extract_all("prose", F.lit(rf"([\p{{L}}\p{{N}}]+{JOINT}[\p{{L}}\p{{N}}]+)"), 1)).alias("joint")).distinct()
    parts = F.split("joint", JOINT)
    joints = joints.withColumns({"form": F.lower(F.replace("joint", F.lit(JOINT), F.lit(""))), "head": F.lower(F.get(parts, F.lit(0))), "tail": F.lower(F.get(parts, F.lit(1)))})
    apart = joints.join(words, ["form"], "left_anti").join(parts_known.withColumnRenamed("form", "head"), ["head"], "left_semi").join(parts_known.withColumnRenamed("form", "tail"), ["tail"], "left_semi")
    compounds = apart.groupBy(*KEY).agg(F.collect_set("joint").alias("compounds"))
    joined = prose.join(compounds, list(KEY), "left").join(fixes, list(KEY), "left")
    text = F.aggregate(F.coalesce("compounds", F.array().cast("array<string>")), F.col("prose"), lambda t, j: F.replace(t, j, F.replace(j, F.lit(JOINT), F.lit("-"))))
    entries = F.coalesce(F.map_entries("fixes"), F.array().cast("array<struct<key:string,value:string>>"))
    text = F.aggregate(entries, text, lambda t, e: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), e["key"], F.lit(r"\E(?![\p{L}\p{N}])")), e["value"]))
    paragraphs = joined.where(F.length("prose") > 0).select(*KEY, F.replace(text, F.lit(JOINT), F.lit("")).alias("paragraph"))
    return records_of(quotes).distinct().join(paragraphs, list(KEY)).select(*RECORD, "paragraph")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes as continuous paragraphs."""
    return repaired(quotes_of(spark, sf_dir))
