"""Freely typed values mapped to the entries of a canonical list.

Words are sets of characters and padded character pairs.  A word of a typed
value is corrected to words of the catalog by a prefix-filter set-similarity
join: tokens are ordered by their frequency over all data, rarest first, only
the rare prefix of a set is looked up in the inverted index of the catalog,
candidates pass a length and a positional filter, and Jaccard similarity is
verified exactly.  Abbreviations are looked up in indexes of beginnings and of
consonant skeletons, with one letter left out where a slip is allowed.  On the
level of phrases the same join is made with the corrected words as tokens: only
the rare prefix of an entry's words is indexed, candidates pass the length and
the positional filter in weights, and the soft Jaccard similarity is verified
exactly; the best catalog entry above the threshold wins, a tie between measures
is no match.

The catalog is a fixed table; its size is checked before it is broadcast.
Frequencies are counted over all data, but only of tokens the catalog has, so
their table is as small as the catalog.  What may stand before or behind a
measure is learnt from the values that are mapped without it: words that are no
words of the catalog and stand beside many measures.  Null and blank values give
no row.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.functions.names import edit_distance
from quillcheck.llm.lookalike import Plainer, character_pairs
from quillcheck.session import checkpointed, collect_bounded, once_per_worker, shuffled, spread

MAX_CATALOG = 100_000
#: Tokens of the catalog, and words learnt to stand beside its measures.
MAX_TOKENS = 100 * MAX_CATALOG
MAX_AFFIXES = 10_000
#: A word beside so large a part of the measures belongs to none of them.
AFFIX_SHARE = 0.1
#: Similarity from which a word may be read as a word of the catalog.
WORD_SIMILARITY = 0.4
#: Similarity of phrases, over words or over the letters of the whole, from which an entry is meant.
PHRASE_SIMILARITY = 0.55
LETTER_SIMILARITY = 0.6
#: Similarity of phrases of other scripts, where words are short.
OTHER_SIMILARITY = 0.5
UNMATCHED = "unmatched"
# Small words of English measure names.
SMALL = set("of on in the to a an and with for at by is".split())
KOREAN_ENDINGS = re.compile(r"(?:에서|에게|에는|에|으로|로|은|는|이|가|을|를|의|와|과|도)$")
DIGITS = str.maketrans("013457", "oieast")
WORDS = regex.compile(r"\p{Hangul}+|(?:(?!\p{Hangul})[\p{L}\p{M}\p{Nd}])+\.?")
HYPHEN = re.compile(r"(?<=\w)[-‐‑](?=\w)")
VOWELS = set("aeiou")
#: Separators inside a typed value.
PUNCTUATION = r"[_\-/,()\[\]]+"
Affixes = frozenset[tuple[str, ...]]


def normal(text: str) -> str:
    """Compatible, lower-case, without marks; digits inside words are letters."""
    text = unicodedata.normalize("NFKC", text).casefold()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    text = unicodedata.normalize("NFC", text)
    return re.sub(r"(?<=[a-z])[013457]|[013457](?=[a-z]{2})", lambda m: m[0].translate(DIGITS), text)


def word_tokens(word: str) -> frozenset[str]:
    """Characters (numbered when repeated) and padded pairs of a word."""
    out, seen = set(), {}
    for c in word:
        seen[c] = seen.get(c, 0) + 1
        out.add(f"{c}{seen[c]}")
    padded = f"_{word}_"
    out.update(padded[i : i + 2] for i in range(len(padded) - 1))
    return frozenset(out)


def skeleton(word: str) -> str:
    """The first letter and the consonants behind it."""
    return word[:1] + "".join(c for c in word[1:] if c not in VOWELS)


def jaccard(a: frozenset, b: frozenset) -> float:
    """Exact similarity of two sets."""
    if not a or not b:
        return 0.0
    common = len(a & b)
    return common / (len(a) + len(b) - common)


class SetJoin:
    """Inverted index over the prefixes of a fixed collection of token sets."""

    def __init__(self, sets: list[frozenset[str]], frequency: dict[str, int], threshold: float) -> None:
        self.frequency, self.threshold = frequency, threshold
        self.sets = sets
        self.index: dict[str, list[tuple[int, int]]] = {}
        for k, s in enumerate(sets):
            ordered = self.ordered(s)
            for position, token in enumerate(ordered[: self.prefix(len(ordered))]):
                self.index.setdefault(token, []).append((k, position))

    def ordered(self, tokens: frozenset[str]) -> list[str]:
        """Tokens by global rarity; those the collection lacks are rarest and match nothing."""
        return sorted(tokens, key=lambda t: (self.frequency.get(t, 0), t))

    def prefix(self, size: int) -> int:
        """So many of the rarest tokens must share one with any set that is similar enough."""
        return size - max(1, -int(-self.threshold * size // 1)) + 1

    def similar(self, tokens: frozenset[str], least: float | None = None) -> list[tuple[float, int]]:
        """(similarity, set) of every set at or above ``least``, by default the threshold of the index; best first."""
        size, t = len(tokens), max(self.threshold, least or 0.0)
        ordered = self.ordered(tokens)
        seen: set[int] = set()
        found = []
        for position, token in enumerate(ordered[: size - max(1, -int(-t * size // 1)) + 1]):
            for k, at in self.index.get(token, ()):
                if k in seen:
                    continue
                other = len(self.sets[k])
                if other < t * size or other * t > size:
                    continue
                needed = t / (1 + t) * (size + other)
                if 1 + min(size - position - 1, other - at - 1) < needed - 1e-9:
                    continue
                seen.add(k)
                s = jaccard(tokens, self.sets[k])
                if s >= t:
                    found.append((s, k))
        return sorted(found, key=lambda x: (-x[0], x[1]))


@dataclass(frozen=True)
class Name:
    """One written form of a catalog entry."""

    entry: str
    words: tuple[str, ...]
    letters: str
    latin: bool


def weight(word: str) -> float:
    """What a word counts in the similarity of phrases."""
    return 0.4 if word in SMALL else 1.0


class PhraseJoin:
    """Inverted index over the rare prefixes of the words of names, for a soft Jaccard similarity.

    Words of a name weigh differently, and a typed word meets one of its words
    in part.  What is met weighs at most as much as the words of the name that
    any typed word may be; similarity t of phrases that weigh a and b needs
    t / (1 + t) * (a + b) of it.
    """

    def __init__(self, names: list[Name], frequency: dict[str, int], threshold: float) -> None:
        self.frequency, self.threshold = frequency, threshold
        self.weights = [sum(map(weight, n.words)) for n in names]
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, n in enumerate(names):
            rest = sum(map(weight, set(n.words)))
            for w in self.ordered(set(n.words)):
                if rest < threshold / (1 + threshold) * self.weights[k] - 1e-9:
                    break  # what follows is too little by itself
                self.index.setdefault(w, []).append((k, rest))
                rest -= weight(w)

    def ordered(self, words: Iterable[str]) -> list[str]:
        """Words by global rarity."""
        return sorted(words, key=lambda w: (self.frequency.get(f"={w}", 0), w))

    def candidates(self, words: set[str], size: float, repeated: float) -> list[int]:
        """Names that a phrase of this weight may be similar to; ``words`` are those that its words may be.

        ``repeated`` is the most by which a name may count one word several times.
        """
        t = self.threshold
        seen: set[int] = set()
        out = []
        for w in self.ordered(words):
            for k, rest in self.index.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)  # its first word in the order: only this one and later ones can be met
                if (rest + repeated) * (1 + t) >= t * (size + self.weights[k]) - 1e-9:
                    out.append(k)
        return out


class Beginnings:
    """Words by their first letters, exactly or with one slip."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(words)
        self.by_length: dict[int, dict[str, set[str]]] = {}

    def exact(self, start: str) -> list[str]:
        """Words that begin so and go on."""
        i = bisect_left(self.words, start)
        out = []
        while i < len(self.words) and self.words[i].startswith(start):
            if len(self.words[i]) > len(start):
                out.append(self.words[i])
            i += 1
        return out

    def close(self, start: str) -> list[str]:
        """Longer words whose first letters, as many as asked for, are one slip away at most."""
        n = len(start)
        if n not in self.by_length:
            index: dict[str, set[str]] = {}
            for w in self.words:
                if len(w) > n:
                    for v in left_out(w[:n]):
                        index.setdefault(v, set()).add(w)
            self.by_length[n] = index
        near = {w for v in left_out(start) for w in self.by_length[n].get(v, ())}
        return sorted(w for w in near if edit_distance(start, w[:n], 1) <= 1)


def left_out(word: str) -> set[str]:
    """A word, and it without each of its letters; two words one slip apart share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def names_of(forms: list[tuple[str, str]]) -> list[Name]:
    """The written forms as words, compounds also in one word."""
    names = []
    for entry, form in [*forms, *((e, HYPHEN.sub("", f)) for e, f in forms if HYPHEN.search(f))]:
        words = tuple(w.rstrip(".") for w in WORDS.findall(normal(re.sub(r"[_\-/]", " ", form))))
        if words:
            letters = "".join(words)
            names.append(Name(entry, words, letters, letters.isascii()))
    return list(dict.fromkeys(names))


def catalog_tokens(forms: list[tuple[str, str]]) -> set[str]:
    """Every token of the catalog: of its words, of its letters as a whole, and the words themselves."""
    out: set[str] = set()
    for n in names_of(forms):
        out |= word_tokens(n.letters)
        for w in n.words:
            out |= word_tokens(w) | {f"={w}"}
    return out


class Catalog:
    """The written forms of all entries with their indexes."""

    def __init__(self, forms: list[tuple[str, str]], frequency: dict[str, int], affixes: Affixes = frozenset()) -> None:
        self.names, self.affixes = names_of(forms), affixes
        self.longest_affix = max(map(len, affixes), default=0)
        self.words = sorted({w for n in self.names if n.latin for w in n.words})
        self.word_join = SetJoin([word_tokens(w) for w in self.words], frequency, WORD_SIMILARITY)
        self.letter_join = SetJoin([word_tokens(n.letters) for n in self.names], frequency, OTHER_SIMILARITY)
        self.phrase_join = PhraseJoin(self.names, frequency, PHRASE_SIMILARITY)
        self.by_length = [tuple(sorted(n.words, key=len, reverse=True)) for n in self.names]
        self.repeated = max((sum(map(weight, n.words)) - sum(map(weight, set(n.words))) for n in self.names), default=0.0)
        self.known = {w for n in self.names for w in n.words}
        self.beginnings = Beginnings(self.words)
        self.skeletons: dict[str, list[str]] = {}
        for w in self.words:
            self.skeletons.setdefault(skeleton(w), []).append(w)
        self.skeletons_left_out: dict[str, set[str]] = {}
        for s in self.skeletons:
            for v in left_out(s) if len(s) > 3 else ():
                self.skeletons_left_out.setdefault(v, set()).add(s)
        self.longest = max((len(n.words) for n in self.names), default=0)
        self._near: dict[str, dict[str, float]] = {}
        self._letters_of: dict[tuple[str, float], list[tuple[float, str]]] = {}

    def near(self, word: str) -> dict[str, float]:
        """Words of the catalog that a typed word may be, with their weight."""
        hit = self._near.get(word)
        if hit is not None:
            return hit
        bare, short = word.rstrip("."), word.endswith(".")
        out: dict[str, float] = {}
        if bare in self.known:
            out[bare] = 1.0
            if short and len(bare) >= 3:
                out.update({w: 0.85 for w in self.beginnings.exact(bare) if len(w) > len(bare) + 2})
        elif bare and bare.isascii() and bare not in SMALL:
            for similarity, k in self.word_join.similar(word_tokens(bare)):
                w = self.words[k]
                d = edit_distance(bare, w, 2)
                allowed = 1 if min(len(bare), len(w)) < 5 else 2
                if d <= allowed and (len(bare) > 2 or d == 0) and w not in SMALL:
                    out[w] = max(out.get(w, 0), 0.95 - 0.1 * d, similarity)
            if len(bare) >= 3:
                for w in self.skeletons.get(bare, ()):  # vowels left out
                    out[w] = max(out.get(w, 0), 0.85)
                if not set(bare[1:]) & VOWELS:
                    for s in {s for v in left_out(bare) for s in self.skeletons_left_out.get(v, ())}:
                        if edit_distance(bare, s, 1) <= 1:
                            for w in self.skeletons[s]:
                                out[w] = max(out.get(w, 0), 0.7)
                for w in self.beginnings.exact(bare):
                    if short or len(w) - len(bare) <= 3:
                        out[w] = max(out.get(w, 0), 0.85 if short else 0.8)
                if short:
                    for w in self.beginnings.close(bare):
                        out[w] = max(out.get(w, 0), 0.7)
        if len(self._near) < 100_000:
            self._near[word] = out
        return out

    def _score(self, near: list[dict[str, float]], size: float, k: int) -> float:
        """Soft Jaccard of typed words, as what they may be, and the words of a name: each word of the name is met at most once."""
        left = list(range(len(near)))
        total = 0.0
        for target in self.by_length[k]:
            best, at = 0.0, -1
            for i in left:
                s = near[i].get(target, 0.0)
                if s > best:
                    best, at = s, i
            if at >= 0:
                left.remove(at)
                total += best * weight(target)
        return total / max(size + self.phrase_join.weights[k] - total, 1e-9)

    def _whole(self, words: list[str]) -> list[tuple[float, str]]:
        """Entries by the words of a phrase that is a measure and nothing else."""
        near = [self.near(w) for w in words]
        size = sum(0.4 if w in SMALL or (len(w) <= 2 and w.isascii()) else 1.0 for w in words)
        targets = set().union(*near)
        return [(self._score(near, size, k), self.names[k].entry) for k in self.phrase_join.candidates(targets, size, self.repeated)] if targets else []

    def _letters(self, letters: str, least: float) -> list[tuple[float, str]]:
        """Entries by the letters of the whole phrase, spaces aside."""
        hit = self._letters_of.get((letters, least))
        if hit is None:
            hit = [(s, self.names[k].entry) for s, k in self.letter_join.similar(word_tokens(letters), least) if abs(len(self.names[k].letters) - len(letters)) <= 3]
            if len(self._letters_of) < 100_000:
                self._letters_of[letters, least] = hit
        return hit

    @staticmethod
    def _best(found: list[tuple[float, str]], least: float) -> tuple[float, str] | None:
        """The entry with the highest score; equal scores of different entries are no match."""
        by_entry: dict[str, float] = {}
        for s, entry in found:
            if s >= least:
                by_entry[entry] = max(s, by_entry.get(entry, 0.0))
        ranked = sorted(by_entry.items(), key=lambda x: (-x[1], x[0]))
        if not ranked or (len(ranked) > 1 and ranked[1][1] > ranked[0][1] - 1e-6):
            return None
        return ranked[0][1], ranked[0][0]

    def _without_affixes(self, words: list[str]) -> list[list[str]]:
        """The phrase without what stands before and behind the measure."""
        bare = [w.rstrip(".") for w in words]
        low, high = 0, len(bare)

        def longest(at) -> int:
            return next((n for n in range(min(self.longest_affix, high - low - 1), 0, -1) if at(n) in self.affixes), 0)

        while n := longest(lambda n: tuple(bare[low : low + n])):
            low += n
        while n := longest(lambda n: tuple(bare[high - n : high])):
            high -= n
        return [words[low:high]] if high - low < len(words) else []

    def beside(self, typed: str) -> list[list[str]]:
        """One or two words at either end of a value, of which one at least is unlike any word of the catalog."""
        ends: set[tuple[str, ...]] = set()
        for text in {typed, HYPHEN.sub("", typed)}:  # a compound is two words or one
            words = [w.rstrip(".") for w in WORDS.findall(normal(re.sub(PUNCTUATION, " ", text)))]
            ends |= {tuple(e) for n in (1, 2) if len(words) > n for e in (words[:n], words[-n:])}
        return [list(e) for e in sorted(ends) if not all(self.near(w) for w in e)]

    def value(self, typed: str) -> str:
        """The entry that a typed value means, or ``unmatched``."""
        options: list[list[str]] = []
        for text in dict.fromkeys((typed, HYPHEN.sub("", typed))):
            words = WORDS.findall(normal(re.sub(PUNCTUATION, " ", text)))
            if words:
                options += [words, *self._without_affixes(words)]
        best = None
        for option in options:
            latin = "".join(option).isascii()
            found = []
            if latin:
                found = [(s, e) for s, e in self._whole(option) if s >= PHRASE_SIMILARITY]
            letters = "".join(w.rstrip(".") for w in option)
            if len(letters) >= 3 or not latin:
                found += self._letters(letters, LETTER_SIMILARITY if latin else OTHER_SIMILARITY)
            hit = self._best(found, 0.0)
            if hit and (best is None or hit[0] > best[0]):
                best = hit
        return best[1] if best else UNMATCHED

    def inside(self, text: str) -> str | None:
        """The entry that a sentence names in other than its own words, or None."""
        text = normal(text)
        hit = self._inside(text)
        if hit is None and HYPHEN.search(text):
            hit = self._inside(HYPHEN.sub("", text))
        return hit

    def _inside(self, text: str) -> str | None:
        tokens = [(m[0], m.start(), m.end()) for m in WORDS.finditer(text)]
        found: list[tuple[float, str]] = []
        hits = {i for i, (w, _, _) in enumerate(tokens) if self.near(w if not self._ends_sentence(text, tokens, i) else w.rstrip("."))}
        for i in sorted(hits):
            for n in range(1, self.longest + 2):
                j = i + n - 1
                if j >= len(tokens) or (n > 1 and re.search(r"[^\s\-_/()'’.]", text[tokens[j - 1][2] : tokens[j][1]])):
                    break
                if j not in hits:
                    continue
                words = [w for w, _, _ in tokens[i : j + 1]]
                if words[0] in SMALL or words[-1].rstrip(".") in SMALL:
                    continue
                found += [(s + 0.001 * n, e) for s, e in self._whole(words) if s >= 0.62]
        for i, (w, _, end) in enumerate(tokens):
            bare = w.rstrip(".")
            if bare.isascii():
                if len(bare) >= 9 and not self.near(bare):  # spaces left out
                    found += self._letters(bare, LETTER_SIMILARITY + 0.05)
                continue
            for n in range(1, 5):  # other scripts: runs of words, the last one without its ending
                if i + n > len(tokens):
                    break
                run = [t[0].rstrip(".") for t in tokens[i : i + n]]
                if any(r.isascii() for r in run) or (n > 1 and text[tokens[i + n - 2][2] : tokens[i + n - 1][1]].strip(" _-")):
                    break
                for last in {run[-1], KOREAN_ENDINGS.sub("", run[-1])}:
                    letters = "".join(run[:-1]) + last
                    if len(letters) >= 2:
                        found += self._letters(letters, LETTER_SIMILARITY)
        hit = self._best(found, 0.0)
        return hit[1] if hit else None

    @staticmethod
    def _ends_sentence(text: str, tokens: list, i: int) -> bool:
        return tokens[i][0].endswith(".") and (i + 1 == len(tokens))


def written_forms(catalog: DataFrame) -> list[tuple[str, str]]:
    """(entry, form) of the catalog: names, labels, aliases, labels of the other language."""
    rows = collect_bounded(catalog.select("dv", "label", "aliases", "label_ko").where(F.col("dv").isNotNull()).distinct(), MAX_CATALOG, "the catalog")
    forms = {(r["dv"], f) for r in rows for f in [r["dv"], r["label"], r["label_ko"], *(r["aliases"] or [])] if f and f.strip()}
    return sorted(forms)


def token_frequency(*texts: tuple[DataFrame, str], tokens: Iterable[str]) -> dict[str, int]:
    """How often each of ``tokens``, those of a catalog, occurs in the words of all texts; words are counted first."""
    words = None
    for df, column in texts:
        part = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit(r"(\p{L}+)"), 1)).alias("w"))
        words = part if words is None else words.unionByName(part)
    spark = words.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "t string")
    padded, at = F.concat(F.lit("_"), F.col("w"), F.lit("_")), F.sequence(F.lit(1), F.length("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(padded, i, F.lit(2)))

    def numbered(i: F.Column) -> F.Column:  # the character with how often it has occurred so far
        c = F.substring("w", i, F.lit(1))
        return F.concat(c, (i - F.length(F.replace(F.substring("w", F.lit(1), i), c, F.lit("")))).cast("string"))

    every = F.array_distinct(F.concat(pairs, F.transform(at, numbered), F.array(F.concat(F.lit("="), F.col("w")))))
    counted = words.groupBy("w").count().select(F.explode(every).alias("t"), "count")
    rows = collect_bounded(counted.join(F.broadcast(wanted), "t").groupBy("t").agg(F.sum("count").alias("n")), MAX_TOKENS, "the table of tokens")
    return {r["t"]: r["n"] for r in rows}


def learnt_affixes(mapped: DataFrame, forms: list[tuple[str, str]]) -> Affixes:
    """Words at the ends of values that stand beside many measures; ``mapped``: dv and beside, the unknown words at either end.

    A condition or a wave stands beside many measures, a word that makes
    another measure beside few.
    """
    least = max(2, round(AFFIX_SHARE * len({e for e, _ in forms})))
    beside = mapped.where(F.col("dv") != UNMATCHED).select("dv", F.explode("beside").alias("affix")).groupBy("affix").agg(F.count_distinct("dv").alias("n"))
    found = {tuple(r["affix"]) for r in collect_bounded(beside.where(F.col("n") >= least).select("affix"), MAX_AFFIXES, "the words beside measures")}
    return frozenset(a for a in found if len(a) == 1 or not any((w,) in found for w in a))


def trie_pattern(terms: list[str]) -> str:
    """One regular expression for all terms in which common beginnings are tried once."""
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        ends = "" in node
        branches = [re.escape(c) + written(n) for c, n in sorted(node.items()) if c]
        if ends or not branches:
            return ""  # a shorter term is found already
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return written(root).replace("\\ ", " ")


def _verbatim(column: F.Column, forms: list[tuple[str, str]]) -> F.Column:
    """Whether a text contains a written form of the catalog, ignoring case."""
    return F.lower(column).rlike(trie_pattern(sorted({f.lower() for _, f in forms})))


def map_values(values: DataFrame, column: str, catalog: DataFrame, frequency: dict[str, int] | None = None) -> DataFrame:
    """``column`` and ``dv`` for each distinct value that is neither blank nor a catalog entry itself."""
    spark = values.sparkSession
    forms = written_forms(catalog)
    frequency = frequency if frequency is not None else token_frequency((values, column), tokens=catalog_tokens(forms))
    blank = F.col(column).isNull() | (F.trim(F.regexp_replace(column, r"[\s ]", "")) == "")
    typed = values.where(~blank).select(column).distinct()
    entries = spark.createDataFrame([(e,) for e in sorted({e for e, _ in forms})], f"`{column}` string")
    typed = shuffled(typed.join(F.broadcast(entries), [column], "left_anti"))

    def mapping(affixes: Affixes):
        shared, key = spark.sparkContext.broadcast((forms, frequency, affixes)), uuid.uuid4().hex

        @F.pandas_udf("dv string, beside array<array<string>>")
        def meant(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            known = once_per_worker(key, lambda: Catalog(*shared.value))
            for batch in batches:
                yield pd.DataFrame({"dv": [known.value(v) for v in batch], "beside": [known.beside(v) for v in batch]})

        return meant

    first = checkpointed(typed.select(column, mapping(frozenset())(column).alias("_m")).select(column, "_m.*"))
    affixes = learnt_affixes(first, forms)
    again = first.where(F.col("dv") == UNMATCHED).select(column, mapping(affixes)(column).alias("_m")).select(column, "_m.dv")
    return first.where(F.col("dv") != UNMATCHED).select(column, "dv").unionByName(again)


def named_measures(texts: DataFrame, id_column: str, column: str, catalog: DataFrame, frequency: dict[str, int] | None = None, pairs: dict[str, int] | None = None) -> DataFrame:
    """``id_column`` and ``dv`` of texts that name a measure although they contain no written form of the catalog."""
    spark = texts.sparkSession
    forms = written_forms(catalog)
    frequency = frequency if frequency is not None else token_frequency((texts, column), tokens=catalog_tokens(forms))
    pairs = pairs if pairs is not None else character_pairs(texts, column)
    shared, key = spark.sparkContext.broadcast((forms, frequency, pairs)), uuid.uuid4().hex
    rows = spread(texts.select(id_column, column)).where(F.col(column).isNotNull() & ~_verbatim(F.col(column), forms))

    @F.pandas_udf("string")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forms_, frequency_, pairs_ = shared.value
        known, plainer = once_per_worker(key, lambda: (Catalog(forms_, frequency_), Plainer(pairs_)))
        for batch in batches:
            yield pd.Series([known.inside(plainer.plain(t)) for t in batch], dtype=object)

    return rows.withColumn("dv", named(column)).where(F.col("dv").isNotNull()).select(id_column, "dv")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed measures of verification_results and measures named otherwise in numerical_claims."""
    catalog = spark.read.parquet(f"{sf_dir}/dv_catalog.parquet")
    results = spark.read.parquet(f"{sf_dir}/verification_results.parquet").select(F.col("id").alias("record_id"), "matched_dv")
    claims = spark.read.parquet(f"{sf_dir}/numerical_claims.parquet").select(F.col("id").alias("record_id"), "context_snippet")
    frequency = token_frequency((results, "matched_dv"), (claims, "context_snippet"), tokens=catalog_tokens(written_forms(catalog)))
    mapped = map_values(results, "matched_dv", catalog, frequency)
    typed = results.join(mapped, ["matched_dv"]).select(F.lit("verification_results").alias("record_table"), "record_id", "dv")
    named = named_measures(claims, "record_id", "context_snippet", catalog, frequency).select(F.lit("numerical_claims").alias("record_table"), "record_id", "dv")
    return typed.unionByName(named).distinct()


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values without a catalog entry and how many results carry them."""
    results = spark.read.parquet(f"{sf_dir}/verification_results.parquet").select("id", "matched_dv").distinct()
    mapped = map_values(results, "matched_dv", spark.read.parquet(f"{sf_dir}/dv_catalog.parquet"))
    counted = results.groupBy("matched_dv").agg(F.count("*").alias("n_results"))
    return counted.join(mapped.where(F.col("dv") == UNMATCHED), ["matched_dv"]).select("matched_dv", "n_results")
