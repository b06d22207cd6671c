"""Reading and comparing the names of authors, persons and organisations, as people type them.

A typed name is read into a surname key (folded letters only), the given names
or initials, and for organisations the significant words.  Two readings denote
the same author if the keys lie within a small edit distance and the given
names can belong together.  Null, blank and letterless names have no reading
and equal nothing.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# Short and foreign forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sandy xander", "alexandra": "alex sasha sandra", "andreas": "andi", "andrew": "andy drew", "anthony": "tony",
    "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy kate katie", "charles": "charlie chuck", "christina": "tina chris",
    "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "dorothea": "thea dora dorle dorothy dot",
    "edward": "ed eddie ted ned", "elizabeth": "liz beth betty lisa eliza", "ekaterina": "katya", "francisco": "paco fran pancho", "frederick": "fred freddie",
    "frederike": "freddie rike", "friederike": "rike freddie", "gabriela": "gabi", "gabriele": "gabi", "gregory": "greg", "ibrahim": "ibo", "isabella": "isa bella",
    "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes jan hans", "john": "jack johnny", "jonathan": "jon", "jose": "pepe",
    "joseph": "joe joey", "josephine": "josie jo", "joshua": "josh", "katherine": "kathy kate kat katie", "lawrence": "larry", "leonardo": "leo leon",
    "margaret": "maggie peggy meg", "mariya": "masha", "matthew": "matt", "matthias": "matti matze", "michael": "mike mick micky", "natalia": "natasha", "nicholas": "nick",
    "nikolai": "nik kolya", "oluwaseun": "seun", "patricia": "pat tricia patty trish", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky",
    "richard": "rick dick rich", "robert": "rob bob bobby", "samuel": "sam", "samantha": "sam", "stephen": "steve", "susanna": "sue sanna susi", "susan": "sue susie",
    "theodora": "thea dora", "theodore": "ted theo", "thomas": "tom tommy", "timothy": "tim", "ulrike": "rike uli", "valentina": "tina valya", "vladimir": "vova volodya",
    "william": "bill will billy", "yevgeny": "zhenya",
}
# Given names without short forms in the table above.
OTHER_GIVEN = "hyunwoo seoyeon maria anna juan pablo pedro luis carlos marie pierre paul mark laura julia emma noah"
PARTICLES = set("de del della der den di da do dos du la las le les los van von vom zu zum zur ter ten te al el bin ibn mac mc st san af av vander vanden vonder dela delos".split())
# Words that mark an organisation, with their usual short forms.
ORGANISATION = {
    "agency": "ag agy", "association": "assoc assn", "board": "bd", "bureau": "bur", "center": "ctr cent centre cen", "college": "coll", "committee": "comm cttee",
    "council": "counc cncl", "department": "dept dep", "foundation": "found fdn", "group": "grp", "institute": "inst", "laboratory": "lab labs", "ministry": "min",
    "office": "off", "organization": "org organisation", "school": "sch", "society": "soc", "university": "univ uni",
}
SHORT_FORM = {s: word for word, forms in ORGANISATION.items() for s in [word, *forms.split()]}
SMALL_WORDS = set("for of the and in on fur pour de del la y et und".split())
COMMONEST = ("for", "the", "and")
TITLES = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|hon|rev|pd)\b\.?\s+)+", re.IGNORECASE)
JOINED_PARTICLE = re.compile(r"\b(Vander|Vanden|Vonder|Dela|Delos|V[ao]n|De|Del|Di|Le|La|Mac|Mc|Dos|Ter|Al|El)(?=[A-ZÀ-Þ][a-zß-ÿ])")
SPECIAL = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th", "ð": "d"})
DIGITS = str.maketrans("01345", "olles")
CANONICAL: dict[str, frozenset[str]] = {}
for _name, _forms in NICKNAMES.items():
    for _f in [_name, *_forms.split()]:
        CANONICAL[_f] = CANONICAL.get(_f, frozenset()) | {_name}
for _f in OTHER_GIVEN.split():
    CANONICAL[_f] = frozenset({_f})

ANY_DIGIT = re.compile(r"\d")
LOOK_ALIKE_DIGIT = re.compile(r"(?<=[^\W\d_])\d|\d(?=[^\W\d_])")
INITIALS = re.compile(r"(?:[^\W\d_]\.[\s-]*)+(?:[^\W\d_]\.?)?|[^\W\d_]")
TRAILING_CAPITALS = re.compile(r"[A-Z]{1,3}")
ACRONYM = re.compile(r"[A-Z]{3,6}")
DASHES = re.compile(r"[‐‑‒–—−]")


@dataclass(frozen=True)
class Author:
    """One reading of a typed name."""

    key: str
    given: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    @property
    def is_organisation(self) -> bool:
        return bool(self.words)

    @property
    def acronym(self) -> str:
        return "".join(w[0] for w in self.words)


def fold(text: str) -> str:
    """Lower-case letters without accents; look-alike digits between letters become letters."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKD", text.translate(SPECIAL))
        text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").casefold()
    return LOOK_ALIKE_DIGIT.sub(lambda m: m[0].translate(DIGITS), text) if ANY_DIGIT.search(text) else text


def squash(text: str) -> str:
    """Folded letters alone."""
    text = fold(text)
    return text if text.isalpha() else "".join(c for c in text if c.isalpha())


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits between two strings, a swap of neighbours counting one, in a band of width ``most``; ``most + 1`` if beyond."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    far = most + 1
    before: list[int] = []
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(low, high + 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, far)
        if min(new[low - 1 : high + 1]) > most:
            return far
        before, row = row, new
    return row[len(b)]


def slips(key: str) -> int:
    """Edits that a key of this length may differ by."""
    return 0 if len(key) < 3 else 1 if len(key) < 6 else 2


def _given(text: str) -> tuple[str, ...]:
    """Given names or initials of the part behind or before a surname."""
    out: list[str] = []
    for part in re.split(r"[\s.]+", text.replace("‐", "-").replace("–", "-")):
        part = part.strip("-,;'’ ")
        if not part:
            continue
        pieces = part.split("-")
        if all(len(p) <= 1 for p in pieces):
            out += [fold(p) for p in pieces if p]
        elif part.isupper() and len(part) <= 3:
            out += [fold(c) for c in part if c.isalpha()]
        elif name := squash(part):
            out.append(name)
    return tuple(out)


@lru_cache(maxsize=100_000)
def _marks(word: str) -> bool:
    """Whether a word marks an organisation, in full with one slip or as a short form."""
    return word in SHORT_FORM or any(edit_distance(word, full, 1) <= 1 for full in ORGANISATION if len(full) > 4)


def _organisation(text: str) -> tuple[str, ...]:
    """The significant words of an organisation with written-out markers, or nothing for a person."""
    head, comma, tail = text.partition(",")
    if comma and tail.strip() and " " not in tail.strip() and len(head.split()) > 1:
        text = f"{tail} {head}"  # the distinctive word put behind
    words = [w for w in re.split(r"[\s,.&/-]+", fold(text)) if w]
    words = words[1:] if words[:1] == ["the"] else words
    if len(words) < 3 or not any(map(_marks, words[1:])):
        return ()
    # small words do not count, nor the commonest with one slip or a letter typed twice
    slip = lambda w: any(edit_distance(w, x, 1) <= 1 for x in COMMONEST) if len(w) == 3 else re.sub(r"(.)\1", r"\1", w) in COMMONEST
    significant = [w for i, w in enumerate(words) if i == 0 or w in SHORT_FORM or len(w) > 4 or (w not in SMALL_WORDS and len(w) >= 3 and not slip(w))]
    if len(significant) < 3 or not any(map(_marks, significant[1:])):
        return ()
    return tuple(SHORT_FORM.get(w, w) for w in significant)


def given_part(authors: str | None, last: str | None) -> str:
    """What ``authors`` gives as the first author's given names or initials behind the surname."""
    if not authors:
        return ""
    text = authors.strip()
    if last and text.startswith(last):
        rest = text[len(last) :]
    else:
        head, comma, tail = text.partition(",")
        rest = comma + tail
    if not rest.lstrip().startswith(","):
        return ""
    parts = [p.strip() for p in rest.lstrip()[1:].split(",")]
    first = re.split(r"\s+(?:&|and|und|et|y)\s+|^(?:&|and)\s", parts[0])[0].strip()
    if not first or first.startswith("&"):
        return ""
    if INITIALS.fullmatch(first):
        return first
    if squash(first.split(" ")[0]) in CANONICAL:
        return first
    if len(parts) > 1 and INITIALS.fullmatch(parts[1]):
        return ""
    return first if len(first.split()) <= 2 and first[0].isupper() and len(parts) > 1 else ""


def first_author(authors: str | None, last: str | None) -> str | None:
    """The first author's name as the reference entry writes it."""
    if not (last and last.strip()):
        if not (authors and authors.strip()):
            return None
        last = authors.split(",")[0].strip()
    given = given_part(authors, last)
    return f"{last}, {given}" if given else last


def _surname(tokens: list[str], given: tuple[str, ...] = ()) -> Author:
    """A reading of surname tokens: particles do not count, parts joined by a hyphen are kept."""
    kept = [t for i, t in enumerate(tokens) if fold(t) not in PARTICLES or len(tokens) == 1]
    kept = kept or tokens
    parts = tuple(p for t in kept for p in (squash(x) for x in t.split("-")) if p)
    return Author("".join(parts), given, (), parts if len(parts) > 1 else ())


@lru_cache(maxsize=150_000)
def read_name(name: str | None) -> tuple[Author, ...]:
    """The readings of a typed name, likeliest first."""
    if not name or not name.strip():
        return ()
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name)).strip(" .,;")
    text = DASHES.sub("-", TITLES.sub("", text))
    text = re.sub(r"(?<=\w)['’´`]s\b", "", text)
    organisation = _organisation(text)
    if organisation:
        return (Author("".join(organisation), (), organisation),)
    text = JOINED_PARTICLE.sub(r"\1 ", text)
    if "," in text:
        surname, _, given = text.partition(",")
        behind = given.strip()
        if behind and all(fold(t) in PARTICLES for t in behind.split()):
            return read_name(surname)
        return tuple(Author(a.key, a.given or _given(given), a.words, a.parts) for a in read_name(surname)[:1])
    if not squash(text):
        return ()
    tokens = [t for t in text.split(" ") if squash(t)]
    given: tuple[str, ...] = ()
    if len(tokens) > 1:
        if (TRAILING_CAPITALS.fullmatch(tokens[-1]) and not text.isupper()) or (INITIALS.fullmatch(tokens[-1]) and tokens[-1].endswith(".")):
            given, tokens = _given(tokens[-1]), tokens[:-1]
        while len(tokens) > 1 and INITIALS.fullmatch(tokens[0]) and (len(tokens[0]) > 1 or tokens[0].isupper()):
            given, tokens = (*given, *_given(tokens[0])), tokens[1:]
    readings: list[Author] = []
    if given or len(tokens) == 1:
        readings.append(_surname(tokens, given))
    else:
        head, tail = tokens[0], tokens[-1]
        head_given = squash(head) in CANONICAL and fold(head) not in PARTICLES
        tail_given = squash(tail) in CANONICAL
        if head_given:
            readings.append(_surname(tokens[1:], _given(head)))
        if tail_given:
            readings.append(_surname(tokens[:-1], _given(tail)))
        readings.append(_surname(tokens))
        if not head_given and not tail_given and fold(head) not in PARTICLES and head[:1].isupper():
            readings.append(_surname(tokens[1:], _given(head)))
            if len(tokens) == 2 and tail[:1].isupper():
                readings.append(_surname(tokens[:1], _given(tail)))
    return tuple(r for r in dict.fromkeys(readings) if r.key)


def _given_fits(a: str, b: str) -> bool:
    if a == b or (len(a) == 1 and b.startswith(a)) or (len(b) == 1 and a.startswith(b)):
        return True
    forms_a, forms_b = CANONICAL.get(a, frozenset({a})), CANONICAL.get(b, frozenset({b}))
    if len(a) == 1 or len(b) == 1:
        return any(f.startswith(a if len(a) == 1 else b) for f in (forms_b if len(a) == 1 else forms_a))
    return bool(forms_a & forms_b) or edit_distance(a, b, 1) <= 1 or (min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)))


def given_fit(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two lists of given names or initials can belong to one person; an absent list fits any."""
    return all(_given_fits(x, y) for x, y in zip(a, b, strict=False))


def _word_fits(a: str, b: str) -> bool:
    if a == b or edit_distance(a, b, 1) <= 1 and min(len(a), len(b)) > 3:
        return True
    short, long = sorted((a, b), key=len)
    return (len(short) >= 2 and long.startswith(short)) or (min(len(a), len(b)) >= 9 and edit_distance(a, b, 2) <= 2)


def _organisations_fit(a: Author, b: Author) -> int | None:
    if a.key == b.key:
        return 0
    if len(a.words) == len(b.words) and _word_fits(a.words[0], b.words[0]) and all(_word_fits(x, y) for x, y in zip(a.words, b.words, strict=True)):
        return 1
    return 1 if edit_distance(a.key, b.key, 2) <= 2 else None


def _keys_apart(x: Author, y: Author) -> int | None:
    """Edits between two surnames; one half of a double surname, or its first half as an initial, counts as one."""
    most = slips(min(x.key, y.key, key=len))
    best = edit_distance(x.key, y.key, most)
    if best <= most:
        return best
    double, single = (x, y) if x.parts else (y, x)
    if not double.parts:
        return None
    options = []
    if not single.parts:
        options = [(double.parts[0], single.key)]
        if len(double.parts[0]) == 1 and single.key[:1] == double.parts[0]:  # the other is a double surname in one word
            tail = "".join(double.parts[1:])
            options += [(tail, single.key[-n:]) for n in range(len(tail) - 1, len(tail) + 2) if 4 <= n <= len(single.key) - 3]
    elif len(single.parts) == len(double.parts):
        short = next((p for p in (x, y) if len(p.parts[0]) == 1), None)
        if short is not None and x.parts[0][0] == y.parts[0][0]:
            options = [("".join(x.parts[1:]), "".join(y.parts[1:]))]
    for a, b in options:
        most = min(1, slips(min(a, b, key=len)))
        d = edit_distance(a, b, most)
        if d <= most and min(len(a), len(b)) >= 4:
            return 1 + d
    return None


def compare(a: str | None, b: str | None) -> int | None:
    """How far two typed names are apart if they can denote the same author (0 is equal but for form), else None."""
    best: int | None = None
    left, right = read_name(a), read_name(b)
    if a == b:
        return 0 if left else None
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            found: int | None = None
            if x.is_organisation and y.is_organisation:
                found = _organisations_fit(x, y)
            elif x.is_organisation or y.is_organisation:
                organisation, other = (x, y) if x.is_organisation else (y, x)
                raw = (b if x.is_organisation else a) or ""
                if ACRONYM.fullmatch(raw.strip().replace(".", "")) and other.key == organisation.acronym:
                    found = 1
            elif given_fit(x.given, y.given):
                found = _keys_apart(x, y)
            if found is None or (i > 0 and j > 0 and not (x.given and y.given and len(x.key) > 5)):
                continue  # a secondary reading of both sides at once proves nothing
            best = found if best is None else min(best, found)
    return best


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """``n`` letters cut into k + 1 segments of nearly equal length: (start, size)."""
    parts, out, at = k + 1, [], 0
    for i in range(parts):
        size = n // parts + (1 if i >= parts - n % parts else 0)
        out.append((at, size))
        at += size
    return out


def index_keys(key: str, k: int) -> set[str]:
    """Entries of an inverted index: the segments of a key, with its length and their number.

    A swap of neighbours across a cut would damage two segments by one edit, so
    the segments of the key with such letters swapped are entries as well.
    """
    parts = segments(len(key), k)
    swapped = {key}
    for at, _ in parts[1:]:
        if at and key[at - 1] != key[at]:
            swapped |= {v[: at - 1] + v[at] + v[at - 1] + v[at + 1 :] for v in swapped}
    return {f"{k}|{len(key)}|{i}|{v[at : at + size]}" for v in swapped for i, (at, size) in enumerate(parts)}


def probe_keys(key: str, k: int, shortest: int, longest: int) -> set[str]:
    """Entries under which every key of ``shortest`` to ``longest`` letters is found that lies within ``k`` edits.

    At most ``k`` of the k + 1 segments can be damaged (pigeonhole).  A whole
    segment with i segments before it need only be looked up where it has moved
    by at most i places, seen from the left, and by at most k - i, seen from
    the right: were it moved further, its side would hold so many edits that
    another segment on the other side is whole.
    """
    out, m = set(), len(key)
    for n in range(max(shortest, m - k), min(longest, m + k) + 1):
        for i, (at, size) in enumerate(segments(n, k)):
            low = max(0, at - i, at + m - n - (k - i))
            high = min(m - size, at + i, at + m - n + (k - i))
            out.update(f"{k}|{n}|{i}|{key[start : start + size]}" for start in range(low, high + 1))
    return out


#: Lengths of keys by the slips that ``slips`` allows: pairs whose shorter key has fewer than six letters have one.
SHORT, LONG, ENDLESS = 3, 6, 1 << 30


def key_entries(key: str) -> set[str]:
    """Index entries of a key, for the slips that keys of about its length may have."""
    if len(key) < SHORT:
        return {f"0|{key}"}
    return (index_keys(key, 1) if len(key) <= LONG else set()) | (index_keys(key, 2) if len(key) >= LONG else set())


def key_lookups(key: str) -> set[str]:
    """Lookups that meet an index entry of every key that ``slips`` allows to be the same."""
    if len(key) < SHORT:
        return {f"0|{key}"}
    return (probe_keys(key, 1, SHORT, LONG) if len(key) <= LONG else set()) | (probe_keys(key, 2, LONG, ENDLESS) if len(key) >= LONG else set())


def _lookup_keys(a: Author) -> list[str]:
    """The strings of a reading that must come near: the key, and for double surnames the halves."""
    if a.is_organisation or not a.parts:
        return [a.key]
    return [a.key, a.parts[0], "".join(a.parts[1:])]


def _acronyms(a: Author) -> set[str]:
    """The first letters of an organisation's words, also without one of them, which may be mistyped; a short key may be such letters."""
    if not a.is_organisation:
        return {f"acronym|{a.key}"} if len(a.key) <= 6 else set()
    letters = a.acronym
    return {f"acronym|{letters}", *(f"acronym|{letters[:i]}?{letters[i + 1 :]}" for i in range(len(letters)))}


def _tails(a: Author, index: bool) -> set[str]:
    """Entries that lead from a double surname whose first half is an initial to those in one word, and back, not among the latter."""
    if a.is_organisation:
        return set()
    if a.parts and len(a.parts[0]) == 1:
        side, key = index, "".join(a.parts[1:])
    elif not a.parts and len(a.key) >= 8:
        side, key = not index, a.key
    else:
        return set()
    # one slip leaves either the last two letters or the two before whole, a slip between them moves the latter
    ends = {f"l{key[-2:]}", f"b{key[-4:-2]}"} if index else {f"l{key[-2:]}", f"b{key[-4:-2]}", f"b{key[-5:-3]}", f"b{key[-3:-1]}"}
    return {f"tail|{int(side)}|{(a.parts[0] if a.parts else a.key)[:1]}|{e}" for e in ends}


@lru_cache(maxsize=20_000)
def name_index(name: str | None) -> list[str]:
    """Index entries of a typed name over all its readings, acronyms included."""
    return sorted({e for a in read_name(name) for key in _lookup_keys(a) for e in key_entries(key)} | {e for a in read_name(name) for e in _acronyms(a) | _tails(a, True)})


@lru_cache(maxsize=10_000)
def name_probe(name: str | None) -> list[str]:
    """Lookups of a typed name; it shares at least one with the index entries of every name that may equal it."""
    return sorted({e for a in read_name(name) for key in _lookup_keys(a) for e in key_lookups(key)} | {e for a in read_name(name) for e in _acronyms(a) | _tails(a, False)})
