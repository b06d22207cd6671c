"""Error-recovering recursive-descent grammars for delivered records.

``read_export`` reads the lines of a statistics export: fields, optionally
wholly quoted, separated by commas.  A broken quote does not swallow what
follows: the parser notes the error with its position and resumes at the next
record start, a line break behind which a record's first fields can be read.
``read_reference`` reads one reference entry: authors, year, title, source,
link.  Both return typed records and located syntax errors.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

COLUMNS = ("dv", "f", "df1", "df2", "p_r", "p_scipy", "beta", "se", "ci_low", "ci_high", "n", "parity", "remark")
QUOTING, COLUMN_COUNT, VALUE = "quoting", "column_count", "value"
#: The order in which reasons hold.
REASONS = (QUOTING, COLUMN_COUNT, VALUE)
NUMBER = re.compile(r"[+−-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+−-]?[0-9]+)?")
MISSING = {"", "—", "N/A"}
RECORD_START = re.compile(r'(?:"(?:[^"\n]|"")*"|[^",\n]*),\s*"?\s*[+−-]?(?:[0-9]|\.[0-9])')
FIRST_YEAR, LAST_YEAR = 1800, 2026


@dataclass
class SyntaxProblem:
    """A located error: reason, code-point position, and what was expected."""

    reason: str
    position: int
    message: str


@dataclass
class Record:
    """One record: its text span, typed values (None where invalid or missing) and errors."""

    start: int
    end: int
    values: dict[str, object] = field(default_factory=dict)
    problems: list[SyntaxProblem] = field(default_factory=list)

    @property
    def reason(self) -> str | None:
        """The first reason that holds, or None for a valid record."""
        found = {p.reason for p in self.problems}
        return next((r for r in REASONS if r in found), None)


def number(text: str) -> float | None:
    """A finite number as exports write it, else None."""
    text = text.strip()
    if not NUMBER.fullmatch(text):
        return None
    value = float(text.replace("−", "-"))
    return value if math.isfinite(value) else None


class ExportParser:
    """Recursive descent over a text of one or more export lines."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.end = text, 0, len(text)

    def records(self) -> list[Record]:
        """record*"""
        out = []
        while True:
            out.append(self.record())
            if self.at >= self.end:
                return out
            self.at += 1
            if self.at >= self.end:
                return out

    def record(self) -> Record:
        """field (',' field)* up to a line break"""
        record = Record(self.at, self.at)
        fields: list[tuple[int, str]] = []
        while True:
            start = self.at
            value = self.field(record)
            if value is None:
                self.resume()
                break
            fields.append((start, value))
            if self.at < self.end and self.text[self.at] == ",":
                self.at += 1
                continue
            break
        record.end = self.at
        if not record.problems:
            self.columns(record, fields)
        return record

    def field(self, record: Record) -> str | None:
        """quoted | plain; None after broken quoting"""
        at = self.at
        while at < self.end and self.text[at] in " \t":
            at += 1
        if at < self.end and self.text[at] == '"':
            return self.quoted(record, at)
        return self.plain(record)

    def quoted(self, record: Record, opening: int) -> str | None:
        """'"' (character | '""')* '"' and then a comma or the end"""
        parts, at = [], opening + 1
        while True:
            closing = self.text.find('"', at)
            if closing < 0 or (line := self.text.find("\n", at, closing)) >= 0 and self.starts_record(line + 1):
                record.problems.append(SyntaxProblem(QUOTING, opening, "a quotation mark without partner"))
                return None
            parts.append(self.text[at:closing])
            if closing + 1 < self.end and self.text[closing + 1] == '"':
                parts.append('"')
                at = closing + 2
                continue
            after = closing + 1
            while after < self.end and self.text[after] in " \t\r":
                after += 1
            if after < self.end and self.text[after] not in ",\n":
                record.problems.append(SyntaxProblem(QUOTING, closing, "text behind a closing quotation mark"))
                return None
            self.at = after
            return "".join(parts)

    def plain(self, record: Record) -> str | None:
        """characters other than comma, quotation mark and line break"""
        start = self.at
        while self.at < self.end and self.text[self.at] not in ',"\n':
            self.at += 1
        if self.at < self.end and self.text[self.at] == '"':
            record.problems.append(SyntaxProblem(QUOTING, self.at, "a quotation mark inside a field"))
            return None
        return self.text[start : self.at]

    def starts_record(self, at: int) -> bool:
        return RECORD_START.match(self.text, at) is not None

    def resume(self) -> None:
        """Skip to the next line break behind which a record starts, or to the end."""
        at = self.at
        while (at := self.text.find("\n", at)) >= 0:
            if self.starts_record(at + 1):
                self.at = at
                return
            at += 1
        self.at = self.end

    def columns(self, record: Record, fields: list[tuple[int, str]]) -> None:
        """The thirteen typed columns."""
        if len(fields) != len(COLUMNS):
            record.problems.append(SyntaxProblem(COLUMN_COUNT, record.start, f"{len(fields)} columns instead of {len(COLUMNS)}"))
            return
        values = record.values

        def wrong(k: int, expected: str) -> None:
            record.problems.append(SyntaxProblem(VALUE, fields[k][0], f"{COLUMNS[k]}: {expected}"))

        for k, name in enumerate(COLUMNS):
            raw = fields[k][1].strip()
            if name in ("dv", "remark"):
                values[name] = raw
            elif name == "parity":
                values[name] = raw if raw in ("✓", "✗") else None
                if values[name] is None:
                    wrong(k, "✓ or ✗")
            elif raw in MISSING and name in ("beta", "se", "ci_low", "ci_high"):
                values[name] = None
            else:
                value = values[name] = number(raw)
                if value is None:
                    wrong(k, "a finite number")
                elif name == "f" and value < 0:
                    wrong(k, "a number of at least 0")
                elif name in ("df1", "df2", "n"):
                    if value < 1 or value != int(value):
                        wrong(k, "a whole number of at least 1")
                    else:
                        values[name] = int(value)
                elif name in ("p_r", "p_scipy") and not 0 <= value <= 1:
                    wrong(k, "a number from 0 to 1")
                elif name == "se" and value <= 0:
                    wrong(k, "a number above 0")
        low, high = values.get("ci_low"), values.get("ci_high")
        if low is not None and high is not None and low > high:
            wrong(8, "not above ci_high")


def read_export(text: str | None) -> list[Record]:
    """The records of an export text; null has none, an empty line is a record of one empty column."""
    return [] if text is None else ExportParser(text.rstrip("\r\n") if text.strip() else "").records()


BRACKETS = {"(": ")", "[": "]"}
YEAR_GROUP = re.compile(r"\(([^()]*)\)")
LINK = re.compile(r"(?:https?://|www\.|doi:)\S+", re.IGNORECASE)
DOI_END = re.compile(r"(?<![0-9.])10\.[0-9]{4,9}/\S+$")
YEAR = re.compile(r"([0-9]{4})[A-Za-z]?")


class ReferenceParser:
    """Recursive descent over one reference entry."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.record = Record(0, len(text))

    def problem(self, reason: str, at: int, message: str) -> None:
        self.record.problems.append(SyntaxProblem(reason, at, message))

    def entry(self) -> Record:
        """authors '(' year ')' '.' title rest [link]"""
        self.partners()
        at = self.authors()
        at = self.year(at)
        self.title(at)
        return self.record

    def partners(self) -> None:
        """Every parenthesis, asterisk and double quotation mark has its partner."""
        open_: list[int] = []
        straight = stars = 0
        curly: list[str] = []
        for i, c in enumerate(self.text):
            if c == "(":
                open_.append(i)
            elif c == ")":
                if not open_:
                    self.problem(QUOTING, i, "a closing parenthesis without partner")
                else:
                    open_.pop()
            elif c == "*":
                stars += 1
            elif c == '"':
                straight += 1
            elif c in "“„«":
                if c == "“" and curly and curly[-1] == "„":
                    curly.pop()
                else:
                    curly.append(c)
            elif c in "”»":
                if not curly:
                    self.problem(QUOTING, i, "a closing quotation mark without partner")
                else:
                    curly.pop()
        if open_:
            self.problem(QUOTING, open_[-1], "a parenthesis without partner")
        if stars % 2:
            self.problem(QUOTING, self.text.rfind("*"), "an asterisk without partner")
        if straight % 2 or curly:
            self.problem(QUOTING, 0, "a quotation mark without partner")

    def year_group(self) -> re.Match[str] | None:
        """The parenthesis that stands for the year: one that holds a year, else the first behind the authors."""
        groups = list(YEAR_GROUP.finditer(self.text))
        head = re.split(r"\)\s*\.\s", self.text, maxsplit=1)[0]
        for m in groups:
            if m.start() <= len(head) and re.match(r"\s*\.", self.text[m.end() :]):
                return m
        return None

    def authors(self) -> int:
        m = self.year_group()
        self.group = m
        head = self.text[: m.start()] if m else ""
        if m and not re.search(r"[^\W\d_]", head):
            self.problem(COLUMN_COUNT, 0, "authors are absent")
        self.record.values["authors"] = head.strip() or None
        return m.start() if m else 0

    def year(self, at: int) -> int:
        if self.group is None:
            self.problem(COLUMN_COUNT, at, "the year is absent")
            return at
        raw = self.group[1].strip()
        m = YEAR.fullmatch(raw)
        if not raw:
            self.problem(COLUMN_COUNT, at, "the year is absent")
        elif not m or not FIRST_YEAR <= int(m[1]) <= LAST_YEAR:
            self.problem(VALUE, at, "a year that is none")
        else:
            self.record.values["year"] = int(m[1])
            self.record.values["suffix"] = raw[4:]
        return self.group.end()

    def title(self, at: int) -> None:
        """title and source, then the link"""
        rest = re.sub(r"^\s*\.?\s*", "", self.text[at:])
        link = LINK.search(rest)
        body = (rest[: link.start()] if link else rest).strip()
        if self.group is not None and not re.search(r"[^\W\d_]", re.sub(r"\*[^*]*\*", "", body).split("*")[0]):
            self.problem(COLUMN_COUNT, at, "the title is absent")
        self.record.values["title"] = body.split(". ")[0].strip("“”\" ") or None
        if link:
            self.record.values["link"] = link[0]
            tail = rest[link.start() :].strip()
            if not DOI_END.search(tail):
                self.problem(VALUE, at, "a link that does not end in a DOI")


def read_reference(text: str | None) -> Record:
    """One reference entry; null and blank ones lack their parts."""
    return ReferenceParser(text or "").entry()
