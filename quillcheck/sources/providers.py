"""External scorers and classifiers: a program that reads a question and answers with JSON.

A provider is called by the executors, once per distinct pair, with a limit of
time.  Whatever goes wrong with a call gives no answer, so that what depends on
it fails closed; a name that is not known is an error at once.
"""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass

from quillcheck.operators.paraphrase import PURPOSES, Classifier, Scorer, lexical_score, valid_score

# Programs known by name, and names that mean none.
PRESETS = {"codex": ("codex", "exec", "--sandbox", "read-only", "--skip-git-repo-check", "-"), "claude": ("claude", "-p")}
OFF = ("none", "off", "")
#: The scorer that needs no program.
BUILT_IN = "lexical"
PURPOSE = re.compile(r'"purpose"\s*:\s*"([a-z-]+)"')
ANSWER = 2000


@dataclass(frozen=True)
class Provider:
    """A program that takes its question on standard input."""

    name: str
    argv: tuple[str, ...]
    timeout: int = 120

    def ask(self, question: str) -> tuple[str, int] | None:
        """What it prints and its return code; None if it cannot be run or takes too long."""
        try:
            done = subprocess.run(list(self.argv), input=question, text=True, capture_output=True, timeout=self.timeout, check=False)
        except (OSError, subprocess.SubprocessError, ValueError):
            return None
        return done.stdout, done.returncode


def resolve(name: str | None, argv: tuple[str, ...] = (), timeout: int = 120) -> Provider | None:
    """The provider of a configuration: its own program, else one known by name, else none; an unknown name is an error."""
    off = (name or "").strip().lower() in OFF
    if argv:
        return Provider("custom" if off else name, tuple(argv), timeout)
    if off or name == BUILT_IN:
        return None
    if name not in PRESETS:
        raise ValueError(f"unknown provider {name!r}: one of {', '.join(sorted(PRESETS))}, {BUILT_IN}, none, or a program of your own")
    return Provider(name, PRESETS[name], timeout)


def scorer_of(provider: Provider | None, name: str | None = None) -> Scorer | None:
    """Scores by a provider, by the built-in scorer if it is named, else none."""
    if provider is None:
        return lexical_score if name == BUILT_IN else None

    def score(paraphrase: str, quote: str) -> float | None:
        answer = provider.ask(
            'How well does the quote support the statement? Answer with one JSON object only: {"score": a number from 0 to 1, "reason": "a few words"}\n\n' + f"Statement: {paraphrase}\nQuote: {quote}\n"
        )
        return valid_score(*answer) if answer else None

    return score


def classifier_of(provider: Provider | None) -> Classifier | None:
    """Purposes by a provider; no or an unknown answer leaves the heuristic one."""
    if provider is None:
        return None

    def classify(paraphrase: str, raw: str) -> str | None:
        answer = provider.ask(
            f'Why does this sentence cite the work? Answer with one JSON object only: {{"purpose": one of {", ".join(PURPOSES)}}}. A finding is a result of the work, a method an instrument or procedure, a theory a named frame, '
            f"background everything else.\n\nSentence: {paraphrase}\nCitation: {raw}\n"
        )
        found = PURPOSE.search(answer[0][:ANSWER]) if answer else None
        return found[1] if found and found[1] in PURPOSES else None

    return classify
