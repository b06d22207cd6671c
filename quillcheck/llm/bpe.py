"""Exact byte-level BPE encoding of a whole corpus by a backtracking encoder.

An Aho-Corasick automaton over the vocabulary gives, for every position of a
piece, the longest token that starts there.  The encoder walks forward with
these longest matches; a token is kept only if it is compatible with its left
neighbour, i.e. if merging the two in rank order really leaves this boundary.
The compatibility of a pair depends on the two tokens alone and is memoised in
a pair table.  Where no shorter match fits, the encoder steps back and marks
the position as a dead end, so each position is tried at most once and the work
is linear in the length of the text.  The result equals the merges of BPE.

Null and empty texts have the empty list of ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.session import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Distinct pieces whose ids each Python worker remembers; only speed depends on it.
REMEMBERED_PIECES = 200_000
PAIR_TABLE_SIZE = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its construction rule."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes, the rank-ordered merges and the offset table used for decoding."""

    def __init__(self, source: str) -> None:
        model = json.loads(source)["model"]
        letters = byte_alphabet()
        by_text = {text: i for text, i in model["vocab"].items() if all(c in letters for c in text)}
        self.size = max(model["vocab"].values()) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for text, i in by_text.items():
            self.token_bytes[i] = bytes(letters[c] for c in text)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = by_text[left], by_text[right]
            made = by_text[left + right]
            if made not in self.rank:
                self.merges[pair] = (r, made)
                self.parts[made] = pair
                self.rank[made] = r
        self.offsets = [0]
        for raw in self.token_bytes:
            self.offsets.append(self.offsets[-1] + len(raw))
        self.blob = b"".join(self.token_bytes)

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, read through the offset table."""
        blob, at = self.blob, self.offsets
        return b"".join(blob[at[i] : at[i + 1]] for i in ids).decode("utf-8", errors="replace")


class Encoder:
    """Backtracking encoder over one vocabulary."""

    def __init__(self, source: str) -> None:
        import ahocorasick

        self.vocabulary = vocabulary = Vocabulary(source)
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[bytes, int] = {}
        for i, raw in enumerate(vocabulary.token_bytes):
            if raw and (len(raw) == 1 or i in vocabulary.rank):
                self.automaton.add_word(raw.decode("latin-1"), (i, len(raw)))
                self.whole[raw] = i
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for raw, i in self.whole.items():
            for n in range(len(raw) - 1, 0, -1):
                if (short := self.whole.get(raw[:n])) is not None:
                    self.shorter[i] = short
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def _rank(self, token: int) -> int:
        return self.vocabulary.rank.get(token, -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the boundary between these two neighbouring tokens."""
        pair = (left, right)
        if (kept := self.fits.get(pair)) is None:
            kept = self._undo(left, right)
            if len(self.fits) < PAIR_TABLE_SIZE:
                self.fits[pair] = kept
        return kept

    def _undo(self, left: int, right: int) -> bool:
        """Take the merges of both sides back, latest first; a merge across the boundary that comes before the undone one would have won."""
        merges, parts = self.vocabulary.merges, self.vocabulary.parts
        bound = 1 << 60
        while True:
            across = merges.get((left, right))
            if across is not None and across[0] < bound:
                return False
            rank_left, rank_right = self._rank(left), self._rank(right)
            if rank_left < 0 and rank_right < 0:
                return True
            if rank_left > rank_right:
                bound, left = rank_left, parts[left][1]
            else:
                # of two equal ranks the left one is merged first, so a crossing merge of this rank would win over the right one
                bound, right = rank_right + 1, parts[right][0]

    def encode_bytes(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        if not raw:
            return []
        longest = [0] * len(raw)
        best = [-1] * len(raw)
        for end, (token, n) in self.automaton.iter(raw.decode("latin-1")):
            start = end - n + 1
            if n > longest[start]:
                longest[start], best[start] = n, token
        lengths = self.vocabulary.token_bytes
        alive = bytearray(b"\x01") * (len(raw) + 1)
        out: list[int] = []
        at, token = 0, best[0]
        size = len(raw)
        while at < size:
            last = out[-1] if out else None
            while True:
                end = at + len(lengths[token])
                if alive[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    token = best[at] if at < size else -1
                    break
                nearer = self.shorter.get(token)
                if nearer is not None:
                    token = nearer
                    continue
                alive[at] = 0
                if last is None:
                    raise ValueError("the vocabulary does not cover every byte")
                out.pop()
                at -= len(lengths[last])
                token = last
                break
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty texts have none."""
        if not text:
            return []
        known, out = self.known, []
        for piece in PIECES.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode("utf-8", errors="surrogatepass"))
                if len(known) >= REMEMBERED_PIECES:
                    known.clear()
                known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    source = shared.value
    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(source)
    return _ENCODERS[key]


def encode_corpus(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """``id_column`` and ``ids`` of every row; a map-only stage, nothing is shuffled.

    The vocabulary file has a fixed size (1.6 MB); it is read once on the driver
    and broadcast, so executors need no local copy.
    """
    spark = documents.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts], dtype=object)

    rows = spread(documents.select(F.col(id_column), F.col(text_column)))
    return rows.select(F.col(id_column), ids(F.col(text_column)).alias("ids"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
