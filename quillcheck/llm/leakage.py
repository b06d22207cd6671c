"""Held-out evaluation passages inside a training corpus, found through an FM-index per shard.

Each shard of the corpus (one Arrow batch of documents) is normalised to words
and indexed: a suffix array over the word ids, its Burrows-Wheeler transform in
a wavelet tree, and a sample of the suffix positions.  All seeds of all test
items are searched backwards at once through the ranks of the tree; located
seeds give the pairs of document and item, and an alignment of the runs of
equal words decides each pair exactly: a passage of at least ``min_words``
consecutive words of the item with at most one word in ``per_error`` changed,
dropped or added.  Removal spans of a document are merged.

A passage of n words with n // 8 errors has an undisturbed run of at least
five words for every n >= 15, so seeds of five words lose nothing.  Seeds that
are frequent everywhere only cost time, since every pair is verified.

Only the test items, a fixed table, are broadcast, after their number is
checked.  Nothing of the corpus is shuffled or collected.  Null, empty and
blank texts contain nothing.  A repeated item id counts once per text.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.session import collect_bounded, once_per_worker, spread

SEED_WORDS = 5
MIN_WORDS = 15
PER_ERROR = 8
#: Test items are a fixed, held-out set; more than this is an error, not cut off.
MAX_ITEMS = 200_000
#: Words indexed at once; a shard is closed when it reaches this size, texts are never divided.
SHARD_WORDS = 400_000
SAMPLE_RATE = 8

IGNORABLE = regex.compile(r"[\p{Cf}\p{Mn}͏ᅟᅠ឴឵ㅤﾠ]+")
WORD = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}\p{Cf}\p{M}]|(?<=\p{L})['’](?=\p{L}))*")
#: A word divided at the end of a line; soft hyphens inside a line are ignorable characters.
DIVISION = regex.compile(r"[-‐‑¬\u00ad]\s+")


def plain_word(word: str) -> str:
    """A word as a reader sees it: case, composition and invisible characters aside."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", IGNORABLE.sub("", unicodedata.normalize("NFKD", word)))
    return word.casefold().replace("'", "").replace("’", "")


def words_with_spans(text: str, known: dict[str, int] | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    """Words and their positions; a word divided by a hyphen and white space is one word where ``known`` has it undivided."""
    words: list[str] = []
    spans: list[tuple[int, int]] = []
    for m in WORD.finditer(text):
        w = plain_word(m[0])
        if not w:
            continue
        if known is not None and words and m.start() - spans[-1][1] >= 2 and DIVISION.fullmatch(text, spans[-1][1], m.start()):
            joined = words[-1] + w
            if joined in known:
                words[-1] = joined
                spans[-1] = (spans[-1][0], m.end())
                continue
        words.append(w)
        spans.append(m.span())
    return words, spans


class WaveletTree:
    """Ranks over a sequence of small integers, level by level from the highest bit."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        self.split: list[int] = []
        current = values.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level) & 1
            prefix = np.zeros(len(bit) + 1, dtype=np.int32)
            np.cumsum(1 - bit, out=prefix[1:])
            self.zeros.append(prefix)
            self.split.append(int(prefix[-1]))
            order = np.argsort(bit, kind="stable")
            current = current[order]

    def rank(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low, high = np.zeros_like(positions), positions.copy()
        for depth, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = ((symbols >> level) & 1).astype(bool)
            zeros, split = self.zeros[depth], self.split[depth]
            low = np.where(ones, split + low - zeros[low], zeros[low])
            high = np.where(ones, split + high - zeros[high], zeros[high])
        return high - low


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``values`` ends with a unique smallest symbol."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        if step < n:
            second[:-step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, dtype=np.int64)
        fresh[1:] = np.cumsum(ordered[1:] != ordered[:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search over one shard of word ids."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        order = suffix_array(values)
        self.bwt = values[order - 1]
        self.tree = WaveletTree(self.bwt, sigma)
        counts = np.bincount(values, minlength=sigma)
        self.first = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        self.size = len(values)
        kept = order % SAMPLE_RATE == 0
        self.sampled = np.flatnonzero(kept)
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of every row of ``patterns``, all searched at once from their last symbol."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbol = patterns[live, k]
            base = self.first[symbol]
            low[live] = base + self.tree.rank(symbol, low[live])
            high[live] = base + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled suffix is met."""
        out = np.full(len(rows), -1, dtype=np.int64)
        current, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = np.searchsorted(self.sampled, current[open_])
            at_safe = np.minimum(at, len(self.sampled) - 1)
            hit = self.sampled[at_safe] == current[open_]
            done = open_[hit]
            out[done] = self.positions[at_safe[hit]] + steps[done]
            open_ = open_[~hit]
            symbol = self.bwt[current[open_]]
            current[open_] = self.first[symbol] + self.tree.rank(symbol, current[open_])
            steps[open_] += 1
        return out % self.size


class Items:
    """The test items as word ids, and their distinct seeds."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item, text in rows:
            words, _ = words_with_spans(text)
            self.items.append((item, [self.ids.setdefault(w, len(self.ids) + 2) for w in words]))
        self.sigma = len(self.ids) + 2
        where: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for k, (_, words) in enumerate(self.items):
            if len(words) < MIN_WORDS:
                continue
            for i in range(len(words) - SEED_WORDS + 1):
                where[tuple(words[i : i + SEED_WORDS])].add(k)
        self.seeds = np.array(sorted(where), dtype=np.int64).reshape(-1, SEED_WORDS)
        self.owners = [sorted(where[s]) for s in map(tuple, self.seeds.tolist())]
        self.number = {s: k for k, s in enumerate(map(tuple, self.seeds.tolist()))}
        self._offsets: dict[int, dict[int, list[int]]] = {}

    def offsets(self, k: int) -> dict[int, list[int]]:
        """Positions of each seed in one item."""
        if k not in self._offsets:
            words, found = self.items[k][1], defaultdict(list)
            for i in range(len(words) - SEED_WORDS + 1):
                found[self.number[tuple(words[i : i + SEED_WORDS])]].append(i)
            self._offsets[k] = found
        return self._offsets[k]


def _reach(item: list[int], document: list[int], i: int, d: int, low: int, high: int, step: int, most: int) -> list[tuple[int, int]]:
    """Furthest (item words, document words) that e = 0, 1, ... errors reach from a position in one direction.

    Furthest-reaching diagonals: with each error either both sides, the item or
    the document move on by one word, then equal words are taken for free.
    """
    n = len(item) - i if step > 0 else i + 1
    m = high - d if step > 0 else d - low + 1

    def slide(a: int, b: int) -> int:
        while a < n and b < m and item[i + step * a] == document[d + step * b]:
            a += 1
            b += 1
        return a

    front = {0: slide(0, 0)}
    best = front[0]
    out = [(best, best)]
    for _ in range(most):
        if best >= n:
            break
        moved: dict[int, int] = {}
        for k, a in front.items():
            for nk, na in ((k, a + 1), (k + 1, a), (k - 1, a + 1)):
                b = na + nk
                if na <= n and 0 <= b <= m and na > moved.get(nk, -1):
                    moved[nk] = na
        front = {k: slide(a, a + k) for k, a in moved.items()}
        if not front:
            break
        k = max(front, key=lambda k: (front[k], -abs(k)))
        best = front[k]
        out.append((best, best + k))
    return out


def passage_at(
    item: list[int], document: list[int], i: int, d: int, low: int, high: int, min_words: int = MIN_WORDS, per_error: int = PER_ERROR
) -> tuple[int, int, int, int] | None:
    """The longest passage through the equal words at (i, d): item start and end, document start and end, or None."""
    most = len(item) // per_error
    right = _reach(item, document, i, d, low, high, 1, most)
    left = _reach(item, document, i - 1, d - 1, low, high, -1, most) if i > 0 and d > low else [(0, 0)]
    best = None
    for e, (ra, rb) in enumerate(right):
        for f, (la, lb) in enumerate(left):
            n = ra + la
            if n >= min_words and per_error * (e + f) <= n and (best is None or n > best[1] - best[0]):
                best = (i - la, i + ra, d - lb, d + rb)
    return best


def shard_leaks(documents: list[tuple[object, list[int]]], items: Items) -> Iterator[tuple[object, int, int, int]]:
    """(document id, item, first word, end word) of the passages in one shard."""
    starts, parts, at = [], [], 0
    for _, words in documents:
        starts.append(at)
        parts.append(np.asarray([*words, 1], dtype=np.int64))
        at += len(words) + 1
    values = np.concatenate([*parts, np.zeros(1, dtype=np.int64)])
    index = FMIndex(values, items.sigma)
    low, high = index.search(items.seeds)
    counts = high - low
    hit = np.flatnonzero(counts)
    if not len(hit):
        return
    rows = np.concatenate([np.arange(low[h], high[h]) for h in hit])
    seeds = np.repeat(hit, counts[hit])
    places = index.locate(rows)
    owner = np.searchsorted(np.asarray(starts), places, side="right") - 1
    diagonals: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for seed, place, doc in zip(seeds.tolist(), places.tolist(), owner.tolist(), strict=True):
        for k in items.owners[seed]:
            diagonals[doc, k].append((place - starts[doc], seed))
    for (doc, k), hits in diagonals.items():
        document, (item, words) = documents[doc], items.items[k]
        offsets = items.offsets(k)
        tried: set[tuple[int, int]] = set()
        found: list[tuple[int, int]] = []
        for place, seed in sorted(hits):
            for i in offsets[seed]:
                if (place - 1, i - 1) in tried:  # the same run of words goes on
                    tried.add((place, i))
                    continue
                tried.add((place, i))
                if any(a <= place < b for a, b in found):
                    continue
                if best := passage_at(words, document[1], i, place, 0, len(document[1])):
                    found.append(best[2:])
        for a, b in found:
            yield document[0], item, a, b


def find_leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """Passages: ``id_column``, ``item_id``, ``start_pos`` and ``end_pos`` (code points of the text, end exclusive)."""
    spark = documents.sparkSession
    rows = collect_bounded(items.where(F.col(text_column).isNotNull()).select(item_column, text_column).distinct(), MAX_ITEMS, "the table of test items")
    shared, version = spark.sparkContext.broadcast([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0], r[1]))]), uuid.uuid4().hex
    source = spread(documents.select(F.col(id_column), F.col(text_column).alias("_text")))
    source = source.where(F.col("_text").rlike(r"\S"))
    id_type = source.schema[id_column].dataType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = once_per_worker(version, lambda: Items(shared.value))
        ids = known.ids

        def closed(shard: list, spans: dict) -> pd.DataFrame:
            found = [(doc, item, spans[doc][a][0], spans[doc][b - 1][1]) for (doc, item, a, b) in shard_leaks(shard, known)]
            return pd.DataFrame([(shard_ids[doc], item, s, e) for doc, item, s, e in found], columns=[id_column, "item_id", "start_pos", "end_pos"])

        shard: list[tuple[int, list[int]]] = []
        spans: dict[int, list[tuple[int, int]]] = {}
        shard_ids: list = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch[id_column], batch["_text"], strict=True):
                words, where = words_with_spans(text, ids)
                key = len(shard_ids)
                shard_ids.append(doc)
                shard.append((key, [ids.get(w, 1) for w in words]))
                spans[key] = where
                size += len(words) + 1
                if size >= SHARD_WORDS:
                    yield closed(shard, spans)
                    shard, spans, shard_ids, size = [], {}, [], 0
        if shard:
            yield closed(shard, spans)

    return source.mapInPandas(search, f"{id_column} {id_type}, item_id bigint, start_pos int, end_pos int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they reveal."""
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id").distinct()


def merge_spans(spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Overlapping or touching spans of one document united; the spans of a document are few, so its window is small."""
    from pyspark.sql import Window

    order = Window.partitionBy(id_column).orderBy("start_pos", "end_pos")
    before = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before >= F.col("start_pos"), 0).otherwise(1))
    grouped = marked.withColumn("_group", F.sum("_new").over(order))
    return grouped.groupBy(id_column, "_group").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_group")


def p8_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged spans of leaked text to cut out of each document."""
    leaks = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return merge_spans(leaks.select("doc_id", "start_pos", "end_pos"))
