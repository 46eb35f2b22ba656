"""Benchmark decontamination by greedy string tiling.

1. Seeds: every run of ``MIN_MATCH`` words of a benchmark item, hashed.  A document is looked at with an item
   only if they share seeds, and only its words inside shared seeds count, as each tile is made of seeds.
2. Tiling: the longest matches that do not overlap marked words, on either side, are marked again and again,
   by running Karp-Rabin: windows of the search length are hashed, equal ones are compared and extended; what
   marked words leave of a match is taken in its turn, and the length is halved, down to ``MIN_MATCH``.
3. A document holds an item if the tiles cover ``COVER_PERCENT`` of the item's words, in whatever order.

The benchmark is a query set: it is taken in blocks of about ``BLOCK_BYTES`` of text, each sent to all tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import BoundedTable, texts, window_hashes, words_of

MIN_MATCH = 5
COVER_PERCENT = 50
BLOCK_BYTES = 8_000_000
LOW_BITS = 20
_LOW_MASK = np.uint64((1 << LOW_BITS) - 1)
MARKS = b".,;:!?\"'()[]{}"

# Hash of a word without marks at its ends; kept per worker.
_WORDS = BoundedTable(lambda word: xxhash.xxh3_64_intdigest(word.strip(MARKS)))


def word_ids(text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _windows(words: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Rolling hash and start of every window without a marked word."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top = pow(base, length - 1, modulus)
    value = run = 0
    for i, word in enumerate(words):
        if marked[i]:
            value = run = 0
            continue
        if run >= length:
            value = (value - words[i - length] * top) % modulus
        value = (value * base + word) % modulus
        run += 1
        if run >= length:
            yield value, i - length + 1


def tile(text: list[int], pattern: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in text, start in pattern, length), disjoint on both sides.

    The longest unmarked match comes first, of equal ones the first in the pattern, then in the text.
    """
    text_marked, pattern_marked = [False] * len(text), [False] * len(pattern)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(text), len(pattern))
    while length >= min_match:
        at = defaultdict(list)
        for value, i in _windows(text, text_marked, length):
            at[value].append(i)
        found = []
        for value, j in _windows(pattern, pattern_marked, length):
            for i in at.get(value, ()):
                if i and j and text[i - 1] == pattern[j - 1] and not text_marked[i - 1] and not pattern_marked[j - 1]:
                    continue  # part of the match that starts before
                k = 0
                while i + k < len(text) and j + k < len(pattern) and text[i + k] == pattern[j + k] \
                        and not text_marked[i + k] and not pattern_marked[j + k]:
                    k += 1
                if k >= length:
                    found.append((-k, j, i))
        heapify(found)
        while found:
            k, j, i = heappop(found)
            free = [not text_marked[i + x] and not pattern_marked[j + x] for x in range(-k)]
            if all(free):
                text_marked[i:i - k] = [True] * -k
                pattern_marked[j:j - k] = [True] * -k
                tiles.append((i, j, -k))
                continue
            # Marked in part by a longer match: what is left on either side takes its turn.
            start = 0
            for end in [*(x for x, unmarked in enumerate(free) if not unmarked), -k]:
                if end - start >= length:
                    heappush(found, (start - end, j + start, i + start))
                start = end + 1
        if length == min_match:
            break
        length = max(min_match, length // 2)
    return tiles


class Items:
    """A block of benchmark items with the seeds of all of them in one sorted array."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.words, self.windows, seeds, owners = [], [], [], [], []
        for item_id, text in rows:
            words = word_ids(text)
            if len(words) < MIN_MATCH:
                continue
            windows = window_hashes(words, MIN_MATCH)
            own = np.unique(windows)
            seeds.append(own)
            owners.append(np.full(len(own), len(self.ids)))
            self.ids.append(item_id)
            self.words.append(words)
            self.windows.append(windows)
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owners = (np.concatenate(owners) if owners else np.empty(0, np.int64))[order]
        self.seeds, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        # Which low hash bits occur among the seeds: rules most windows out before the search.
        self.low = np.zeros(1 << LOW_BITS, bool)
        self.low[(self.seeds & _LOW_MASK).astype(np.int64)] = True

    def matches(self, text: str | None, percent: int) -> list[tuple[int | None, int, int]]:
        """(item_id, covered words, words) of the items that the text holds."""
        words = word_ids(text)
        hashes = window_hashes(words, MIN_MATCH)
        if not len(hashes) or not len(self.seeds):
            return []
        hits = np.flatnonzero(self.low[(hashes & _LOW_MASK).astype(np.int64)])
        if not len(hits):
            return []
        place = np.minimum(np.searchsorted(self.seeds, hashes[hits]), len(self.seeds) - 1)
        same = self.seeds[place] == hashes[hits]
        hits, place = hits[same], place[same]
        by_item = defaultdict(list)
        for at, seed in zip(hits.tolist(), place.tolist()):
            for item in self.owners[self.first[seed]:self.first[seed + 1]].tolist():
                by_item[item].append(at)
        out = []
        for item, starts in by_item.items():
            pattern = self.words[item]
            shared = np.flatnonzero(np.isin(self.windows[item], hashes[starts]))
            if 100 * _words_in_seeds(shared) < percent * len(pattern):
                continue  # tiles are made of seeds, and the item's words inside shared ones are too few
            covered = sum(k for _, _, k in tile(_inside(words, starts), pattern.tolist()))
            if 100 * covered >= percent * len(pattern):
                out.append((self.ids[item], covered, len(pattern)))
        return out


def _words_in_seeds(starts: np.ndarray) -> int:
    """How many words lie inside the seeds at these ascending places."""
    return int(np.minimum(np.diff(starts), MIN_MATCH).sum()) + MIN_MATCH if len(starts) else 0


def _inside(words: np.ndarray, starts: list[int]) -> list[int]:
    """The words inside seeds, stretches apart by a value that equals no word."""
    out: list[int] = []
    end = -1
    for start in starts:
        if start > end:
            out.append(-1)
        out.extend(words[max(start, end):start + MIN_MATCH].tolist())
        end = start + MIN_MATCH
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark (item_id, text) in blocks; each is one driver-side list of about ``block_bytes``."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text").cast("bigint") + 16)).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Items([tuple(r) for r in own.collect()])


_PAIRS = "doc_id bigint, item_id bigint, covered_words bigint, item_words bigint"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """doc_id, item_id, covered_words, item_words for every document that holds a benchmark item.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored.  Null and empty
    texts hold nothing; an item of fewer than ``MIN_MATCH`` words, or without text, is held by nothing; null
    ids stay null; repeated rows give repeated pairs; empty tables give an empty one.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = None
    for items in item_blocks(benchmark):
        def run(batches, items=items):
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), texts(batch)) for m in items.matches(t, percent)]
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["doc_id", "item_id", "covered_words", "item_words"])
        block = source.mapInArrow(run, _PAIRS)
        found = block if found is None else found.union(block)
    return found if found is not None else docs.sparkSession.createDataFrame([], _PAIRS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; one pass per block, no shuffle."""
    for items in item_blocks(benchmark):
        def run(batches, items=items):
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(t, percent) for t in texts(batch)], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
