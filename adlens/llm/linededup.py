"""Line dedup by pairwise alignment: blocks of lines that an earlier document holds go from the later one.

Lines are cut into pieces at sentence ends, so that a passage inside a longer line, or next to a changed sentence, is
found as well; in what follows a line is such a piece.  What is left of a cut line stays as one line.

1. A line key is made rare by construction: a line, lengthened by the lines after it until the run holds
   ``MIN_WORDS`` words.  Short common lines alone never are a key.
2. The earliest document with a key owns it; every later document with the key is aligned with the owner.
   One pair per document and owner: a key that a third of all documents share gives one pair for each.
3. A pair is aligned by patience diff on line hashes: lines that both hold once are matched along a longest
   increasing chain, and the gaps between matches are aligned in turn; equal lines at the ends of a gap match.
4. Aligned blocks of ``MIN_WORDS`` words or more are deleted from the later document.

Documents are ordered by doc_id, rows of one doc_id by a hash of their text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlens.llm.common import land, list_column, texts, unused_prefix

MIN_WORDS = 25
# A line is cut after the space that follows a sentence end; the pattern finds the ends of pieces and lines in UTF-8.
_PIECE_END = re.compile(rb"""\n|[.!?](?:["')\]]|\xe2\x80[\x9d\x99]|\xc2\xbb)?[\x20\x09\x0B-\x0D]""")
_LINE_END = re.compile(rb"\n")
# An owner's lines go to one task per so many documents that are aligned with it.
PAIRS_PER_TASK = 1000
# Hashes of runs are sums of line hashes times powers of this number.
_BASE = np.uint64(0x9E3779B97F4A7C15)
# The place of a piece: its line in the upper half, its number in the line in the lower one.
PLACE_BITS = 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))


_UP, _DOWN = _powers(4096)


def line_keys(text: str | bytes | None, min_words: int, sentences: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, word counts and places of the pieces with words, and the hashes of the runs that start at them."""
    global _UP, _DOWN
    data = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text) or b""
    hashes, counts, places = [], [], []
    start = place = 0
    digest = xxhash.xxh3_64_intdigest
    for match in (_PIECE_END if sentences else _LINE_END).finditer(data):
        end = match.end()
        words = data[start:end].split()
        if words:
            hashes.append(digest(b" ".join(words)))
            counts.append(len(words))
            places.append(place)
        start = end
        if data[end - 1] == 10:
            place = ((place >> PLACE_BITS) + 1) << PLACE_BITS
        else:
            place += 1
    words = data[start:].split()
    if words:
        hashes.append(digest(b" ".join(words)))
        counts.append(len(words))
        places.append(place)
    line, count = np.array(hashes, np.uint64), np.array(counts, np.int32)
    runs = np.empty(0, np.uint64)
    held = np.concatenate([np.zeros(1, np.int64), np.cumsum(count, dtype=np.int64)])
    if held[-1] >= min_words:
        if len(line) >= len(_UP):
            _UP, _DOWN = _powers(2 * len(line))
        # The least end with enough words, for every start that has one.
        first = np.arange(int(np.searchsorted(held, held[-1] - min_words, "right")))
        last = np.searchsorted(held, held[first] + min_words)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * _UP[:len(line)], dtype=np.uint64)])
        runs = np.unique((sums[last] - sums[first]) * _DOWN[first] ^ (last - first).astype(np.uint64))
    return line.view(np.int64), count, np.array(places, np.int64), runs.view(np.int64)


def patience_matches(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs of positions of equal lines, increasing in both."""
    matches: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matches.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matches.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        chain = _longest_chain(sorted((i, once_b[line]) for line, i in once_a.items() if line in once_b))
        if not chain:
            continue
        for (i, j), (k, l) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            gaps.append((i + 1, k, j + 1, l))
        matches.extend(chain)
    return sorted(matches)


def _once(lines: Sequence[int], first: int, last: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for i in range(first, last):
        seen[lines[i]] = -1 if lines[i] in seen else i
    return {line: i for line, i in seen.items() if i >= 0}


def _longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Patience sorting: the longest run of pairs that increases on both sides."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[pile], piles[pile] = j, n
    chain = []
    n = piles[-1] if piles else -1
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def _shortest_runs(lines: Sequence[int], counts: Sequence[int], min_words: int) -> Iterator[tuple[int, int]]:
    """First and end of the shortest run of ``min_words`` words that starts at a line, and of the one that ends there.

    What two documents share of ``min_words`` words or more is covered by such runs.
    """
    end = held = 0
    for first in range(len(lines)):
        while end < len(lines) and held < min_words:
            held += counts[end]
            end += 1
        if held < min_words:
            break
        yield first, end
        held -= counts[first]
    first = held = 0
    for end in range(1, len(lines) + 1):
        held += counts[end - 1]
        while held - counts[first] >= min_words:
            held -= counts[first]
            first += 1
        if held >= min_words:
            yield first, end


def common_blocks(later: Sequence[int], earlier: Sequence[int], counts: Sequence[int], min_words: int) -> list[int]:
    """Positions in ``later`` inside runs of ``min_words`` words or more that ``earlier`` holds: aligned blocks
    first, then the shared runs of lines that are left, wherever and however often they occur."""
    gone = set(_aligned_blocks(later, earlier, counts, min_words))
    if len(gone) == len(later):
        return sorted(gone)
    # A line that only the owner has is in no shared run; it ends the runs on its side.
    words = dict(zip(later, counts))
    held: set[tuple[int, ...]] = set()
    start = 0
    for stop in [*(j for j, line in enumerate(earlier) if line not in words), len(earlier)]:
        stretch = earlier[start:stop]
        held.update(tuple(stretch[i:k]) for i, k in _shortest_runs(stretch, [words[x] for x in stretch], min_words))
        start = stop + 1
    for i, k in _shortest_runs(later, counts, min_words) if held else ():
        if tuple(later[i:k]) in held:
            gone.update(range(i, k))
    return sorted(gone)


def _aligned_blocks(later: Sequence[int], earlier: Sequence[int], counts: Sequence[int], min_words: int) -> list[int]:
    gone: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience_matches(later, earlier), (len(later) + 1, len(earlier) + 1)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(counts[k] for k in block) >= min_words:
                gone.extend(block)
            block = []
        block.append(i)
        before = (i, j)
    return gone


def _aligned(min_words: int):
    def run(batches):
        for batch in batches:
            names = ["later", "later_hash", "lines", "counts", "places", "owner_lines"]
            columns = [batch.column(n) for n in names]
            gone, words = [], []
            for lines, counts, places, owner in zip(*(c.to_pylist() for c in columns[2:])):
                at = range(len(lines)) if lines == owner and sum(counts) >= min_words else common_blocks(lines, owner, counts, min_words)
                gone.append(np.array([places[i] for i in at], np.int64))
                words.append(np.array([counts[i] for i in at], np.int32))
            yield pa.RecordBatch.from_arrays([columns[0], columns[1], list_column(gone, pa.int64()), list_column(words, pa.int32())],
                                             names=["doc_id", "text_hash", "gone", "words"])
    return run


_LINES = "doc_id bigint, text_hash bigint, lines array<bigint>, counts array<int>, places array<bigint>, runs array<bigint>, n_lines bigint"


def _lined(docs: DataFrame, min_words: int, sentences: bool) -> DataFrame:
    def lines(batches):
        for batch in batches:
            found = [line_keys(t, min_words, sentences) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[list_column([f[i] for f in found], kind) for i, kind in
                                                    enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                 pa.array([len(np.unique(f[2] >> PLACE_BITS)) for f in found], pa.int64())],
                names=["doc_id", "text_hash", "lines", "counts", "places", "runs", "n_lines"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash")) \
        .mapInArrow(lines, _LINES)


def deletions(lined: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, gone (ascending places of pieces to delete), removed_words for documents that lose some."""
    known = lined.where("doc_id IS NOT NULL")
    keyed = known.select("doc_id", "text_hash", F.explode("runs").alias("run"))
    # Aggregates of longs are hashed; the owner's hash is looked for among the shared runs alone.
    # Both are written before they are joined, so that a hot run's rows can be split.
    shared = land(keyed.groupBy("run").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("l"), F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
                  .where("owner < l OR a < b").select("run", "owner"), "shared")
    rows = land(keyed.join(shared, "run"), "rows")
    owners = land(rows.where("doc_id = owner").groupBy("run").agg(F.min("text_hash").alias("owner_hash")), "owners")
    pairs = land(rows.join(owners, "run").where("doc_id <> owner OR text_hash <> owner_hash").select(
        F.col("doc_id").alias("later"), F.col("text_hash").alias("later_hash"), "owner", "owner_hash").distinct(), "pairs")
    # A hot owner's documents are dealt to several tasks, each with its lines.
    owner_key = ["owner", "owner_hash"]
    dealt = pairs.groupBy(*owner_key).agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("int").alias("tasks"))
    # Repeated rows have equal lines; one of each suffices.
    single = known.dropDuplicates(["doc_id", "text_hash"])
    later = single.select(F.col("doc_id").alias("later"), F.col("text_hash").alias("later_hash"), "lines", "counts", "places")
    owner = single.select(F.col("doc_id").alias("owner"), F.col("text_hash").alias("owner_hash"), F.col("lines").alias("owner_lines")) \
        .join(dealt, owner_key).select("*", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")).drop("tasks")
    matched = pairs.join(dealt, owner_key).withColumn("task", F.pmod(F.xxhash64("later", "later_hash"), F.col("tasks")).cast("int")).drop("tasks") \
        .join(later, ["later", "later_hash"]).join(owner, [*owner_key, "task"]) \
        .select("later", "later_hash", "lines", "counts", "places", "owner_lines") \
        .mapInArrow(_aligned(min_words), "doc_id bigint, text_hash bigint, gone array<bigint>, words array<int>")
    # A document has at most as many owners as pieces, so a group is bounded by the document itself.
    both = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("gone", "words"))))
    once = F.transform(F.array("g"), lambda g: F.filter(g, lambda x, i: (i == 0) | (x["gone"] != F.get(g, i - 1)["gone"])))[0]
    return matched.where(F.size("gone") > 0).groupBy("doc_id", "text_hash").agg(both.alias("g")).withColumn("g", once) \
        .select("doc_id", "text_hash", F.col("g.gone").alias("gone"), F.aggregate("g.words", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("removed_words"))


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, sentences: bool = True) -> DataFrame:
    """All rows and columns of ``docs``, texts without the deleted pieces (n_chars counted anew), plus ``n_lines``
    (with words) before, ``removed_lines`` (those without a word left) and ``removed_words``.

    Without ``sentences`` lines are not cut, and a passage inside a longer line stays.
    Null and empty texts and rows without doc_id stay as they are.  Copies of one text lose all lines but in
    the earliest document; identical rows of one doc_id lose the same lines.  Texts may be of any length.  Of documents that
    hold a passage equally, the one with the least doc_id, then the least text hash, owns it.  Columns of ``docs`` with the
    added names are replaced.  An empty table gives an empty one.
    """
    added = ["n_lines", "removed_lines", "removed_words"]
    lined = land(_lined(docs, min_words, sentences), "lines")
    gone = land(deletions(lined, min_words), "gone")
    kept = docs.drop(*added)
    own = unused_prefix(kept)
    rows = kept.withColumn(f"{own}hash", F.xxhash64("text"))
    # The deletions grow with the corpus: they meet the texts by key at every size and are never broadcast.
    key = ["doc_id", "text_hash"]
    lines = lined.groupBy(*key).agg(F.max("n_lines").alias("n"))
    mine = lines.join(gone, key, "left").select(F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}text_hash"), F.col("n").alias(f"{own}n"),
                                                F.col("gone").alias(f"{own}gone"), F.col("removed_words").alias(f"{own}words")).hint("merge")
    joined = rows.join(mine, rows["doc_id"].cast("bigint").eqNullSafe(mine[f"{own}id"]) & rows[f"{own}hash"].eqNullSafe(mine[f"{own}text_hash"]))
    schema = T.StructType([*kept.schema, *[T.StructField(name, T.LongType()) for name in added]])
    return joined.select(*kept.columns, f"{own}gone", f"{own}n", F.coalesce(f"{own}words", F.lit(0)).cast("bigint").alias(f"{own}words")) \
        .mapInArrow(_edit(schema, sentences), schema)


def without_pieces(text: str, gone: set[int], sentences: bool = True) -> tuple[str, int]:
    """A text without the pieces at some places, and how many lines go with them."""
    data = text.encode("utf-8", "surrogatepass")
    out: list[bytes] = []
    line: list[bytes] = []
    start = place = dropped = 0
    touched = False

    def closed() -> int:
        left = b"".join(line)
        if touched and not left.split():
            return 1
        out.append(left)
        return 0

    for match in (_PIECE_END if sentences else _LINE_END).finditer(data):
        end = match.end()
        ends_line = data[end - 1] == 10
        if place in gone:
            touched = True
        else:
            line.append(data[start:end - ends_line])
        start = end
        if ends_line:
            dropped += closed()
            line, touched = [], False
            place = ((place >> PLACE_BITS) + 1) << PLACE_BITS
        else:
            place += 1
    if place in gone:
        touched = True
    else:
        line.append(data[start:])
    dropped += closed()
    return b"\n".join(out).decode("utf-8", "surrogatepass"), dropped


def _edit(schema: T.StructType, sentences: bool):
    """Texts that lose nothing pass as they are."""
    names = [f.name for f in schema]
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            n = len(names) - 3
            columns = list(batch.columns[:n])
            marks = batch.column(n)
            changed = marks.is_valid()
            which = np.flatnonzero(changed.to_numpy(zero_copy_only=False))
            done = [without_pieces(columns[at][i].as_py(), set(marks[i].as_py()), sentences) for i in which.tolist()]
            lost = np.zeros(batch.num_rows, np.int64)
            if len(which):
                lost[which] = [d for _, d in done]
                columns[at] = pc.replace_with_mask(columns[at], changed, pa.array([t for t, _ in done], columns[at].type))
                if chars is not None:
                    columns[chars] = pc.replace_with_mask(columns[chars], changed, pa.array([len(t) for t, _ in done]).cast(columns[chars].type))
            yield pa.RecordBatch.from_arrays([*columns, batch.column(n + 1), pa.array(lost), batch.column(n + 2)], names=names)
    return run
