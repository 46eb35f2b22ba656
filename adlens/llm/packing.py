"""Sum-of-squares packing of documents into windows of a fixed number of tokens.

Windows are known by their fill level alone: a level array counts the partly filled windows at each level.
A document goes where the sum of the squared counts becomes smallest: into a window of some level, or a
new one.  Documents longer than a window fill windows of their own; what is left over is placed that way.

How much finds a window that it fills grows with the documents that one packer sees, so there are two passes.  In the
first, every Spark partition packs its own documents as they come.  What lies in windows that are still open at its end is
landed with its ids, piece by piece, and dealt to packers of about ``PIECES`` pieces each, whatever the partitions
were.  Only the windows that those leave open are cut to fill: their pieces are laid end to end into full windows, and the
last rest into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import land, texts
from adlens.llm.tokenizing import encoder

WINDOW = 1024
END_ID = 0
# Pieces of open windows that one packer of the second pass is given, on average.
PIECES = 32_768
# A packer of the first pass hands its open windows on early when they hold this many ids (64 MB).
OPEN_IDS = 1 << 24
# Sequence numbers of a partition start at its number times the first; those of the second pass lie above the second.
PARTITION_STRIDE = 1 << 32
SECOND_PASS = 1 << 62
ROWS_PER_BATCH = 8192

_NONE = np.iinfo(np.int64).max // 4


class Packer:
    """Windows of one packer.  A piece is (doc_id, start, ids, doc_tokens); closed windows are in ``rows``."""

    def __init__(self, first_id: int, size: int = WINDOW):
        self.size, self.next_id = size, first_id
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size)]
        self.open_ids = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.size
        for start in range(0, whole, self.size):
            self._close([(doc_id, start, ids[start:start + self.size], len(ids))], True)
        if whole < len(ids):
            # A copy, so that an open piece does not keep the ids of its whole document.
            self.place((doc_id, whole, ids[whole:].copy() if whole else ids, len(ids)))

    def choose(self, length: int) -> int:
        """The level whose use makes the sum of squares smallest; of equals the fullest, a new window last."""
        counts = self.level
        change = 1 - 2 * counts[1:self.size - length + 1]
        change[:-1] += 2 * counts[1 + length:self.size] + 1
        change[counts[1:self.size - length + 1] == 0] = _NONE
        if len(change):
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * counts[length] + 1:
                return best + 1
        return 0

    def place(self, piece: tuple) -> None:
        length = len(piece[2])
        level = self.choose(length)
        window = self.open[level].pop() if level else []
        if level:
            self.level[level] -= 1
        window.append(piece)
        self.open_ids += length
        if level + length == self.size:
            self.open_ids -= self.size
            self._close(window, True)
        else:
            self.open[level + length].append(window)
            self.level[level + length] += 1

    def _close(self, window: list[tuple], by_level: bool) -> None:
        offset = 0
        for doc_id, start, ids, tokens in window:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, tokens, self.next_id, offset, by_level, None))
            offset += len(ids)
        self.next_id += 1

    def take_open(self) -> list[tuple]:
        """The pieces of the open windows, fullest window first; none is open afterwards."""
        pieces = [p for windows in reversed(self.open) for w in windows for p in w]
        self.open = [[] for _ in range(self.size)]
        self.level[:] = 0
        self.open_ids = 0
        return pieces

    def finish(self) -> None:
        """Cut the open windows' pieces into full windows, and the rest into power-of-two ones."""
        pieces = self.take_open()
        left = sum(len(p[2]) for p in pieces)
        window, room = [], 0
        for doc_id, start, ids, tokens in pieces:
            while len(ids):
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    left -= room
                part = ids[:room]
                window.append((doc_id, start, part, tokens))
                ids, start, room = ids[room:], start + len(part), room - len(part)
                if not room:
                    self._close(window, False)
                    window = []


_FIELDS = {**dict.fromkeys(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "bigint"),
           "by_level": "boolean", "ids": "binary"}
_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _FIELDS.items())
_ARROW = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]


def _taken(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW)], names=list(_FIELDS))


def _first_pass(vocabulary: str, size: int, end_id: int):
    """Closed windows, and the pieces of open ones: these carry their ids, and a number of their own as sequence_id."""
    def run(batches):
        own = encoder(vocabulary)
        base = TaskContext.get().partitionId() * PARTITION_STRIDE
        packer, handed_on = Packer(base, size), base

        def opened():
            nonlocal handed_on
            pieces = packer.take_open()
            for at in range(0, len(pieces), ROWS_PER_BATCH):
                part = pieces[at:at + ROWS_PER_BATCH]
                yield _taken([(doc_id, start, len(ids), None, tokens, handed_on + n, None, False, ids.astype("<u4").tobytes())
                              for n, (doc_id, start, ids, tokens) in enumerate(part)])
                handed_on += len(part)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                packer.add(doc_id, np.append(np.frombuffer(own.ids(text), np.uint32), np.uint32(end_id)))
                if len(packer.rows) >= ROWS_PER_BATCH:
                    yield _taken(packer.rows)
                    packer.rows = []
                if packer.open_ids > OPEN_IDS:
                    yield from opened()
        yield _taken(packer.rows)
        yield from opened()
    return run


def _second_pass(size: int):
    def run(batches):
        packer = Packer(SECOND_PASS + TaskContext.get().partitionId() * PARTITION_STRIDE, size)
        for batch in batches:
            doc_ids, starts, tokens, ids = (batch.column(batch.schema.get_field_index(name))
                                            for name in ("doc_id", "start", "doc_tokens", "ids"))
            for doc_id, start, total, data in zip(doc_ids.to_pylist(), starts.to_pylist(), tokens.to_pylist(), ids):
                packer.place((doc_id, start, np.frombuffer(data.as_py(), "<u4"), total))
                if len(packer.rows) >= ROWS_PER_BATCH:
                    yield _taken(packer.rows)
                    packer.rows = []
        packer.finish()
        yield _taken(packer.rows)
    return run


def placed_pieces(docs: DataFrame, vocabulary: str, size: int = WINDOW, end_id: int = END_ID, pieces: int = PIECES) -> DataFrame:
    """The rows of ``pack`` and ``by_level``: false for what was laid end to end after the second pass."""
    first = land(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
                 .mapInArrow(_first_pass(vocabulary, size, end_id), _SCHEMA), "packed")
    opened = first.where("ids IS NOT NULL")
    packers = max(1, -(-opened.count() // pieces))
    # Dealt and ordered by the piece's number, so that a task that runs again packs the same way; hashed, as lengths
    # would come by levels otherwise.
    second = opened.repartition(packers, "sequence_id").sortWithinPartitions(F.xxhash64("sequence_id")) \
        .mapInArrow(_second_pass(size), _SCHEMA)
    return first.where("ids IS NULL").unionByName(second).drop("ids")


def pack(docs: DataFrame, vocabulary: str, size: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are ignored.  A null or empty text is the end id alone; a
    null doc_id stays null; repeated rows are packed each; an empty table gives no pieces.  A very long text fills
    windows of its own and is held whole by one task while it is encoded.  Of levels that cost the same the fullest is
    taken, and a new window last.
    """
    return placed_pieces(docs, vocabulary, size, end_id).drop("by_level")
