"""Token-id files of directly addressable codes: any id can be read without decoding a block.

Each id is split into chunks of ``CHUNK_BITS``, low chunk first.  Level 0 holds the low chunk of every id,
level k the next chunk of those ids that have one.  A bitmap beside each level tells which ids go on, and a
rank directory (ones before each block of ``RANK_BLOCK`` bits) gives an id's place in the next level.

File layout (little-endian): magic; segments of at most ``SEGMENT_IDS`` ids, each a sequence of levels
(chunks, bitmap, directory); document table (id, null flag, first id); segment table; footer with the
counts and table places; magic.  One file per Spark partition, documents in ascending doc_id order.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import texts
from adlens.llm.tokenizing import encoder
from adlens.session import scratch_path

MAGIC = b"DACIDS01"
CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_IDS = 1 << 20
END_ID = 2
_FOOTER = struct.Struct("<QQQQQ")  # ids, documents, document table, segments, segment table


class Level:
    """Chunks of one level, their continuation bitmap and its rank directory."""

    def __init__(self, chunks: np.ndarray, bitmap: np.ndarray, directory: np.ndarray):
        self.chunks, self.bitmap, self.directory = chunks, bitmap, directory

    @classmethod
    def build(cls, chunks: np.ndarray, goes_on: np.ndarray) -> Level:
        bitmap = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(goes_on.astype(np.uint32), np.arange(0, len(goes_on), RANK_BLOCK)) \
            if len(goes_on) else np.empty(0, np.uint32)
        directory = np.concatenate([np.zeros(1, np.uint32), np.cumsum(blocks, dtype=np.uint32)])
        return cls(chunks.astype(np.uint8), bitmap, directory)

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position: the directory's count and the ones of the block up to there."""
        return np.array([self.rank_of(i) for i in at.tolist()], np.int64)

    def rank_of(self, at: int) -> int:
        start = at // RANK_BLOCK * (RANK_BLOCK >> 3)
        part = int.from_bytes(self.bitmap[start:(at >> 3) + 1].tobytes(), "little")
        return int(self.directory[at // RANK_BLOCK]) + (part & ((1 << (at - start * 8)) - 1)).bit_count()


def encode(ids: np.ndarray) -> list[Level]:
    """The levels of a run of unsigned ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        higher = rest >> np.uint32(CHUNK_BITS)
        goes_on = higher > 0
        levels.append(Level.build(rest & np.uint32((1 << CHUNK_BITS) - 1), goes_on))
        if not goes_on.any():
            return levels
        rest = higher[goes_on]


def access(levels: list[Level], at: np.ndarray) -> np.ndarray:
    """The ids at any positions, each found through bitmaps and directories alone."""
    out = np.zeros(len(at), np.uint32)
    rows, place = np.arange(len(at)), np.asarray(at, np.int64)
    for depth, level in enumerate(levels):
        out[rows] |= level.chunks[place].astype(np.uint32) << np.uint32(CHUNK_BITS * depth)
        more = level.goes_on(place)
        if not more.any():
            break
        rows, place = rows[more], level.rank(place[more])
    return out


def access_range(levels: list[Level], first: int, last: int) -> np.ndarray:
    """The ids of a run of positions.  Those that go on lie side by side in the next level too, so a rank at
    the first position is enough."""
    out = np.zeros(last - first, np.uint32)
    rows: np.ndarray | slice = slice(None)
    for depth, level in enumerate(levels):
        out[rows] |= level.chunks[first:last].astype(np.uint32) << np.uint32(CHUNK_BITS * depth)
        lead = first & 7
        bits = np.unpackbits(level.bitmap[first >> 3:(last + 7) >> 3], bitorder="little")[lead:lead + last - first]
        more = np.flatnonzero(bits)
        if not len(more):
            break
        first = level.rank_of(first)
        last = first + len(more)
        rows = more if isinstance(rows, slice) else rows[more]
    return out


class Writer:
    """Appends documents; complete segments are written at once, so memory holds one segment."""

    def __init__(self, out):
        self.out, self.place, self.pending, self.held = out, 0, [], 0
        self.ids, self.starts, self.keys, self.segments = 0, [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.keys.append(doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        while self.held >= SEGMENT_IDS:
            self._segment()

    def _segment(self) -> None:
        joined = np.concatenate(self.pending)
        self.segments.append(self.place)
        levels = encode(joined[:SEGMENT_IDS])
        self._put(struct.pack("<Q", len(levels)))
        for level in levels:
            self._put(struct.pack("<QQQ", len(level.chunks), len(level.bitmap), len(level.directory)))
            self._put(level.chunks.tobytes() + level.bitmap.tobytes() + level.directory.astype("<u4").tobytes())
        self.pending = [joined[SEGMENT_IDS:]]
        self.held = len(self.pending[0])

    def close(self) -> None:
        if self.held:
            self._segment()
        table = self.place
        self._put(np.array([k is None for k in self.keys], np.uint8).tobytes())
        self._put(np.array([k or 0 for k in self.keys], "<i8").tobytes())
        self._put(np.array(self.starts, "<u8").tobytes())
        segments = self.place
        self._put(np.array(self.segments, "<u8").tobytes())
        self._put(_FOOTER.pack(self.ids, len(self.keys), table, len(self.segments), segments) + MAGIC)


class Reader:
    """Random access to the documents and ids of one file; one segment's arrays are held at a time."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - _FOOTER.size - len(MAGIC))
        footer = file.read(_FOOTER.size + len(MAGIC))
        if footer[-len(MAGIC):] != MAGIC:
            raise ValueError("not a finished id file")
        self.ids, documents, table, segments, places = _FOOTER.unpack(footer[:-len(MAGIC)])
        file.seek(table)
        null = np.frombuffer(file.read(documents), np.uint8)
        keys = np.frombuffer(file.read(8 * documents), "<i8")
        self.keys = [None if n else int(k) for n, k in zip(null, keys)]
        self.starts = np.append(np.frombuffer(file.read(8 * documents), "<u8").astype(np.int64), self.ids)
        file.seek(places)
        self.places = np.frombuffer(file.read(8 * segments), "<u8")
        self.current, self.levels = -1, []

    def _load(self, segment: int) -> list[Level]:
        if segment != self.current:
            self.file.seek(int(self.places[segment]))
            self.levels = []
            for _ in range(struct.unpack("<Q", self.file.read(8))[0]):
                chunks, bitmap, directory = struct.unpack("<QQQ", self.file.read(24))
                self.levels.append(Level(np.frombuffer(self.file.read(chunks), np.uint8),
                                         np.frombuffer(self.file.read(bitmap), np.uint8),
                                         np.frombuffer(self.file.read(4 * directory), "<u4")))
            self.current = segment
        return self.levels

    def slice(self, first: int, last: int) -> np.ndarray:
        """The ids of positions ``first`` up to but not including ``last``."""
        parts = []
        while first < last:
            segment = first // SEGMENT_IDS
            end = min(last, (segment + 1) * SEGMENT_IDS)
            base = segment * SEGMENT_IDS
            parts.append(access_range(self._load(segment), first - base, end - base))
            first = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, number: int) -> np.ndarray:
        return self.slice(int(self.starts[number]), int(self.starts[number + 1]))


_MANIFEST = "part int, path string, documents bigint, ids bigint"


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts, an end id after each, in ascending doc_id order; returns one row per file.

    ``folder`` is an address that executors reach (file:, hdfs:, s3:, ...).  A file is written under a name of
    its own and then renamed, so a repeated task replaces it as a whole.  Null texts are empty; null doc_ids
    come first; rows that share a doc_id lie side by side, ordered by text; an empty table gives no documents.
    """
    def write(batches):
        own = encoder(vocabulary)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = posixpath.join(root, f"ids-{part:06d}.dac")
        draft = f"{name}.{uuid.uuid4().hex}"
        documents = 0
        with store.open_output_stream(draft) as out:
            writer = Writer(out)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                    ids = np.frombuffer(own.ids(text), np.uint32)
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
                    documents += 1
            writer.close()
        store.move(draft, name)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [name], "documents": [documents], "ids": [writer.ids]})

    ordered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, _MANIFEST)


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files of a manifest.

    The window runs over one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                with store.open_input_file(path) as file:
                    reader = Reader(file)
                    count = len(reader.keys)
                    sums = [zlib.crc32(reader.document(i).astype("<u4").tobytes()) for i in range(count)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(reader.keys, pa.int64()), "start": pa.array(reader.starts[:-1] + base, pa.int64()),
                    "n_tokens": pa.array(np.diff(reader.starts), pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    # A stated number of partitions: small as the rows are, each stands for a file.
    files = based.select("path", "base").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark) -> str:
    return scratch_path(spark, "ids")
