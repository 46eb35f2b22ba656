"""Shared pieces: words, word hashes, shingles, and tables landed in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.session import scratch_path

# A worker keeps the hashes, ids or counts of at most this many words, in all its tables together (about 300 bytes
# each); beyond it they start anew.
WORKER_LIMIT = 600_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\x09-\\x0D, in UTF-8, with A-Z lower-cased.

    ``bytes.lower`` changes ASCII letters only and ``bytes.split`` parts at exactly these six characters.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


# Longer words are looked up anew each time, so that keys are bounded too.
KEPT_LENGTH = 64


class BoundedTable(dict):
    """Computes a missing entry and keeps it.  The tables of a worker share one bound, as it serves the tasks of
    one operator after another: when it is reached all are emptied."""

    held = 0
    tables: list[BoundedTable] = []

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        BoundedTable.tables.append(self)

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= KEPT_LENGTH:
            if BoundedTable.held >= WORKER_LIMIT:
                for table in BoundedTable.tables:
                    table.clear()
                BoundedTable.held = 0
            self[key] = value
            BoundedTable.held += 1
        return value


# Python workers serve many tasks; the table of word hashes lives as long as the worker.
WORD_HASHES = BoundedTable(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash per window of ``size`` word hashes, in text order; empty if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _MIX + hashes[i:i + n]
    out ^= out >> _HALF
    out *= _FINISH
    out ^= out >> _HALF
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; fewer words make one shingle, none make none."""
    hashes = word_hashes(words_of(text))
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes, min(size, len(hashes))))


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | None]:
    """The texts of a batch one by one, so that only one is held as a Python string."""
    column = batch.column(batch.schema.get_field_index(name))
    for value in column:
        yield value.as_py()


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def unused_prefix(df: DataFrame) -> str:
    """Underscores with which no column of ``df`` begins, for the names of columns added on the way."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def land(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: computed once, and lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*landed: DataFrame) -> None:
    """Delete the files of landed tables that nothing reads any more."""
    for df in landed:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fingerprint(df: DataFrame, *columns: str) -> tuple[int, int]:
    """Row count and an order-free sum of row hashes."""
    row = df.agg(F.count("*").alias("n"),
                 F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
