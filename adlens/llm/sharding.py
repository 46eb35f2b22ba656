"""Constant-time placement of documents on shards through a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime size: start at an offset and
step by a skip, both taken from a digest of the shard's name.  The shards take turns; whose turn it is
claims its first free slot.  A document's slot is its digest modulo the table size, its shard the slot's.
The table has ``table_size`` rows however many documents there are, so its broadcast is bounded by that
parameter; a change of the shard list moves little more than the share of the shards that changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
# Slots per shard: shards' shares of the table differ by at most one slot, one percent of a share.
SLOTS_PER_SHARD = 100
# More slots than this are refused, as the table is broadcast (16 bytes a slot).
MOST_SLOTS = 1_000_000
# Digests are cut to 15 hexadecimal digits, which fit a positive long.
DIGEST_DIGITS = 15


def next_prime(n: int) -> int:
    """The smallest prime that is not below ``n``."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(shards: int) -> int:
    return next_prime(shards * SLOTS_PER_SHARD)


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGEST_DIGITS], 16)


def fill_table(names: Sequence[str], size: int) -> list[int]:
    """For every slot the position in ``names`` of the shard that claimed it."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if size < len(names) or size != next_prime(size):
        raise ValueError("the table size must be a prime, not below the number of shards")
    if size > MOST_SLOTS:
        raise ValueError(f"a table of {size} slots is too large to broadcast")
    offset = [_number(f"offset:{n}") % size for n in names]
    skip = [_number(f"skip:{n}") % (size - 1) + 1 if size > 2 else 1 for n in names]
    step = [0] * len(names)
    owner = [-1] * size
    claimed = 0
    while True:
        for s in range(len(names)):
            while owner[slot := (offset[s] + step[s] * skip[s]) % size] >= 0:
                step[s] += 1
            owner[slot] = s
            claimed += 1
            if claimed == size:
                return owner


def lookup_table(spark: SparkSession, names: Sequence[str], size: int | None = None) -> DataFrame:
    """slot, shard: one row per slot, handed to SQL as one array."""
    owner = fill_table(names, size or table_size(len(names)))
    listed = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "owner")) \
        .select("slot", F.col("owner").cast("int").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGEST_DIGITS)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, names: Sequence[str], size: int | None = None) -> DataFrame:
    """Add ``slot`` and ``shard`` (position in ``names``) to every row; DataFrame functions only, no shuffle.

    Rows with equal keys share a shard.  A null key is placed like an empty one.  Columns of ``df`` named
    slot or shard are replaced.  An empty table stays empty.
    """
    size = size or table_size(len(names))
    rows = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    return rows.join(F.broadcast(lookup_table(df.sparkSession, names, size)), "slot") \
        .select(*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard")
