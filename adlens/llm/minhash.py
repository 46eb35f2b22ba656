"""Near-duplicate documents: b-bit MinHash signatures, band candidates, exact confirmation, components.

1. Every text becomes its set of word shingles, ``BANDS * ROWS`` minima, and a packed signature that
   keeps the low ``BITS`` bits of each minimum (32 bytes for 128 minima of 2 bits).
2. Documents with equal sets form one class; only its smallest doc_id goes on.
3. Documents that agree on all minima of a band share a bucket.  A bucket is worked off in rounds: in
   each, a fixed number of members (hubs) meet all the others that are not yet in the same component,
   and leave.  What a round emits is linear in the bucket, and a bucket of copies becomes one component.
4. Buckets that still hold several components (documents that agree on some minima without being
   similar) are finished exactly: two sets that are similar enough share one of their rarest shingles
   (the prefix that the threshold leaves), so the remaining documents meet on those alone.
5. As they meet, pairs whose signatures' equal fields, corrected for chance agreement, estimate a
   similarity ``ERRORS`` standard errors below the threshold are dropped; the others are confirmed on
   full sets, the best estimate of each document first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import discard, land, list_column, shingle_set, texts, unused_prefix
from adlens.llm.components import components
from adlens.operators.ranking import ordered_positions

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 2
# So many members of a bucket meet all the others before the rest is finished on prefixes; by round.
HUBS = (4,)
# A pair goes on to the exact test unless its estimate is this many standard errors under the threshold.
ERRORS = 4.5

_SEEDS = (np.random.default_rng(20240229).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_CHUNK = 512
_FIELDS_PER_LONG = 64 // BITS


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a non-empty set."""
    out = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), _CHUNK):
        part = shingles[start:start + _CHUNK]
        np.minimum(out, (part[None, :] * _SEEDS[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band: its number and its minima, hashed."""
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(rows[i].tobytes(), seed=i) for i in range(BANDS)], np.uint64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of each minimum (of the upper half of the product, which mixes well), packed into longs."""
    fields = ((least >> np.uint64(32)) & np.uint64(2**BITS - 1)).reshape(-1, _FIELDS_PER_LONG)
    shifts = np.arange(_FIELDS_PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(fields << shifts, axis=1)


_SIGNATURE = "doc_id bigint, n_shingles bigint, set_hi bigint, set_lo bigint, bands array<bigint>, bits array<bigint>"
_LONGS = pa.list_(pa.int64())
_SIGNATURE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()),
                              ("set_lo", pa.int64()), ("bands", _LONGS), ("bits", _LONGS)])


def _sign(batches):
    for batch in batches:
        sizes, high, low, bands, bits = [], [], [], [], []
        for text in texts(batch):
            shingles = shingle_set(text, SHINGLE_WORDS)
            sizes.append(len(shingles))
            if len(shingles):
                digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
                least = minima(shingles)
                bands.append(band_keys(least).view(np.int64))
                bits.append(packed(least).view(np.int64))
            else:
                digest = np.zeros(2, np.int64)
                bands.append(np.empty(0, np.int64))
                bits.append(np.empty(0, np.int64))
            high.append(digest[0])
            low.append(digest[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
             list_column(bands, pa.int64()), list_column(bits, pa.int64())], schema=_SIGNATURE_ARROW)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, set size, digest of the set, band keys and packed signature of every row."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_sign, _SIGNATURE)


def _shingle_sets(batches):
    for batch in batches:
        sets = [shingle_set(text, SHINGLE_WORDS).view(np.int64) for text in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), list_column(sets, pa.int64())],
                                         schema=pa.schema([("doc_id", pa.int64()), ("shingles", _LONGS)]))


def estimated_similarity(left: Column, right: Column) -> Column:
    """Share of equal fields by bit counts, corrected for fields that agree by chance (once in 2**BITS).

    A field differs if any of its bits does: its bits are folded onto the lowest one and counted.
    """
    lowest = sum(1 << (BITS * i) for i in range(_FIELDS_PER_LONG))
    lowest -= (1 << 64) if lowest >= 1 << 63 else 0
    unequal = F.lit(0)
    for i in range(BANDS * ROWS // _FIELDS_PER_LONG):
        x = left.getItem(i).bitwiseXOR(right.getItem(i))
        folded = x
        for s in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(lowest)))
    chance = 2.0 ** -BITS
    return (1 - unequal / F.lit(float(BANDS * ROWS)) - chance) / (1 - chance)


def estimate_cut(percent: int = SIMILARITY_PERCENT) -> float:
    chance = 2.0 ** -BITS
    agree = percent / 100 * (1 - chance) + chance
    return percent / 100 - ERRORS * (agree * (1 - agree) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def _likely_pairs(members: DataFrame, hubs: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, estimate) of this round, and the members that stay for the next one.

    ``members``: bucket, id, n, bits, comp, and ``outside`` (not in the bucket's first component; only these
    become hubs, as members of one component need no further link).  The hub of a slot, a share of the
    bucket by hash, is its smallest id: buckets of the same copies choose the same hubs.
    """
    slotted = members.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(hubs)))
    chosen = land(slotted.where("outside").groupBy("bucket", "slot")
                  .agg(F.min(F.struct("id", "comp", "n", "bits")).alias("h"))
                  .select("bucket", "slot", F.col("h.id").alias("hub"), F.col("h.comp").alias("hub_comp"),
                          F.col("h.n").alias("hub_n"), F.col("h.bits").alias("hub_bits")), "hubs")
    estimate = estimated_similarity(F.col("bits"), F.col("hub_bits"))
    met = members.join(chosen.drop("slot"), "bucket").where(
        (F.col("comp") != F.col("hub_comp")) & (F.col("id") != F.col("hub"))
        & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (estimate >= estimate_cut(percent)))
    pairs = met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"),
                       estimate.alias("estimate")).distinct()
    left = chosen.select("bucket", F.col("hub").alias("id"), F.lit(True).alias("_left"))
    rest = members.join(left, ["bucket", "id"], "left").where("_left IS NULL").drop("_left", "comp", "outside")
    return land(pairs, "likely"), rest


# Sizes of sets fall into classes that grow by a third.
def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(4 / 3))).cast("int")


def _prefix_sides(left: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows that probe (id, n, ahead, ...) and those probed (b, b_n, b_ahead, ...), to be joined on shingle and class.

    ``left``: id, comp, n, bits.  Of two sets the larger one probes.  In order of rarity it does so with the first
    n - ceil(s * n) + 1 of its shingles; the smaller one, which must share more of its own, needs to be found by
    its first n - ceil(2 * s / (1 + s) * n) + 1 alone.  The class of the size parts a frequent shingle further.
    """
    held = sets.join(left.select(F.col("id").alias("doc_id")), "doc_id", "left_semi") \
        .select(F.col("doc_id").alias("id"), F.explode("shingles").alias("shingle"))
    frequency = held.groupBy("shingle").agg(F.count("*").alias("df"))
    kept = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    probed = F.col("n") - F.ceil(F.col("n") * (2 * percent) / F.lit(100 + percent)) + 1
    rows = held.join(frequency, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s")) \
        .join(left, "id").select("id", "comp", "n", "bits", F.posexplode(F.slice("s", F.lit(1), kept.cast("int"))).alias("at", "p")) \
        .where("p.df > 1").select("id", "comp", "n", "bits", (F.col("n") - F.col("at")).alias("ahead"),
                                  F.col("p.shingle").alias("shingle"), (F.col("at") < probed).alias("probed"))
    rows = land(rows, "prefixes")
    index = rows.where("probed").select("shingle", _size_class(F.col("n")).alias("class"), F.col("id").alias("b"),
                                        F.col("comp").alias("b_comp"), F.col("n").alias("b_n"), F.col("ahead").alias("b_ahead"),
                                        F.col("bits").alias("b_bits"))
    smallest = F.ceil(F.col("n") * percent / F.lit(100))
    probe = rows.drop("probed").withColumn("class", F.explode(F.sequence(_size_class(smallest), _size_class(F.col("n")))))
    return probe, index


def _prefix_pairs(active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, estimate) of remaining documents that share a prefix shingle and lie in different components.

    At the first common shingle, what is left of both sets must still suffice for the overlap, and the signatures
    must promise the similarity; both are tests of the join, which puts out no other pair.
    """
    left = land(active.groupBy("id").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.first("bits").alias("bits")),
                "left")
    probe, index = _prefix_sides(left, sets, percent)
    most = F.least("ahead", "b_ahead")
    estimate = estimated_similarity(F.col("bits"), F.col("b_bits"))
    return land(probe.join(index, ["shingle", "class"]).where(
        ((F.col("b_n") < F.col("n")) | ((F.col("b_n") == F.col("n")) & (F.col("b") < F.col("id"))))
        & (F.col("comp") != F.col("b_comp")) & (100 * F.col("b_n") >= percent * F.col("n"))
        & (100 * most >= percent * (F.col("n") + F.col("b_n") - most)) & (estimate >= estimate_cut(percent)))
        .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), estimate.alias("estimate")).distinct(), "rest")


def _relabel(df: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of ``node``; a node without links is its own."""
    return df.join(roots.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left") \
        .withColumn(name, F.coalesce("_root", node)).drop("_root")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    common = F.size(F.array_intersect("a_set", "b_set")).cast("bigint")
    union = F.size("a_set") + F.size("b_set") - common
    return pairs.select("a", "b") \
        .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("a_set")), "a") \
        .join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set")), "b") \
        .where(100 * common >= percent * union).select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()


def _connect(likely: DataFrame, roots: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Components after testing the pairs: first the best estimate of every document, then whatever pairs
    still lie in different components.  Most pairs of a large group are settled by the first step."""
    for best_only in (True, False):
        pending = likely
        if roots is not None:
            pending = _relabel(_relabel(likely, roots, "a", "a_comp"), roots, "b", "b_comp").where("a_comp <> b_comp")
        if best_only:
            ends = [pending.groupBy(end).agg(F.max(F.struct("estimate", "a", "b")).alias("p")).select("p.a", "p.b")
                    for end in ("a", "b")]
            pending = ends[0].union(ends[1]).distinct()
        links = land(_confirmed(pending, sets, percent), "confirmed")
        if roots is None or not links.isEmpty():
            roots = components((links if roots is None else links.union(roots))
                               .withColumnsRenamed({"node": "u", "root": "v"}))
    return roots


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (columns doc_id and text; others are ignored).

    Texts without words have an empty set and are linked with nothing.  A row without doc_id is linked with
    nothing either: component_id is null and it is kept.  Rows that repeat a doc_id are returned once each;
    if their texts differ, each carries the component of its own text.  An empty table gives an empty one.
    """
    signed = land(signatures(docs), "signatures")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = land(real.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
                   .where("copies > 1").drop("copies"), "classes")
    single = real.join(classes, ["set_hi", "set_lo"], "left").where("rep IS NULL OR doc_id = rep")
    banded = single.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"),
                           F.col("n_shingles").alias("n"), "bits")
    shared = land(banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "buckets")
    rest = members = land(banded.join(shared, "bucket").distinct(), "members")
    wanted = land(members.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    sets = land(source.join(wanted, "doc_id", "left_semi")
                .mapInArrow(_shingle_sets, "doc_id bigint, shingles array<bigint>").distinct(), "sets")
    active = members.withColumn("comp", F.col("id")).withColumn("outside", F.lit(True))
    roots = None
    for hubs in HUBS:
        likely, rest = _likely_pairs(active, hubs, percent)
        roots = _connect(likely, roots, sets, percent)
        labelled = land(_relabel(rest, roots, "id", "comp"), "labelled")
        mixed = land(labelled.groupBy("bucket").agg(F.min("comp").alias("first"), F.max("comp").alias("last"))
                     .where("first < last").select("bucket", "first"), "mixed")
        active = land(labelled.join(mixed, "bucket").withColumn("outside", F.col("comp") != F.col("first"))
                      .drop("first"), "active")
    roots = _connect(_prefix_pairs(active, sets, percent), roots, sets, percent)
    discard(sets, members)
    home = land(classes.join(roots, classes["rep"] == roots["node"], "left")
                .select("set_hi", "set_lo", F.coalesce("root", "rep").alias("class_root")), "homes")
    out = signed.join(home, ["set_hi", "set_lo"], "left").join(roots, signed["doc_id"] == roots["node"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")) \
        .otherwise(F.coalesce("class_root", "root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_per_group(docs: DataFrame, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group; rows equal in doc_id and text stay once, null ids
    stay all.

    Rows that share a doc_id but not a text are documents of their own, in the order of a hash of the text.
    """
    mark = unused_prefix(docs)
    text_hash, node = f"{mark}text_hash", f"{mark}node"
    rows = docs.where("doc_id IS NOT NULL").withColumn(text_hash, F.xxhash64("text"))
    own = land(rows.select("doc_id", text_hash).distinct(), "ids")
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
        chosen = docs.join(land(kept, "kept"), "doc_id").dropDuplicates(["doc_id"])
    else:
        nodes = land(ordered_positions(own, ["doc_id", text_hash], name=node), "nodes")
        told_apart = rows.join(nodes, ["doc_id", text_hash]).select(F.col(node).alias("doc_id"), "text")
        kept = near_duplicates(told_apart, percent).where("kept").select(F.col("doc_id").alias(node)).distinct()
        chosen = rows.join(land(nodes.join(kept, node).drop(node), "kept"), ["doc_id", text_hash]) \
            .dropDuplicates(["doc_id", text_hash])
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
