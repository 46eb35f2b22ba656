"""Source divergence audit with late string materialization.

Terms are counted per task and written once with their text; what is shuffled to be counted is a fixed-width digest of
each term.  Per digest the smallest and the largest string are kept: if they differ, several terms share the digest,
and it is split by the strings themselves.  Text is joined back for the ranked terms alone.

1. Groups (language and source) and languages get 64-bit keys; a key that two groups share is seen by its smallest and
   largest name, and all keys are then made anew under another seed.
2. Every task counts occurrences and documents per language, group and digest.
3. Digests in ``MIN_DOCS`` documents of a language and more are kept, with one (group, count) cell per group.
4. Divergence of two sources is a sum over all kept terms of the language.  Terms that only one of them has are
   summed over the distinct probabilities of a source, terms that neither has all weigh the same, and terms that both have
   are corrected for in each task, so no row per pair of sources and term is ever made.
5. The terms of a group are cut at the value of its ``TOP`` th, digests and values alone; the strings then join the few
   terms that reach it, and order those of equal value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import land

MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
DIGEST_BITS = 64
# Pairs that are worked on, and sums that are held, at a time in one task.
PAIRS = 1_000_000
# A task writes out its counts when it holds so many different words (about 130 bytes each) or tokens (8 bytes at most).
HELD_WORDS = 500_000
HELD_TOKENS = 6_000_000
# Texts are split into words in pieces of so many bytes.
PIECE = 1 << 20
# Probabilities are computed in two steps of long division, so that counts up to 9 * 10**13 stay exact.
_STEPS = (100_000, 10_000)

_KEEP = bytes(range(65, 91)) + bytes(range(97, 123))
_TERM_BYTES = bytes(0x20 if b < 0x80 and b not in _KEEP else b | 0x20 if 65 <= b <= 90 else b for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, in UTF-8, with A-Z lower-cased."""
    return [word for words in _pieces(text) for word in words] if text else []


class _Numbers(dict):
    """Words by the order in which they came."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _pieces(text: bytes):
    """A text in pieces of about ``PIECE`` bytes, cut between terms."""
    text = text.translate(_TERM_BYTES)
    start = 0
    while len(text) - start > PIECE:
        stop = text.find(b" ", start + PIECE)
        if stop < 0:
            break
        yield text[start:stop].split()
        start = stop
    yield text[start:].split()


_COUNTS = "lang_key bigint, group_key bigint, digest bigint, term string, n bigint, df bigint"


def _counter(digest_bits: int, with_terms: bool = False):
    """Rows (lang_key, group_key, digest, n, df) of what a task has counted, and (digest, term) once for each word it saw;
    ``with_terms`` gives the term with each count instead."""
    mask = (1 << digest_bits) - 1

    def run(batches):
        numbers = _Numbers()
        tokens: dict[tuple[int, int], tuple[list, list]] = {}

        def rows(lang, group, digests, terms, n, df):
            size = len(digests)
            keys = [pa.nulls(size, pa.int64()) if k is None else pa.array(np.full(size, k, np.int64)) for k in (lang, group)]
            return pa.RecordBatch.from_arrays(
                [*keys, pa.array(digests), pa.nulls(size, pa.string()) if terms is None else terms, pa.array(n, pa.int64()), pa.array(df, pa.int64())],
                names=["lang_key", "group_key", "digest", "term", "n", "df"])

        def taken():
            digests = np.fromiter((xxhash.xxh3_64_intdigest(w) & mask for w in numbers), np.uint64, len(numbers)).view(np.int64)
            words = pa.array(list(numbers), pa.binary()).view(pa.string())
            if not with_terms and len(digests):
                none = np.zeros(len(digests), np.int64)
                yield rows(None, None, digests, words, none, none)
            for (lang, group), (all_ids, of_docs) in tokens.items():
                n, df = (np.bincount(np.concatenate(ids), minlength=len(numbers)) for ids in (all_ids, of_docs))
                held = np.flatnonzero(n)
                yield rows(lang, group, digests[held], words.take(pa.array(held)) if with_terms else None, n[held], df[held])
            numbers.clear()
            tokens.clear()

        held = 0
        for batch in batches:
            langs, groups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, group, value in zip(langs, groups, batch.column(2)):
                text = value.as_py()
                if not text:
                    continue
                found = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in _pieces(text) if words]
                if not found:
                    continue
                ids = found[0] if len(found) == 1 else np.concatenate(found)
                all_ids, of_docs = tokens.setdefault((lang, group), ([], []))
                all_ids.append(ids)
                of_docs.append(np.unique(ids))
                held += len(ids)
                if len(numbers) >= HELD_WORDS or held >= HELD_TOKENS:
                    yield from taken()
                    held = 0
        yield from taken()
    return run


def _group_keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """Distinct groups with their keys, and the seed under which no two of them share a key."""
    names = land(docs.select("lang", "source").distinct(), "groups")
    for seed in range(64):
        groups = names.select("*", F.xxhash64(F.lit(seed), "lang").alias("lang_key"), F.xxhash64(F.lit(seed), "lang", "source").alias("group_key"))
        shared = groups.groupBy("group_key").agg(F.min(F.struct("lang", "source")).alias("a"), F.max(F.struct("lang", "source")).alias("b")).where("a <> b")
        langs = groups.groupBy("lang_key").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).where("a <> b")
        if shared.isEmpty() and langs.isEmpty():
            return groups, seed
    raise RuntimeError("no seed gives every group a key of its own")


def _kept(local: DataFrame, min_docs: int) -> DataFrame:
    """lang_key, digest, part, n, cells (group_key, n) of what occurs in enough documents of a language.

    Both groupings lie on the partitioning by language and digest, so only fixed-width rows move, and once.
    """
    placed = local.select("lang_key", "group_key", "digest", "part", "n", "df").repartition("lang_key", "digest")
    cells = placed.groupBy("lang_key", "digest", "part", "group_key").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return cells.groupBy("lang_key", "digest", "part").agg(
        F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("group_key", "n")).alias("cells")) \
        .where(F.col("df") >= min_docs).drop("df")


def kept_terms(docs: DataFrame, seed: int, min_docs: int = MIN_DOCS, digest_bits: int = DIGEST_BITS) -> tuple[DataFrame, DataFrame]:
    """Kept terms with their counts per group, and (digest, part, term): the text of each.

    ``part`` numbers the terms that share a digest; it is 0 where a digest has one term only.
    """
    keyed = docs.select(F.xxhash64(F.lit(seed), "lang").alias("lang_key"), F.xxhash64(F.lit(seed), "lang", "source").alias("group_key"), F.col("text").cast("binary"))
    local = land(keyed.mapInArrow(_counter(digest_bits), _COUNTS), "counts")
    kept = land(_kept(local.where("lang_key IS NOT NULL").withColumn("part", F.lit(0)), min_docs), "kept")
    names = land(local.where("lang_key IS NULL").select("digest", "term").join(kept.select("digest").distinct(), "digest", "left_semi")
                 .groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "names")
    shared = names.where("term <> last").select("digest")
    single = names.select("digest", F.lit(0).alias("part"), "term")
    if shared.isEmpty():
        return kept, single
    # What shares a digest is counted anew with its strings.  A window per digest holds the terms that share one.
    again = land(keyed.mapInArrow(_counter(digest_bits, True), _COUNTS).join(shared, "digest", "left_semi"), "shared")
    of_digest = Window.partitionBy("digest").orderBy("term")
    parts = land(again.select("digest", "term").distinct().withColumn("part", F.row_number().over(of_digest)), "parts")
    split = _kept(again.join(parts, ["digest", "term"]), min_docs)
    both = land(kept.join(shared, "digest", "left_anti").select(*kept.columns).unionByName(split.select(*kept.columns)), "kept")
    return both, land(single.join(shared, "digest", "left_anti").select(*single.columns).unionByName(parts.select(*single.columns)), "names")


def _div(a: Column, b: Column) -> Column:
    """The whole part of a / b, in longs."""
    return F.call_function("div", a, b)


def _probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), by long division in two steps."""
    first, second = (F.lit(x).cast("bigint") for x in _STEPS)
    shifted = (count + 1) * first
    return _div(shifted, total) * second + _div(F.pmod(shifted, total) * second, total) + 1


def _weight(p: Column | str, q: Column | str) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return _div((p - q) * (p - q), q)


def _shared(batches):
    """Per pair of groups, what terms that both have weigh beyond what each was counted with alone."""
    sums: dict[tuple[int, int], int] = {}

    def taken():
        keys = list(sums)
        batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                            pa.array(list(sums.values()), pa.int64())], names=["group_key", "other_key", "both"])
        sums.clear()
        return batch

    def weight(p, q):
        return (p - q) * (p - q) // q

    for batch in batches:
        cells = batch.column(0)
        sizes = np.diff(cells.offsets.to_numpy())
        flat = cells.flatten()
        keys, at = np.unique(flat.field(0).to_numpy(), return_inverse=True)
        p, zero = flat.field(1).to_numpy(), flat.field(2).to_numpy()
        ends = np.cumsum(sizes)
        done = 0
        while done < len(sizes):
            # As many terms as have PAIRS pairs together, one at least.
            pairs = np.cumsum(sizes[done:] ** 2)
            stop = done + max(1, int(np.searchsorted(pairs, PAIRS, "right")))
            size, begin = sizes[done:stop], ends[done:stop] - sizes[done:stop]
            a = np.repeat(np.arange(begin[0], ends[stop - 1]), np.repeat(size, size))
            run = np.repeat(size, size ** 2)
            inside = np.arange(len(a)) - np.repeat(np.cumsum(size ** 2) - size ** 2, size ** 2)
            b = np.repeat(begin, size ** 2) + inside % np.maximum(run, 1)
            a, b = a[a != b], b[a != b]
            extra = weight(p[a], p[b]) - weight(p[a], zero[b]) - weight(zero[a], p[b]) + weight(zero[a], zero[b])
            which, place = np.unique(at[a] * len(keys) + at[b], return_inverse=True)
            total = np.zeros(len(which), np.int64)
            np.add.at(total, place, extra)
            for w, t in zip(which.tolist(), total.tolist()):
                pair = int(keys[w // len(keys)]), int(keys[w % len(keys)])
                sums[pair] = sums.get(pair, 0) + t
            done = stop
            if len(sums) >= PAIRS:
                yield taken()
    yield taken()


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = DIGEST_BITS) -> DataFrame:
    """lang, source, part, item, value, rank: per (lang, source) its divergence from every other source of the language
    (part ``pair``, all ranks) and the terms that stand out most against the language (part ``term``, up to ``top``).

    ``docs`` needs text, lang and source; other columns are ignored.  Nulls count as empty; an empty text has no term, and a
    group without terms is compared all the same; texts may be of any length; a repeated row is a further document;
    items of equal value are ordered by their UTF-8 bytes; an empty table gives an empty one.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names, seed = _group_keys(rows)
    kept, strings = kept_terms(rows, seed, min_docs, digest_bits)
    cells = kept.select("lang_key", "digest", "part", F.col("n").alias("lang_n"), F.explode("cells").alias("c")) \
        .select("lang_key", "digest", "part", "lang_n", "c.group_key", "c.n")
    of_lang = kept.groupBy("lang_key").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    of_group = cells.groupBy("group_key").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = land(names.join(of_lang, "lang_key", "left").join(of_group, "group_key", "left").select(
        "lang", "source", "lang_key", "group_key", F.coalesce("v", zero).alias("v"),
        (F.coalesce("total", zero) + F.coalesce("v", zero)).alias("m"), (F.coalesce("lang_total", zero) + F.coalesce("v", zero)).alias("lang_m"))
        .withColumn("zero", F.when(F.col("v") > 0, _probability(zero, F.col("m")))), "figures")
    placed = land(cells.join(groups.select("group_key", "m", "lang_m", "zero"), "group_key").select(
        "lang_key", "digest", "part", "group_key", "zero", _probability(F.col("n"), F.col("m")).alias("p"),
        _probability(F.col("lang_n"), F.col("lang_m")).alias("q")), "cells")
    return _pairs(placed, groups).unionByName(_terms(placed, groups, strings, top))


def _pairs(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of all ordered pairs of sources of a language, ranked per source."""
    each = groups.select("lang_key", "group_key", "source", "zero", "v", "lang")
    other = groups.select("lang_key", F.col("group_key").alias("other_key"), F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    spread = placed.groupBy("lang_key", "group_key", "zero", "p").agg(F.count("*").alias("c"))
    met = spread.join(other, "lang_key").where("group_key <> other_key")
    alone = met.groupBy("group_key", "other_key").agg(
        F.sum(F.col("c") * (_weight("p", "other_zero") - _weight("zero", "other_zero"))).alias("own"),
        F.sum(F.col("c") * (_weight("other_zero", "p") - _weight("other_zero", "zero"))).alias("others"))
    both = placed.groupBy("lang_key", "digest", "part").agg(F.collect_list(F.struct("group_key", "p", "zero")).alias("cells")) \
        .where(F.size("cells") > 1).select("cells").mapInArrow(_shared, "group_key bigint, other_key bigint, both bigint") \
        .groupBy("group_key", "other_key").agg(F.sum("both").alias("both"))
    back = alone.select(F.col("group_key").alias("other_key"), F.col("other_key").alias("group_key"), "others")
    pair = ["group_key", "other_key"]
    sums = each.join(other, "lang_key").where("group_key <> other_key") \
        .join(alone.select(*pair, "own"), pair, "left").join(back, pair, "left").join(both, pair, "left")
    none = F.lit(0).cast("bigint")
    value = F.when(F.col("v") > 0, F.col("v") * _weight("zero", "other_zero")).otherwise(none) \
        + F.coalesce("own", none) + F.coalesce("others", none) + F.coalesce("both", none)
    # A window holds the sources of one language, as the result does.
    ranked = Window.partitionBy("group_key").orderBy(F.desc("value"), "item")
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"), "group_key") \
        .withColumn("rank", F.row_number().over(ranked)).drop("group_key")


def _terms(placed: DataFrame, groups: DataFrame, strings: DataFrame, top: int) -> DataFrame:
    """The terms of highest value per source; strings join those that reach the value of the last one only."""
    valued = placed.where("p > q").select("group_key", "digest", F.col("part").alias("_part"), _weight("p", "q").alias("value"))
    by_value = Window.partitionBy("group_key").orderBy(F.desc("value"))
    least = valued.select("group_key", "value").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top) \
        .groupBy("group_key").agg(F.min("value").alias("least"))
    reached = valued.join(least, "group_key").where("value >= least")
    texts = strings.select("digest", F.col("part").alias("_part"), F.col("term").alias("item"))
    by_item = Window.partitionBy("group_key").orderBy(F.desc("value"), "item")
    ranked = reached.join(texts, ["digest", "_part"]).select("group_key", "item", "value") \
        .withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    return ranked.join(groups.select("group_key", "lang", "source"), "group_key") \
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
