import io
import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adlens.llm import idcodes, packing, tokencount, tokenizing
from adlens.session import scratch_path

ODD = ["a  b", " a", "a ", "\n", "\n\na b", "x\n y", "x \ny", "a <|endoftext|> b", "a<|endoftext|>", "’s it's we'll I'M 'S", "\x1c a\x1fb",
       "a\tb\r\nc", "é É", "ΣΑΣ ΟΔΟΣ", "İ ı ﬁ", "日本 語。", "12,345.67 ___ !!??", "a\x85b", "x y ​ z", "<s> x</s><unk><0x0A>",
       "▁▁a ▁b", "𝔘 \x00 é", "     " * 7 + "x", "a" * 300 + " " + "b.,;" * 40, "don't stop.\nNow, go!", "...", "a.b.c. d"]


@cache
def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizing.vocabulary_path(name))


def library_ids(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [tokenizing.BYTE_LEVEL, tokenizing.WORD_LEVEL])
def test_ids_equal_the_library(name):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizing.vocabulary_path(name))
    own = tokenizing.encoder(tokenizing.vocabulary_path(name))
    letters = random.Random(2)
    mixed = ["".join(letters.choice("aBé ,.!'\n1ßΣ漢-|") for _ in range(40)) for _ in range(1500)]
    for text in ["", None, *ODD, *mixed]:
        assert np.frombuffer(own.ids(text), np.uint32).tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_counts_equal_the_library():
    import sentencepiece
    path = tokenizing.vocabulary_path(tokencount.VOCABULARY)
    whole = sentencepiece.SentencePieceProcessor(model_file=path)
    own = tokencount.counter(path)
    letters = random.Random(3)
    mixed = ["".join(letters.choice("theaing aé ,.\n1ß漢▁") for _ in range(60)) for _ in range(1500)]
    for text in ["", None, *ODD, *mixed]:
        assert own.count(text) == len(whole.encode(text or "")), repr(text)


def test_count_table(docs):
    path = tokenizing.vocabulary_path(tokencount.VOCABULARY)
    rows = [(1, None), (2, ""), (3, "é x"), (None, "a"), (3, "é x"), (4, "word " * 9000)]
    got = sorted((tuple(r) for r in tokencount.token_counts(docs(rows), path).collect()), key=str)
    own = tokencount.counter(path)
    want = sorted(((i, len((t or "").encode()), own.count(t), own.count(t) > 4096) for i, t in rows), key=str)
    assert got == want and sum(w[3] for w in want) == 1
    assert tokencount.token_counts(docs([]), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.integers(0, 2**31))
def test_codes_give_any_id(values, seed):
    ids = np.array(values, np.uint32)
    levels = idcodes.encode(ids)
    at = np.random.default_rng(seed).integers(0, max(1, len(ids)), 50) if len(ids) else np.empty(0, int)
    assert (idcodes.access(levels, at) == ids[at]).all()
    first, last = sorted((seed % (len(ids) + 1), seed // 7 % (len(ids) + 1)))
    assert (idcodes.access_range(levels, first, last) == ids[first:last]).all()


def test_file_of_several_segments(monkeypatch):
    monkeypatch.setattr(idcodes, "SEGMENT_IDS", 1000)
    rng = np.random.default_rng(1)
    rows = [(None, np.array([7], np.uint32))] + [(i, rng.integers(0, 70_000, rng.integers(0, 700)).astype(np.uint32)) for i in range(40)]
    out = io.BytesIO()
    writer = idcodes.Writer(out)
    for key, ids in rows:
        writer.add(key, ids)
    writer.close()
    reader = idcodes.Reader(pa.BufferReader(out.getvalue()))
    assert reader.keys == [k for k, _ in rows]
    assert all((reader.document(i) == ids).all() for i, (_, ids) in enumerate(rows))
    with pytest.raises(ValueError):
        idcodes.Reader(pa.BufferReader(out.getvalue()[:-4]))


def test_id_files_equal_brute_force(docs, spark, words):
    rows = [(9, "b"), (9, "a"), (None, "z"), (3, None), (4, ""), *[(100 + i, t) for i, t in enumerate(ODD)]]
    rows += [(1000 - i, " ".join(words(30 * i, i))) for i in range(40)]
    folder = scratch_path(spark, "ids-test")
    files = idcodes.write_ids(docs(rows), folder, tokenizing.vocabulary_path(tokenizing.WORD_LEVEL))
    manifest = spark.createDataFrame(files.collect(), files.schema)
    got = [tuple(r) for r in idcodes.read_ids(manifest, folder).collect()]
    want, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library_ids(tokenizing.WORD_LEVEL, text), 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_id_files_of_an_empty_table(docs, spark):
    folder = scratch_path(spark, "ids-test")
    manifest = idcodes.write_ids(docs([]), folder, tokenizing.vocabulary_path(tokenizing.WORD_LEVEL))
    files = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert idcodes.read_ids(files, folder).count() == 0


def check_packing(pieces, expected, size=1024):
    """Every id in one piece, windows gapless and full or of a power-of-two length."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, tokens, window, offset in pieces:
        by_doc[doc, tokens].append((start, length, crc))
        by_window[window].append((offset, length))
    for placed in by_window.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= size and (end == size or end & (end - 1) == 0)
    for (doc, tokens), own in by_doc.items():
        candidates = [ids for d, ids in expected if d == doc and len(ids) == tokens]
        assert sum(length for _, length, _ in own) == tokens * len(candidates)
        if len(candidates) == 1:
            end = 0
            for start, length, crc in sorted(own):
                assert start == end and crc == zlib.crc32(np.array(candidates[0][start:start + length], "<u4").tobytes())
                end += length
    assert sum(p[2] for p in pieces) == sum(len(ids) for _, ids in expected)


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    packer = packing.Packer(0, 32)
    for _ in range(400):
        packer.level[1:32] = rng.integers(0, 4, 31)
        length = int(rng.integers(1, 32))
        costs = {}
        for level in [0, *[h for h in range(1, 33 - length) if packer.level[h]]]:
            after = packer.level.copy()
            if level:
                after[level] -= 1
            if level + length < 32:
                after[level + length] += 1
            costs[level] = int((after[1:32] ** 2).sum())
        assert costs[packer.choose(length)] == min(costs.values())


def test_packer_places_every_id_once():
    rng = np.random.default_rng(9)
    packer = packing.Packer(0, 64)
    expected = [(i, rng.integers(0, 50_000, int(rng.integers(1, 200))).astype(np.uint32).tolist()) for i in range(500)]
    for i, ids in expected:
        packer.add(i, np.array(ids, np.uint32))
    packer.finish()
    check_packing([r[:7] for r in packer.rows], expected, 64)


def plain_sum_of_squares(lengths, size):
    """Windows as lists of piece numbers: every possible place is tried and the whole sum taken anew."""
    windows, fills = [], []
    for n, length in enumerate(lengths):
        counts = defaultdict(int)
        for fill in fills:
            counts[fill] += fill < size

        def cost(level):
            after = counts.copy()
            after[level] -= level > 0
            after[level + length] += level + length < size
            return sum(v * v for v in after.values())
        fitting = sorted({f for f in fills if f + length <= size}, reverse=True) + [0]
        level = min(fitting, key=cost)
        if level:
            at = max(i for i, f in enumerate(fills) if f == level)
            windows[at].append(n)
            fills[at] += length
        else:
            windows.append([n])
            fills.append(length)
    return windows, fills


def test_packer_equals_plain_sum_of_squares():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 40, 600).tolist()
    packer = packing.Packer(0, 40)
    for n, length in enumerate(lengths):
        packer.place((n, 0, np.zeros(length, np.uint32), length))
    windows, fills = plain_sum_of_squares(lengths, 40)
    levels = np.bincount([f for f in fills if f < 40], minlength=41)
    assert (packer.level == levels).all() and packer.open_ids == sum(f for f in fills if f < 40)
    closed = defaultdict(int)
    for row in packer.rows:
        closed[row[5]] += row[2]
    assert set(closed.values()) == {40} and len(closed) == sum(f == 40 for f in fills) > 100


def test_small_partitions_are_packed_by_level(docs, words):
    rows = [(i, " ".join(words(1 + (i * 37) % 90, i))) for i in range(3000)]
    path = tokenizing.vocabulary_path(tokenizing.BYTE_LEVEL)
    expected = [(i, [*library_ids(tokenizing.BYTE_LEVEL, t), 0]) for i, t in rows]

    def share(table):
        got = [tuple(r) for r in packing.placed_pieces(table, path, 128).collect()]
        check_packing([r[:7] for r in got], expected, 128)
        left = [r for r in got if r[2] < 128]
        whole = sum(r[2] for r in left)
        by_level = [r for r in left if r[7]]
        first = sum(r[2] for r in by_level if r[5] < packing.SECOND_PASS)
        return first / whole, sum(r[2] for r in by_level) / whole
    table = docs(rows)
    # Partitions of 50 documents fill few windows alone; with the second pass they come near to one partition of all.
    (alone, small), (_, one) = share(table.repartition(60, "doc_id")), share(table.coalesce(1))
    assert small > 2 * alone and small > 0.85 * one > 0.6


def test_open_windows_are_handed_on_early(docs, words, monkeypatch):
    monkeypatch.setattr(packing, "OPEN_IDS", 500)
    rows = [(7, " ".join(words(40, i % 3))) for i in range(300)]
    path = tokenizing.vocabulary_path(tokenizing.BYTE_LEVEL)
    got = [tuple(r)[:7] for r in packing.placed_pieces(docs(rows), path, 64, pieces=50).collect()]
    check_packing(got, [(i, [*library_ids(tokenizing.BYTE_LEVEL, t), 0]) for i, t in rows], 64)


def test_packed_table(docs, words):
    rows = [(1, None), (2, ""), (3, " ".join(words(3000, 3))), *[(10 + i, t) for i, t in enumerate(ODD)]]
    rows += [(100 + i, " ".join(words(20 + 13 * i, i))) for i in range(50)] + [(None, "x"), (70, "same"), (70, "same")]
    path = tokenizing.vocabulary_path(tokenizing.BYTE_LEVEL)
    got = [tuple(r) for r in packing.pack(docs(rows), path).collect()]
    check_packing(got, [(i, [*library_ids(tokenizing.BYTE_LEVEL, t), 0]) for i, t in rows])
    assert packing.pack(docs([]), path).count() == 0
