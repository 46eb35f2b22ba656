"""Language-model scores through a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing, p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K) with h' the
shorter history, down to p(w) = (c(w) + 1) / (N + V + 1).  As an automaton: a history seen in training is a
state; an n-gram seen in training is an arc with its smoothed log10 probability; the failure arc of a state
leads to the shorter history at the cost log10(K / (c(h) + K)).  A text is traversed once, left to right.

Counts cover all training documents and never pass through the driver.  Documents lie in blocks of about
``BLOCK_BYTES``.  A block asks for the n-grams that occur in it, and says how often its training documents hold
them; n-grams meet by ranges of their hash (one message per block and range, so a frequent n-gram is one
entry per block), are summed, and the totals go back to the blocks that asked.  Each block then holds
the part of the automaton that its documents can reach, which gives the same scores as the whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import land, window_hashes, word_hashes, words_of

ORDER = 2
# Weight of the shorter history, in observations.
PRIOR = 1000.0
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 12_000_000
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)  # hashes of the marks before and after a text


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; one without doc_id is trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens_of(text: str | None) -> np.ndarray:
    """Word hashes of a text and the end mark."""
    return np.append(word_hashes(words_of(text)), _END)


class Block:
    """Tokens of the documents of a block, and for each order what it asks for.

    ``keys[n - 1]``: sorted distinct hashes of the n-grams that end at its tokens and, below the highest order,
    of the histories that begin with start marks; ``own[n - 1]``: the block's training counts of them;
    ``gram[n - 1]``: for each token the place of its n-gram; ``history[n - 1]``: that of the n tokens before it.
    """

    def __init__(self, table: pa.Table, order: int):
        self.ids = table.column("doc_id").to_pylist()
        runs = [tokens_of(t.as_py()) for t in table.column("text")]
        self.lengths = np.array([len(r) for r in runs], np.int64)
        self.training = np.array([not held_out(i) for i in self.ids], bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        # order - 1 start marks before each document, so no n-gram reaches across documents.
        pad = order - 1
        flat = np.concatenate([x for r in runs for x in (np.full(pad, _START), r)]) if runs else np.empty(0, np.uint64)
        heads = self.starts[:-1] + pad * np.arange(len(runs))
        at = np.arange(int(self.starts[-1])) + pad * np.repeat(np.arange(1, len(runs) + 1), self.lengths)
        counted = np.repeat(self.training, self.lengths).astype(np.float64)
        self.keys, self.own, self.gram, self.history = [], [], [], []
        for n in range(1, order + 1):
            hashed = window_hashes(flat, n) ^ np.uint64(n)
            if n == order:
                self._keep(hashed[at - (n - 1)], counted)
                break
            # All windows that end inside a document or just before its first token.
            before = heads + pad - 1
            ends = np.concatenate([at, before])
            self._keep(hashed[ends - (n - 1)], np.concatenate([counted, self.training.astype(np.float64)]))
            place = self.gram[-1]
            self.gram[-1] = place[:len(at)]
            previous = np.empty(len(at), np.int64)
            previous[1:] = self.gram[-1][:-1]
            previous[self.starts[:-1]] = place[len(at):]
            self.history.append(previous)

    def _keep(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        keys, place = np.unique(hashes, return_inverse=True)
        self.keys.append(keys)
        self.gram.append(place)
        self.own.append(np.bincount(place, weights, len(keys)).astype(np.int64))


def squeeze(sorted_keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of as few bytes as the largest needs, byte planes one after another."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unsqueeze(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as single bytes; those of 255 and more follow as longs."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def _ranges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of the hash space begins in sorted keys."""
    edges = [(i << 64) // ranges for i in range(ranges)]
    return np.append(np.searchsorted(keys, np.array(edges, np.uint64)), len(keys))


_ASK = "block int, part int, gram int, keys binary, counts binary"
_ANSWER = "block int, part int, gram int, counts binary, tokens bigint, types bigint"


def _ask(order: int, blocks: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = Block(table, order)
        rows: list[tuple] = []
        for n in range(1, order + 1):
            keys, counts = block.keys[n - 1], block.own[n - 1]
            cut = _ranges(keys, blocks)
            for part in range(blocks):
                a, b = cut[part], cut[part + 1]
                if a < b:
                    rows.append((key[0].as_py(), part, n, squeeze(keys[a:b]), pack_counts(counts[a:b])))
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["block", "part", "gram", "keys", "counts"])
    return run


def _sum(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of the n-grams of one range, handed back to each block in the order it asked."""
    part, gram = key[0].as_py(), key[1].as_py()
    keys = [unsqueeze(k.as_py()) for k in table.column("keys")]
    counts = [unpack_counts(c.as_py(), len(k)) for c, k in zip(table.column("counts"), keys)]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)
    answers, start = [], 0
    for k in keys:
        answers.append(pack_counts(totals[place[start:start + len(k)]]))
        start += len(k)
    # The history of start marks alone has a total too, but is no token.
    words = totals[distinct != _start_history(1)] if gram == 1 else np.empty(0, np.int64)
    n = len(answers)
    return pa.table([table.column("block"), pa.array([part] * n, pa.int32()), pa.array([gram] * n, pa.int32()),
                     pa.array(answers, pa.binary()), pa.array([int(words.sum())] + [0] * (n - 1), pa.int64()),
                     pa.array([int((words > 0).sum())] + [0] * (n - 1), pa.int64())],
                    names=["block", "part", "gram", "counts", "tokens", "types"])


def _start_history(n: int) -> np.uint64:
    return window_hashes(np.full(n, _START), n)[0] ^ np.uint64(n)


class Automaton:
    """States and arcs as arrays; state 0 is the empty history, and every token has an arc from it.

    A state has a level (the length of its history), a failure state and a failure weight; an arc has a weight
    and a target state.  ``reading[n]`` names, for each position of the text, the arc that reads its token
    from the state of the n tokens before it, or -1: the look-up of (state, token) done once for all.
    """

    def __init__(self, level, failure, failure_weight, weight, target, reading):
        self.level, self.failure, self.failure_weight = level, failure, failure_weight
        self.weight, self.target, self.reading = weight, target, reading

    def score(self, starts: np.ndarray, start_state: int) -> np.ndarray:
        """Sum of weights along each run of positions ``starts[i]:starts[i+1]``; all runs advance together."""
        lengths = np.diff(starts)
        by_length = np.argsort(-lengths, kind="stable")
        first, longest = starts[:-1][by_length], lengths[by_length]
        total = np.zeros(len(lengths))
        state = np.full(len(lengths), start_state, np.int64)
        running = np.searchsorted(-longest, -np.arange(int(longest[0]) if len(longest) else 0), side="left")
        for step, active in enumerate(running.tolist()):
            place = first[:active] + step
            arc = self.reading[self.level[state[:active]], place]
            stuck = np.flatnonzero(arc < 0)
            while len(stuck):
                total[stuck] += self.failure_weight[state[stuck]]
                state[stuck] = self.failure[state[stuck]]
                arc[stuck] = self.reading[self.level[state[stuck]], place[stuck]]
                stuck = stuck[arc[stuck] < 0]
            total[:active] += self.weight[arc]
            state[:active] = self.target[arc]
        out = np.empty(len(lengths))
        out[by_length] = total
        return out


def build(block: Block, totals: list[np.ndarray], prior: float, tokens: int, types: int) -> tuple[Automaton, int]:
    """The automaton that the block's documents can reach, and the state they start in.

    ``totals``: by order, the counts over all training documents of what the block asked for.  A key of order
    n below the highest is state ``offset[n] + place`` if it has a count; the others are never entered.
    """
    order = len(totals)
    offset = np.cumsum([0, 1] + [len(k) for k in block.keys[:-1]])  # by level; level 0 has one state
    count = int(offset[-1])
    level, failure, failure_weight = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count)
    n_tokens = int(block.starts[-1])
    reading = np.full((order, n_tokens), -1, np.int64)
    reached = np.zeros(n_tokens, np.int64)  # the state after each n-gram: its longest end that is one
    # A smoothed probability for each token position, order by order; one arc per distinct n-gram.
    seen = totals[0][block.gram[0]]
    probability = (seen + 1) / (tokens + types + 1)
    weights, targets, arcs = [], [], 0
    for n in range(1, order + 1):
        gram = block.gram[n - 1]
        seen = totals[n - 1][gram]
        if n < order:
            reached = np.where(seen > 0, offset[n] + gram, reached)
        arc = np.ones(n_tokens, bool)
        if n > 1:
            history = block.history[n - 2]
            size = totals[n - 2][history]
            probability = np.where(size > 0, (seen + prior * probability) / (size + prior), probability)
            arc = seen > 0
            state = offset[n - 1] + history
            level[state] = n - 1
            failure_weight[state] = np.log10(prior / (size + prior))
            if n > 2:
                shorter = block.history[n - 3]
                failure[state] = np.where(totals[n - 3][shorter] > 0, offset[n - 2] + shorter, 0)
        sample = np.zeros(len(block.keys[n - 1]), np.int64)  # a position where each n-gram occurs
        sample[gram] = np.arange(n_tokens)
        weights.append(np.log10(probability[sample]))
        targets.append(reached[sample])
        reading[n - 1, arc] = arcs + gram[arc]
        arcs += len(block.keys[n - 1])
    start = 0
    if n_tokens:
        for n in range(1, order):
            place = int(block.history[n - 1][0])
            start = int(offset[n] + place) if totals[n - 1][place] > 0 else start
    return Automaton(level, failure, failure_weight, np.concatenate(weights), np.concatenate(targets), reading), start


_SCORES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _score(order: int, blocks: int, prior: float, tokens: int, types: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, order)
        found = {(p, g): c for p, g, c in zip(answers.column("part").to_pylist(), answers.column("gram").to_pylist(),
                                              answers.column("counts").to_pylist())}
        totals = []
        for n in range(1, order + 1):
            cut = _ranges(block.keys[n - 1], blocks)
            parts = [unpack_counts(found[p, n], int(cut[p + 1] - cut[p])) for p in range(blocks) if cut[p] < cut[p + 1]]
            totals.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
        automaton, start = build(block, totals, prior, tokens, types)
        scores = automaton.score(block.starts, start)
        counts = totals[0][block.gram[0]]
        base = np.log10((counts + 1) / (tokens + types + 1))
        heads = block.starts[:-1]
        known = np.add.reduceat((counts > 0).astype(np.int64), heads) if len(heads) else heads
        return pa.table([pa.array(block.ids, pa.int64()), pa.array(~block.training), pa.array(block.lengths, pa.int64()),
                         pa.array(known, pa.int64()), pa.array(np.full(len(heads), tokens), pa.int64()),
                         pa.array(np.add.reduceat(base, heads) if len(heads) else np.empty(0)), pa.array(scores)], names=_SCORES)
    return run


def _block_number(blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")


def score_texts(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored.  A null or empty text is its end mark alone; a
    row without doc_id is trained on; repeated rows count and are scored each; an empty table gives an empty
    one, and without training documents every token is unknown.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    size = source.agg(F.sum(F.octet_length("text").cast("bigint")), F.count("*")).first()
    blocks = max(1, -(-((size[0] or 0) + 16 * size[1]) // block_bytes))
    blocked = source.withColumn("block", _block_number(blocks))
    requests = blocked.groupBy("block").applyInArrow(_ask(order, blocks), _ASK)
    answers = land(requests.groupBy("part", "gram").applyInArrow(_sum, _ANSWER), "totals")
    row = answers.agg(F.sum("tokens"), F.sum("types")).first()
    score = _score(order, blocks, prior, row[0] or 0, row[1] or 0)
    return blocked.groupBy("block").cogroup(answers.select("block", "part", "gram", "counts").groupBy("block")) \
        .applyInArrow(score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                             "base_score double, score double")
