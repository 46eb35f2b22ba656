"""Token counts of byte-pair vocabularies with scores, by merging alone: no ids are made.

A unit of text starts as a doubly linked list of characters; a heap holds the adjacent pairs whose union
is in the vocabulary.  The pair of lowest rank (leftmost among equals) is popped and merged, and the pairs
it forms with its neighbours are pushed, until none is left: the count is the initial symbols less the merges.
A character outside the vocabulary counts as its UTF-8 bytes and never merges.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import BoundedTable, texts

VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
SPACE = "▁"
# A unit is a run of spaces with what follows it; no piece of the vocabulary holds a space after another character.
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Counter:
    """Counts tokens of whole texts; the counts of repeated units are kept per worker."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("the vocabulary has pieces that reach across a space")
        self.units = BoundedTable(self.count_unit)

    def count_unit(self, unit: str) -> int:
        rank = self.rank
        symbols: list[str | None] = list(unit)
        count = sum(1 if s in rank else len(s.encode("utf-8", "surrogatepass")) for s in symbols)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap = [(rank[pair], i, pair) for i in range(len(symbols) - 1) if (pair := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left] if symbols[left] is not None else -1
            if right < 0 or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged meanwhile
            count -= 1
            symbols[left], symbols[right] = pair, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                if (wider := pair + symbols[after[left]]) in rank:
                    heapq.heappush(heap, (rank[wider], left, wider))
            if before[left] >= 0 and (wider := symbols[before[left]] + pair) in rank:
                heapq.heappush(heap, (rank[wider], before[left], wider))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.units.__getitem__, _UNIT.findall(SPACE + text.replace(" ", SPACE))))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (columns doc_id, text; others are ignored).

    A null text counts as empty: no bytes, no tokens.  A null doc_id stays null; repeated rows are counted
    each; special strings inside a text are ordinary characters; an empty table gives an empty one.
    """
    def count(batches):
        own = counter(path)
        for batch in batches:
            sizes, tokens = [], []
            for text in texts(batch):
                sizes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                tokens.append(own.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([t > limit for t in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")) \
        .mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
