"""Quality rules, line first: lines that fail a rule go, then documents that lost too much go.

A line (a part between line feeds that holds a word) fails if

* punctuation: its last character is no closing mark, or marks of emphasis and markup outnumber half its words;
* navigation: a quarter of its words or more, and two at least, are bare separators;
* boilerplate: it holds one of the fixed phrases.

A document is rejected if its base figures fail or if failed lines hold more than ``LOSS_PERCENT`` of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlens.llm.common import texts, window_hashes, word_hashes

MIN_WORDS = 50
REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
LOSS_PERCENT = 40
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?:;\"')]}…”»。！？"
EMPHASIS = "!#$%&*<>"
SEPARATORS = ("|", "/", "»", "›", ">", "•", "·")
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies",
    "enable javascript", "lorem ipsum", "licensed under", "released under the", "copyright (c)", "click here",
)

_SPACES = " \t\n\v\f\r"
_DELETE_SYMBOLS = str.maketrans("", "", SYMBOLS)
_EMPHASIS_BYTES = EMPHASIS.encode()
_CLOSING = tuple(c.encode() for c in CLOSING)
_SEPARATORS = {s.encode() for s in SEPARATORS}
_PHRASES = tuple(p.encode() for p in BOILERPLATE)


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words fails one of the three rules."""
    if not words[-1].endswith(_CLOSING):
        return True
    if 2 * (len(line) - len(line.translate(None, _EMPHASIS_BYTES))) > len(words):
        return True
    bare = sum(w in _SEPARATORS for w in words)
    if bare >= 2 and 4 * bare >= len(words):
        return True
    lower = line.lower()
    return any(p in lower for p in _PHRASES)


def judge(text: str | None) -> tuple:
    """Word count, base figures, words lost with failed lines, verdicts, and the lines that stay."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen: set[bytes] = set()
    n_words = lost = duplicates = 0
    words: list[bytes] = []
    stay: list[bytes] = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            stay.append(line)
            continue
        words.extend(own)
        if line in seen:
            duplicates += 1
        seen.add(line)
        if line_fails(line, own):
            lost += len(own)
        else:
            stay.append(line)
    n_words = len(words)
    repeated = _repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n_words
    kept = not base_failed and 100 * lost <= LOSS_PERCENT * n_words
    return (n_words, len(text) - sum(map(text.count, _SPACES)), len(text) - len(text.translate(_DELETE_SYMBOLS)), duplicates,
            repeated, lost, base_failed, kept, b"\n".join(stay))


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more in the text."""
    keys = window_hashes(word_hashes(words), REPEAT_WINDOW)
    if not len(keys):
        return 0
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    often = count[place] > 1
    inside = np.zeros(len(words), bool)
    for i in range(REPEAT_WINDOW):
        inside[i:i + len(often)] |= often
    return int(inside.sum())


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")
_SCHEMA = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in _FIGURES) + ", base_failed boolean, kept boolean"


def _figures(batches):
    for batch in batches:
        rows = [judge(t)[:8] for t in texts(batch)]
        columns = list(zip(*rows)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:6]], *[pa.array(c, pa.bool_()) for c in columns[6:]]],
            names=["doc_id", *_FIGURES, "base_failed", "kept"])


def quality_figures(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id, text; others are ignored): figures and verdict.

    A null or empty text has no words and fails the base; a null doc_id stays null; repeated rows are judged
    each; an empty table gives an empty one.  Words hold what lies between space and \\x09-\\x0D.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_figures, _SCHEMA)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, their failed lines removed and n_chars counted anew; all columns of ``docs`` stay."""
    kind = docs.schema
    at = [f.name for f in kind].index("text")
    chars = [f.name for f in kind].index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches):
        for batch in batches:
            judged = [judge(t) for t in texts(batch)]
            stay = pa.array([j[7] for j in judged], pa.bool_())
            new = [j[8].decode("utf-8", "surrogatepass") for j in judged]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in new], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(stay)

    return docs.mapInArrow(clean, kind)
