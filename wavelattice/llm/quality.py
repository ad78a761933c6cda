"""Quality rules by repetition coverage.

Rolling hashes of every n-gram length in ``LENGTHS`` find, with numpy and within each
document, the words that lie in an n-gram found twice or more; the characters of these words
against all word characters are the coverage of that length.  Repeated lines are measured
alike.  A document is rejected by the two base rules or when a coverage or the rate of symbols
exceeds its limit.

Null and empty texts have no words and fail the base rule; each input row gives one row, so
repeated rows and null ids come out as they went in; empty tables give none.  Columns besides
``id_col`` and ``text_col`` are ignored, whatever their names.  Memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

#: Largest share of word characters inside n-grams found twice or more, by n.
LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
LINE_LIMIT = 0.30
#: Most symbols a word; rows of symbols and tables without sentences exceed it.
SYMBOL_LIMIT = 0.4
MIN_WORDS = 10
BASE_N, BASE_PERCENT = 5, 20
SYMBOLS = b"#*$%&|<>"

_symbol = np.zeros(256, np.int64)
_symbol[list(SYMBOLS)] = 1
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in LIMITS))


def _measure(block: X.Block) -> list[np.ndarray]:
    n_docs = len(block.offs) - 1
    words = X.find_words(block)
    prefix = X.prefix_hash(block.data)
    hashes = X.word_hashes(block, words, prefix)
    upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    head = (block.data & 0xC0) != 0x80
    chars = upto(head & X.SPACE_WORD[block.data])
    word_chars = chars[words.ends] - chars[words.starts]
    symbols = upto(_symbol[block.data])

    breaks = np.flatnonzero(block.data == 0x0A)
    begin = np.unique(np.concatenate((block.offs[:-1], breaks + 1)))
    begin = begin[begin < len(block.data)]
    # a line ends at its newline or with its document; one that starts at a newline is empty
    stop = np.minimum(np.concatenate((breaks, [len(block.data)]))[np.searchsorted(breaks, begin)], block.offs[np.searchsorted(block.offs, begin, "right")])
    full = np.searchsorted(words.starts, stop) > np.searchsorted(words.starts, begin)
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(block.offs, begin, "right") - 1
    all_chars = upto(head)
    key = X.mix(X.range_hash(prefix, begin, stop) + X.mix(line_doc.astype(X.U)))
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    again = ~first

    out = [np.diff(words.offs), np.diff(chars[block.offs]), np.diff(symbols[block.offs]), X.per_doc(n_docs, line_doc[again])]
    coverage, grams = [], hashes.copy()
    salt = X.mix(words.doc.astype(X.U) + X.U(1))
    repeat_words = np.zeros(n_docs, np.int64)
    for n in range(2, max(LIMITS) + 1):
        grams = grams[: max(0, len(hashes) - n + 1)] * X.U(0x9E3779B97F4A7C15) + hashes[n - 1 :]
        if n not in LIMITS:
            continue
        whole = np.flatnonzero(X.same_doc(words.doc, n))
        starts = whole[X.repeated(X.mix(grams[whole] + salt[whole]))]
        inside = X.covered(len(hashes), starts, n)
        if n == BASE_N:
            repeat_words = X.per_doc(n_docs, words.doc[inside])
        coverage.append(X.per_doc(n_docs, words.doc[inside], word_chars[inside]))
    return [*out, repeat_words, X.per_doc(n_docs, line_doc[again], (all_chars[stop] - all_chars[begin])[again]), *coverage]


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and the counts of ``_COUNTS`` (long)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            parts = [_measure(b) for b in X.blocks(batch.column(1))]
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", *_COUNTS])

    measured = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(measure, f"id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
    return measured.withColumnRenamed("id", id_col)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``repetition_coverage`` with ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    verdict = (F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")) & (F.col("n_symbols") <= SYMBOL_LIMIT * F.col("n_words"))
    for n, limit in LIMITS.items():
        verdict &= F.col(f"dup_chars_{n}") <= limit * F.col("word_chars")
    return repetition_coverage(docs, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict)
