"""Substring dedup on words with a compressed FM-index per shard.

``_repeats`` routes the text that can hold a repeated window to shards.  A shard indexes its
bodies: the Burrows-Wheeler transform of the word sequence in a wavelet matrix, each level's
bits as runs where that is smaller and as packed words with block counts elsewhere.  The same
bodies then stream past the index: backward search extends from every place leftwards for as
long as the sequence has another occurrence, which gives the place's matching statistic, cut at
``width``; where it reaches ``width`` the interval holds all equal windows, of which the
earliest stays.

Words are ``[^\\x20\\x09-\\x0D]+``, held as 64-bit hashes.  Earlier means a smaller id (null
before all), or the same document and an earlier start.  Null texts have no words; rows that
repeat (same id and text) are treated alike; each row gives one row; empty tables give none;
other columns are ignored, whatever their names.  Memory follows the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._repeats import WORDS, Shard, identified, repeated_windows, window_starts
from .suffix_dedup import suffix_order

WIDTH, GRAM = 20, 6
#: Bytes of word hashes that a shard indexes at once, or one anchor's bodies.
SHARD_BYTES = 1 << 20


class _Packed:
    """Bits as words, with the ones before each."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 2, X.U)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.ones = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64))).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w, b = at >> 6, (at & 63).astype(X.U)
        return self.ones[w] + np.bitwise_count(self.words[w] & ((X.U(1) << b) - X.U(1)))


class _Runs:
    """Bits as the starts of their runs, with the ones before each; runs alternate."""

    def __init__(self, bits: np.ndarray, starts: np.ndarray):
        self.starts = starts.astype(np.int32)
        self.bit = bits[starts].astype(np.int32)
        sizes = np.diff(np.append(starts, len(bits)))
        self.ones = np.concatenate(([0], np.cumsum(sizes * self.bit)))[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        run = np.maximum(np.searchsorted(self.starts, at, "right") - 1, 0)
        return self.ones[run] + (at - self.starts[run]) * self.bit[run]


def compressed(bits: np.ndarray) -> _Packed | _Runs:
    """The smaller of two forms: 12 bytes a run, or 12 bytes for each 64 bits."""
    starts = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1])))
    return _Runs(bits, starts) if len(starts) < len(bits) // 64 else _Packed(bits)


class FMIndex:
    """Backward search over a sequence of numbers >= 1 (0 ends it)."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0)
        # the end sorts first; suffix_order takes numbers from 1
        order = suffix_order(text + 1)
        bwt = text[order - 1]
        self.size = len(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.levels = max(1, int(text.max()).bit_length())
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = ((bwt >> level) & 1).astype(bool)
            self.bits.append(compressed(bit))
            self.zeros.append(int(len(bwt) - bit.sum()))
            bwt = np.concatenate((bwt[~bit], bwt[bit]))
        symbols = np.arange(len(self.first) - 1)
        self.base = self._descend(symbols, np.zeros(len(symbols), np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            rank = self.bits[k].rank(at)
            at = np.where((symbols >> level) & 1, self.zeros[k] + rank, at - rank)
        return at

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol on the left."""
        step = self.first[symbols] - self.base[symbols]
        return self._descend(symbols, lo) + step, self._descend(symbols, hi) + step


def matching_statistics(index: FMIndex, text: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each end the longest stretch up to it, width at most, that the index holds twice or more, and the first row of its interval."""
    lo, hi = index.first[text[ends]], index.first[text[ends] + 1]
    length, interval, live = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.arange(len(ends))
    for k in range(1, width + 1):
        again = hi - lo > 1
        live, lo, hi = live[again], lo[again], hi[again]
        length[live], interval[live] = k, lo
        if k < width and len(live):
            lo, hi = index.extend(text[ends[live] - k], lo, hi)
    return length, interval


def matched_in_shard(shard: Shard, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an earlier occurrence for all members of their body, and for all but the first."""
    n_bodies = len(shard.n)
    ids = np.unique(shard.units, return_inverse=True)[1].astype(np.int64) + 2
    text = np.ones(len(ids) + n_bodies, np.int64)
    text[np.arange(len(ids)) + np.repeat(np.arange(n_bodies), np.diff(shard.offs))] = ids
    index = FMIndex(text)
    within = np.arange(shard.n.sum()) - np.repeat(np.cumsum(shard.n) - shard.n, shard.n)
    starts = np.repeat(shard.offs[:-1] + np.arange(n_bodies), shard.n) + within
    length, interval = matching_statistics(index, text, starts + width - 1, width)
    # equal windows have the same interval; the earliest place of each stays
    live = np.flatnonzero(length >= width)
    body = np.repeat(np.arange(n_bodies), shard.n)
    order = np.lexsort((shard.start[body[live]] + within[live], shard.id_rank[body[live]], interval[live]))
    later = np.zeros(len(live), bool)
    later[order[1:]] = interval[live[order[1:]]] == interval[live[order[:-1]]]
    again = np.zeros(len(starts), bool)
    again[live[later]] = True
    return again, np.repeat(shard.multi, shard.n) & ~again


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, keep_columns: bool = False) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_sha256, kept (string: the words that stay, one space between).

    With ``keep_columns``: row (a struct of all columns of docs), n_removed, kept (the text itself where nothing goes).
    """
    rows = identified(docs, id_col, text_col)
    texts, spans = repeated_windows(rows, WORDS, width, gram, SHARD_BYTES, matched_in_shard)

    def cut(batches):
        for batch in batches:
            n_removed, kept = [], []
            for text, own in zip(batch.column(0), batch.column(3), strict=True):
                words = text.as_py().encode().split()
                gone = window_starts(own.as_py(), len(words), width)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept], pa.string())],
                names=["r1", "r2", "n_removed", "kept_sha256", "kept"],
            )

    def whole(batches):
        for batch in batches:
            words = [(t.as_py() or "").encode().split() for t in batch.column("text")]
            kept = [b" ".join(w) for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=[*batch.schema.names, "n_words", "whole"])

    # copies with a larger id go entirely, so one row of each text is cut
    own = spans.join(texts.select("r1", "r2", "first_id"), ["r1", "r2"])
    done = rows.join(own, ["r1", "r2"]).where(F.col("id").eqNullSafe(F.col("first_id"))).select("text", "r1", "r2", "spans")
    done = done.mapInArrow(cut, "r1 long, r2 long, n_removed long, kept_sha256 string, kept string").dropDuplicates(["r1", "r2"])
    kind = rows.schema["id"].dataType.simpleString()
    later = ~F.col("id").eqNullSafe(F.col("first_id")) & (F.col("n_words") >= width)
    pick = lambda c, all_, none: F.when(later, all_).otherwise(F.coalesce(F.col(c), none)).alias(c)
    base = rows.mapInArrow(whole, f"id {kind}, text string, r1 long, r2 long, n_words long, whole string")
    if keep_columns:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        base = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text.alias("text")).withColumn("r1", F.xxhash64("text")).withColumn("r2", F.xxhash64(F.lit(7), "text"))
        base = base.withColumn("n_words", F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long"))
    else:
        base = base.drop("text").withColumn("text", F.lit(None).cast("string"))
    out = base.join(texts.select("r1", "r2", "first_id"), ["r1", "r2"]).join(done, ["r1", "r2"], "left")
    removed = pick("n_removed", F.col("n_words"), F.lit(0)).cast("long").alias("n_removed")
    if keep_columns:
        return out.select("row", removed, pick("kept", F.lit(""), F.col("text")))
    return out.select(F.col("id").alias(id_col), "n_words", removed, pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("whole")))
