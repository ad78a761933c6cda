"""Exact byte-substring dedup by a difference-cover suffix sort.

``_repeats`` routes the text that can hold a repeated window to shards.  In a shard the
suffixes are sorted by the difference-cover algorithm: the triples at positions 1 and 2
modulo 3 are sorted and named, the names are sorted recursively, the suffixes at 0 modulo 3
are sorted with these ranks and merged in.  Suffixes that share ``width`` bytes then stand
side by side, so comparing the prefixes of neighbours gives every window that occurs again.
The recursion ends when names stand for ``width`` bytes or are all different.

Null texts are empty; matches never cross documents; each row gives one row, repeated rows
(which are copies of each other) and null ids too; empty tables give none; other columns are
ignored, whatever their names.  Memory follows the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._repeats import BYTES, Shard, identified, repeated_windows, window_starts

WIDTH, GRAM = 200, 64
#: Bytes of text that a shard sorts at once, or one anchor's bodies.
SHARD_BYTES = 1 << 20


def _pack(*columns: np.ndarray) -> np.ndarray:
    """One sortable number for each row of columns of non-negative numbers."""
    out = columns[0].astype(X.U)
    for c in columns[1:]:
        top, wide = int(out.max(initial=0)) + 1, int(c.max(initial=0)) + 1
        if top * wide >= 1 << 63:
            out = np.unique(out, return_inverse=True)[1].astype(X.U)
        out = out * X.U(wide) + c.astype(X.U)
    return out


def suffix_order(text: np.ndarray, need: int | None = None) -> np.ndarray:
    """Positions of text (numbers >= 1) in suffix order; with ``need``, in order of their first need numbers at least."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    # a dummy at n ends the first part of the names where it would run into the second
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    triple = _pack(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(triple)
    ranked = triple[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
    if names[order[-1]] < len(sample) and (need is None or need > 3):
        order = suffix_order(names, None if need is None else -(-need // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    rest = np.arange(0, n, 3)
    # the same widths for both sides of each comparison, so pack them together
    pair = _pack(np.concatenate((t[one], t[rest])), np.concatenate((rank[one + 1], rank[rest + 1])))
    three = _pack(np.concatenate((t[two], t[rest])), np.concatenate((t[two + 1], t[rest + 1])), np.concatenate((rank[two + 2], rank[rest + 2])))
    if need is not None:
        # names that stay equal leave ties in any order; within each the merge needs its keys in order
        slots = sampled % 3 == 1
        for part, keys in ((slots, pair[: len(one)]), (~slots, three[: len(two)])):
            if (keys[1:] < keys[:-1]).any():
                again = np.argsort(keys)
                sampled[part] = sampled[part][again]
                keys[:] = keys[again]
    by = np.argsort(pair[len(one) :])
    rest = rest[by]
    before = np.searchsorted(pair[: len(one)], pair[len(one) :][by]) + np.searchsorted(three[: len(two)], three[len(two) :][by])
    at = np.maximum.accumulate(before) + np.arange(len(rest))
    out = np.empty(n, np.int64)
    out[at] = rest
    left = np.ones(n, bool)
    left[at] = False
    out[left] = sampled
    return out


def repeated_in_shard(shard: Shard, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the bodies occur again (no first member is spared)."""
    n_bodies = len(shard.n)
    size = np.diff(shard.offs)
    # number 1 stands between bodies; windows never hold it
    at = shard.offs[:-1] + np.arange(n_bodies)
    text = np.ones(int(shard.offs[-1]) + n_bodies, np.int64)
    inside = np.arange(len(shard.units)) + np.repeat(np.arange(n_bodies), size)
    text[inside] = shard.units.astype(np.int64) + 2
    starts = np.repeat(at, shard.n) + np.arange(shard.n.sum()) - np.repeat(np.cumsum(shard.n) - shard.n, shard.n)
    window = np.full(len(text), -1, np.int64)
    window[starts] = np.arange(len(starts))
    order = suffix_order(text, width)
    order = order[window[order] >= 0]
    eight = np.zeros(len(text), X.U)
    for k in range(8):
        eight[: len(text) - k] |= (text[k:].astype(X.U) & X.U(255)) << X.U(8 * k)
    a, b = order[:-1], order[1:]
    for k in [*range(0, width - 7, 8), width - 8] if width >= 8 else ():
        same = eight[a + k] == eight[b + k]
        a, b = a[same], b[same]
    if width < 8:
        for k in range(width):
            same = text[a + k] == text[b + k]
            a, b = a[same], b[same]
    again = np.repeat(shard.multi, shard.n)
    again[window[a]] = True
    again[window[b]] = True
    return again, np.zeros(len(again), bool)


def remove_repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes that stay)."""
    rows = identified(docs, id_col, text_col)
    texts, spans = repeated_windows(rows, BYTES, width, gram, SHARD_BYTES, repeated_in_shard)

    def cut(batches):
        for batch in batches:
            n_removed, n_spans, kept = [], [], []
            for text, own in zip(batch.column(0), batch.column(3), strict=True):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8)
                gone = window_starts(own.as_py(), len(data), width)
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                names=["r1", "r2", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    # a text with copies goes entirely, so only single texts are cut
    single = spans.join(texts.where("copies = 1").select("r1", "r2"), ["r1", "r2"])
    done = rows.join(single, ["r1", "r2"]).select("text", "r1", "r2", "spans").mapInArrow(cut, "r1 long, r2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    base = rows.select("id", "r1", "r2", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    out = base.join(texts.select("r1", "r2", "copies"), ["r1", "r2"]).join(done, ["r1", "r2"], "left")
    pick = lambda c, all_, none: F.when(copied, all_).otherwise(F.coalesce(F.col(c), none)).alias(c)
    return out.select(
        F.col("id").alias(id_col), "n_bytes", pick("n_removed", F.col("n_bytes"), F.lit(0)), pick("n_spans", F.lit(1), F.lit(0)),
        pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("whole")), pick("kept", F.lit(b""), F.encode("text", "UTF-8")),
    ).withColumns({c: F.col(c).cast("long") for c in ("n_removed", "n_spans")})
