"""Vectorised text primitives shared by the corpus operators.

Everything works on a *block*: the UTF-8 bytes of several documents laid end to end plus
their offsets.  Blocks hold about ``BLOCK`` bytes, or one longer document, so memory follows
the longest document and not the batch size.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: Bytes that end a word of the class [^\x20\x09-\x0D]+ .
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of a word of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Block(NamedTuple):
    """Documents ``lo:hi`` of a column; ``data[offs[i]:offs[i+1]]`` are one document's bytes."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray


class Words(NamedTuple):
    """Byte range of each word, first word of each document (``n_docs + 1`` long), document of each word."""

    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray
    doc: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a key depends on all bits of a polynomial hash."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Block]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary()) if not pa.types.is_null(column.type) else pa.array([b""] * len(column), pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, where, raw = column.buffers()
    offs = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield Block(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(max(n, BLOCK + 1), U(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of any range of ``values`` (see ``range_hash``)."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * powers(len(values))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range, the same wherever its content stands."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U))


def find_words(block: Block, kind: np.ndarray = SPACE_WORD) -> Words:
    data, offs = block.data, block.offs
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    starts = np.flatnonzero(inside[:-1] & (edge[:-1] | ~np.concatenate(([False], inside[:-2])) if len(data) else inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1
    first = np.searchsorted(starts, offs)
    return Words(starts, ends, first, np.repeat(np.arange(len(offs) - 1), np.diff(first)))


def word_hashes(block: Block, words: Words, prefix: np.ndarray | None = None) -> np.ndarray:
    return range_hash(prefix_hash(block.data) if prefix is None else prefix, words.starts, words.ends)


def lowered(block: Block) -> Block:
    """The block with A-Z lower-cased."""
    return block._replace(data=LOWER[block.data])


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n units; runs may cross documents, so mask them by ``same_doc``."""
    out = units[: max(0, len(units) - n + 1)].copy()
    for j in range(1, n):
        out *= U(_BASE)
        out += units[j : j + len(out)]
    return mix(out)


def same_doc(doc: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(doc) - n + 1)
    return doc[:m] == doc[n - 1 : n - 1 + m]


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n units lie in a range [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, -1 where it is absent."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return lookup(np.unique(twice), keys) >= 0


def per_doc(n_docs: int, doc: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Sum of values (or count) by document, as int64."""
    return np.bincount(doc, values, n_docs).astype(np.int64)
