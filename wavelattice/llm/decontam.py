"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of every word of the documents: a row for each block of
documents with its terms (hashes, in order), their counts and their word positions.  A
document's postings stay together, so a search needs no shuffle, and one index serves any
number of benchmarks.  ``search`` orders the terms of each benchmark window by their counts in
the corpus, starts from the postings of the rarest and intersects them with the offset-adjusted
lists of the others; what is left are exact phrase matches.  Windows are looked up by their
rarest term, so a block costs what its own terms ask for, not what the benchmark holds.

A proximity match is a document in which the ``NEAR_TERMS`` rarest distinct terms of an item
(all, if it has fewer) stand within ``NEAR_SPAN`` consecutive words in any order; the rarest
are taken among the terms that the corpus holds, those of equal count in the item's order.  An
item of which the corpus holds fewer terms than that has no proximity match.

The benchmark is held in memory only in blocks of at most ``MAX_BENCHMARK_BYTES`` of text (as
flat arrays, about six times that); a larger one is searched block by block over the same
index, and the matches are merged.

Nulls count as texts without words.  Items of fewer words than a window are one window;
repeated item ids count once, a null id as ''.  Every input row gives one row, repeated rows
and null ids too; empty tables give no rows or no hits.  Other columns are ignored, whatever
their names.  A very long text is a block of its own; memory follows the longest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import stored

WINDOW = 10
#: Rarest distinct terms of an item that a proximity match needs, and the most words they may span.
NEAR_TERMS, NEAR_SPAN = 3, 12
MAX_BENCHMARK_BYTES = 8 << 20
INDEX_BLOCK = 1 << 20
#: Candidates that a search step holds at once.
CANDIDATES = 1 << 20


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as byte planes, of which the upper ones compress to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def build_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings of all words of every document, stored in the shared folder.

    Columns: block (unique), ids, n_words (by document), terms (sorted hashes), counts (by
    term), positions (word positions in the block, by term, as differences).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def index(batches):
        for batch in batches:
            for block in X.blocks(batch.column(1), INDEX_BLOCK):
                low = X.lowered(block)
                words = X.find_words(low, X.ALNUM_WORD)
                hashes = X.word_hashes(low, words)
                order = np.argsort(hashes, kind="stable")
                ranked = hashes[order]
                first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
                steps = np.diff(order, prepend=0)
                steps[first] = order[first]
                ids = batch.column(0).slice(block.lo, block.hi - block.lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([np.diff(words.offs)], pa.list_(pa.int64())),
                        pa.array([ranked[first].tobytes()], pa.binary()), pa.array([_planes(np.diff(np.append(first, len(ranked))))], pa.binary()), pa.array([_planes(steps)], pa.binary()),
                    ],
                    names=["ids", "n_words", "terms", "counts", "positions"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(index, f"ids array<{kind}>, n_words array<long>, terms binary, counts binary, positions binary")
    return stored(rows.withColumn("block", F.monotonically_increasing_id()), "postings")


class Items(NamedTuple):
    """A block of the benchmark: sorted distinct terms; term numbers of all words, item by item, with offsets; of each item the place of its name among the sorted distinct ones."""

    terms: np.ndarray
    words: np.ndarray
    offs: np.ndarray
    names: list[str]
    name: np.ndarray


def read_items(rows: list[tuple[str, str | None]]) -> Items:
    hashes, sizes = [np.zeros(0, X.U)], [np.zeros(0, np.int64)]
    for block in X.blocks(pa.array([text for _, text in rows], pa.string())):
        low = X.lowered(block)
        words = X.find_words(low, X.ALNUM_WORD)
        hashes.append(X.word_hashes(low, words))
        sizes.append(np.diff(words.offs))
    terms, at = np.unique(np.concatenate(hashes), return_inverse=True)
    names = sorted({name for name, _ in rows})
    place = {name: k for k, name in enumerate(names)}
    return Items(terms, at.astype(np.int32), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), names, np.array([place[name] for name, _ in rows], np.int32))


class Plan(NamedTuple):
    """What a search looks for, by rarest term.

    Windows: distinct sequences ``words[start:start + length]``, with their places by rarity
    (``order``, -1 beyond the length), filed under the rarest term with offsets by term, and the
    names of the items that hold each.
    Proximity: the key terms of each item that can match (-1 for none), rarest first, in order
    of the first, with offsets by term, and its name.
    """

    terms: np.ndarray
    words: np.ndarray
    start: np.ndarray
    length: np.ndarray
    order: np.ndarray
    window_offs: np.ndarray
    names_of: np.ndarray
    names_offs: np.ndarray
    keys: np.ndarray
    keys_offs: np.ndarray
    keys_name: np.ndarray


def make_plan(items: Items, count: np.ndarray, window: int) -> Plan:
    """count: of each term in the corpus."""
    sizes = np.diff(items.offs)
    n_windows = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
    item = np.repeat(np.arange(len(sizes)), n_windows)
    start = items.offs[item] + np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    length = np.minimum(sizes, window)[item]
    often = count[items.words]
    order, least = np.empty((len(start), window), np.int8), np.empty(len(start), np.int64)
    for lo in range(0, len(start), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        inside = np.arange(window) < length[s, None]
        counts = np.where(inside, often[np.where(inside, start[s, None] + np.arange(window), 0)], np.iinfo(np.int64).max)
        by = np.argsort(counts, axis=1, kind="stable")
        order[s], least[s] = np.where(np.take_along_axis(inside, by, 1), by, -1), counts.min(axis=1)
    # windows with a word that the corpus lacks stand nowhere; equal windows are one
    some = np.flatnonzero(least > 0)
    start, length, order, item = start[some], length[some], order[some], item[some]
    prefix = X.prefix_hash(items.words.astype(X.U))
    name = X.range_hash(prefix, start, start + length) if len(start) else np.zeros(0, X.U)
    _, first, same = np.unique(name, return_index=True, return_inverse=True)
    by = np.argsort(items.words[start[first] + order[first, 0]], kind="stable")
    place = np.empty(len(first), np.int64)
    place[by] = np.arange(len(first))
    pairs = np.unique(place[same] << 32 | items.name[item]) if len(same) else np.zeros(0, np.int64)
    start, length, order = start[first][by], length[first][by], order[first][by]
    term = items.words[start + order[:, 0]]
    n_terms = len(items.terms)

    # each item's distinct terms by count, then by first place
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, at = np.unique(owner << 32 | items.words, return_index=True) if len(owner) else (None, np.zeros(0, np.int64))
    distinct = np.bincount(owner[at], minlength=len(sizes))
    at = at[often[at] > 0]
    at = at[np.lexsort((at, often[at], owner[at]))]
    held = np.bincount(owner[at], minlength=len(sizes))
    need = np.minimum(distinct, NEAR_TERMS)
    rank = np.arange(len(at)) - (np.cumsum(held) - held)[owner[at]]
    keys = np.full((len(sizes), NEAR_TERMS), -1, np.int64)
    good = (held >= need)[owner[at]] & (rank < need[owner[at]])
    keys[owner[at[good]], rank[good]] = items.words[at[good]]
    able = np.flatnonzero(keys[:, 0] >= 0)
    able = able[np.argsort(keys[able, 0], kind="stable")]
    offsets = lambda of: np.searchsorted(of, np.arange(n_terms + 1))
    return Plan(items.terms, items.words, start, length, order, offsets(term), pairs & 0xFFFFFFFF, np.searchsorted(pairs >> 32, np.arange(len(start) + 1)), keys[able], offsets(keys[able, 0]), items.name[able])


class Postings(NamedTuple):
    """Benchmark terms of an index row that occur: ``places`` are term << 32 | position, sorted; offsets by document of all its words."""

    present: np.ndarray
    offs: np.ndarray
    places: np.ndarray
    doc_starts: np.ndarray

    def lists(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of each of some present terms, end to end, and which it belongs to."""
        sizes = self.offs[index + 1] - self.offs[index]
        which = np.repeat(np.arange(len(index)), sizes)
        at = self.offs[index][which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.places[at] & 0xFFFFFFFF, which

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether a term stands at a position."""
        return X.lookup(self.places, term.astype(np.int64) << 32 | position) >= 0

    def within(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether a term stands somewhere in lo .. hi."""
        key = term.astype(np.int64) << 32
        at = np.searchsorted(self.places, key | lo)
        return (at < len(self.places)) & (self.places[np.minimum(at, len(self.places) - 1)] <= (key | hi))


def read_postings(terms: np.ndarray, row: dict) -> Postings:
    """The postings of an index row that a search for the sorted terms needs."""
    own, counts = np.frombuffer(row["terms"], X.U), _numbers(row["counts"])
    at = X.lookup(terms, own)
    good = np.flatnonzero(at >= 0)
    begin = np.cumsum(counts) - counts
    sizes = counts[good]
    which = np.repeat(np.arange(len(good)), sizes)
    first = np.cumsum(sizes) - sizes
    steps = _numbers(row["positions"])[begin[good][which] + np.arange(len(which)) - first[which]]
    upto = np.cumsum(steps)
    positions = upto - (upto[first] - steps[first])[which] if len(which) else upto
    return Postings(at[good], np.concatenate(([0], np.cumsum(sizes))), at[good][which] << 32 | positions, np.concatenate(([0], np.cumsum(row["n_words"], dtype=np.int64))))


def _chunks(weight: np.ndarray) -> Iterator[slice]:
    """Ranges of about CANDIDATES in weight."""
    upto, lo = np.cumsum(weight), 0
    while lo < len(weight):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CANDIDATES, "right")))
        yield slice(lo, hi)
        lo = hi


def _wanted(offs: np.ndarray, postings: Postings) -> tuple[np.ndarray, np.ndarray]:
    """What a plan files under the present terms (offs by term), and the index of the term of each."""
    sizes = offs[postings.present + 1] - offs[postings.present]
    which = np.repeat(np.arange(len(sizes)), sizes)
    return offs[postings.present][which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes), which


def find_phrases(plan: Plan, postings: Postings) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every occurrence inside a document."""
    windows, term = _wanted(plan.window_offs, postings)
    found = [np.zeros((2, 0), np.int64)]
    for s in _chunks(postings.offs[term + 1] - postings.offs[term]):
        position, which = postings.lists(term[s])
        window = windows[s][which]
        start = position - plan.order[window, 0]
        doc = np.searchsorted(postings.doc_starts, np.maximum(start, 0), "right") - 1
        good = (start >= 0) & (start + plan.length[window] <= postings.doc_starts[doc + 1])
        window, start = window[good], start[good]
        for k in range(1, plan.order.shape[1]):
            place = plan.order[window, k].astype(np.int64)
            keep = place < 0
            inside = np.flatnonzero(~keep)
            keep[inside] = postings.holds(plan.words[plan.start[window[inside]] + place[inside]], start[inside] + place[inside])
            window, start = window[keep], start[keep]
        found.append(np.stack([window, start]))
    return tuple(np.concatenate(found, axis=1))


def find_near(plan: Plan, postings: Postings) -> tuple[np.ndarray, np.ndarray]:
    """(name, document) of every proximity match."""
    rows, term = _wanted(plan.keys_offs, postings)
    found = [np.zeros((2, 0), np.int64)]
    for s in _chunks(postings.offs[term + 1] - postings.offs[term]):
        base, which = postings.lists(term[s])
        row = rows[s][which]
        doc = np.searchsorted(postings.doc_starts, base, "right") - 1
        lo, hi = postings.doc_starts[doc], postings.doc_starts[doc + 1] - 1
        others = plan.keys[row, 1:]
        inside = lambda a, b: np.all([(o < 0) | postings.within(np.maximum(o, 0), a, b) for o in others.T] or [np.ones(len(a), bool)], axis=0)
        near = inside(np.maximum(base - NEAR_SPAN + 1, lo), np.minimum(base + NEAR_SPAN - 1, hi))
        base, row, doc, lo, hi, others = (v[near] for v in (base, row, doc, lo, hi, others))
        hit = np.zeros(len(base), bool)
        for back in range(NEAR_SPAN):  # every stretch of the span that holds the rarest term here
            first = base - back
            hit |= inside(np.maximum(first, lo), np.minimum(first + NEAR_SPAN - 1, hi))
        found.append(np.stack([plan.keys_name[row[hit]], doc[hit]]))
    pairs = np.concatenate(found, axis=1)
    pairs = np.unique(pairs[1].astype(np.int64) << 32 | pairs[0])
    return pairs & 0xFFFFFFFF, pairs >> 32


def _grouped(n: int, doc: np.ndarray, values: pa.Array) -> pa.Array:
    """Lists by document of values in document order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), values)


def search(index: DataFrame, items: Items, window: int) -> DataFrame:
    """One row per document: block, at, id, n_words, spans [start, end), items, near (names)."""
    sc = index.sparkSession.sparkContext
    terms = sc.broadcast(items.terms)

    def count(batches):
        for batch in batches:
            sums = np.zeros(len(terms.value), np.int64)
            for own, counts in zip(batch.column(0), batch.column(1), strict=True):
                at = X.lookup(terms.value, np.frombuffer(own.as_buffer(), X.U))
                sums[at[at >= 0]] += _numbers(counts.as_py())[at >= 0]
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["term", "n"])

    total = np.zeros(len(items.terms), np.int64)
    # a row for each benchmark term at most
    for term, n in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        total[term] = n
    plan, names = sc.broadcast(make_plan(items, total, window)), sc.broadcast(items.names)
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def find(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                held = row.drop_columns(["ids"]).to_pylist()[0]
                postings, n_docs = read_postings(plan.value.terms, held), len(held["n_words"])
                which, start = find_phrases(plan.value, postings)
                doc = np.searchsorted(postings.doc_starts, start, "right") - 1
                spans = np.unique(np.stack([doc, start - postings.doc_starts[doc], start - postings.doc_starts[doc] + plan.value.length[which]]), axis=1)
                sizes = plan.value.names_offs[which + 1] - plan.value.names_offs[which]
                each = np.repeat(np.arange(len(which)), sizes)
                at = plan.value.names_offs[which][each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hits = np.unique(doc[each] << 32 | plan.value.names_of[at])
                near, near_doc = find_near(plan.value, postings)
                known = pa.array(names.value, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([held["block"]] * n_docs, pa.int64()), pa.array(range(n_docs), pa.int32()), row.column("ids")[0].values, pa.array(held["n_words"], pa.int64()),
                        _grouped(n_docs, spans[0], pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in spans[1:]], names=["start", "end"])),
                        _grouped(n_docs, hits >> 32, known.take(pa.array(hits & 0xFFFFFFFF))), _grouped(n_docs, near_doc, known.take(pa.array(near))),
                    ],
                    names=["block", "at", "id", "n_words", "spans", "items", "near"],
                )

    return index.mapInArrow(find, f"block long, at int, id {kind}, n_words long, spans array<struct<start: long, end: long>>, items array<string>, near array<string>")


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """One row per document: id, n_words, spans (sorted word ranges of phrase matches), items and near (distinct item ids as strings, sorted)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // max_bytes))
    index, found = build_index(docs, id_col, text_col), None
    for b in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        one = search(index, read_items([tuple(r) for r in part.collect()]), window)  # max_bytes of text or so
        found = one if found is None else found.unionByName(one)
    if n_blocks > 1:
        whole = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        found = found.groupBy("block", "at").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), *map(whole, ("spans", "items", "near")))
        found = found.withColumns({c: F.array_sort(c) for c in ("spans", "items", "near")})
    return found.select(F.col("id").alias(id_col), "n_words", "spans", "items", "near")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``benchmark_matches`` with n_hit (words inside phrase matches), n_items, items_sha256, contaminated and n_near_items."""
    found = benchmark_matches(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    grow = "aggregate(spans, named_struct('n', 0L, 'to', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.end - greatest(a.to, s.start)), 'to', greatest(a.to, s.end))).n"
    return found.select(
        id_col, "n_words", F.expr(grow).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items"),
    )
