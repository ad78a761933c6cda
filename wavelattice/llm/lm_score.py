"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary (every word of the corpus), order and smoothing: the
target model of the documents marked as target, and the background model of all documents.
They are matched by scaling the background's smoothing mass with its size, so that either
model trusts an expression of the same relative frequency alike.  A document's score is the
mean over its words of the loss under the target model less that under the background model;
its own bigrams are taken out of both models' counts before.  Lower is closer to the target.

All counts cover all documents and all words.  Documents are counted in pieces of about
``PIECE`` bytes: a piece sends its distinct words and bigrams, each once with its counts, to
the buckets of their hashes.  A bucket adds them up and answers every piece in the order in
which it asked.  The documents then meet the answers of their piece and are scored where they
stand.  So a bigram that every document holds is one key of each piece, no bucket gets much
of it, and nothing that grows with the corpus is broadcast or sent to the driver.

Words are those of ``[0-9a-z]`` and non-ASCII characters, lower-cased (A-Z), and are known by
63 bits of hash.  Null and empty texts have no tokens and score 0.  A very long text is a piece
of its own; memory follows the longest.  Each row gives one row, repeated rows and null ids
too; empty tables give none; other columns are ignored, whatever their names.  A document with
several labels is target if one of them says so.  Without target documents the target model is
the background's share of the smoothing alone and scores tell nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import partitions, stored

#: Smoothing mass of the target model's unigrams and bigrams, in words.
MASS_1, MASS_2 = 5000.0, 20.0
#: Bytes of text that are counted, and scored, at once.
PIECE = 4 << 20
#: Keys that a bucket gets, or about so many; a task has several buckets, one at a time.
BUCKET_KEYS = 1 << 19
#: Bytes of text for each key that its piece sends.
BYTES_A_KEY = 8
#: The context before a document's first word.
START = X.U(0)


class Totals(NamedTuple):
    """Distinct words, and words of all and of target documents."""

    distinct: int
    all_n: int
    all_t: int


class Piece(NamedTuple):
    """Sorted distinct keys of some documents; of each word its document and the keys' index of itself, its bigram and its context."""

    keys: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    bigram: np.ndarray
    head: np.ndarray
    begun: np.ndarray


def read_piece(texts: pa.Array) -> Piece:
    """Keys of words end in bit 0, of bigrams in bit 1."""
    hashes, docs = [np.zeros(0, X.U)], [np.zeros(0, np.int64)]
    for block in X.blocks(texts):
        low = X.lowered(block)
        words = X.find_words(low, X.ALNUM_WORD)
        hashes.append(X.word_hashes(low, words) & ~X.U(1))
        docs.append(words.doc + block.lo)
    word, doc = np.concatenate(hashes), np.concatenate(docs)
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    before = np.concatenate(([START], word))[:-1]
    before[first] = START
    begun = np.flatnonzero(first)
    bigram = X.mix(X.mix(before) + word) | X.U(1)
    n = len(word)
    keys, at = np.unique(np.concatenate((word, bigram, before[begun])), return_inverse=True)
    head = np.concatenate(([0], at[:n]))[:-1]
    head[begun] = at[2 * n :]
    return Piece(keys, doc, at[:n], at[n : 2 * n], head, begun)


def count_piece(piece: Piece, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key stands in the documents, and in those that are target; START counts the documents with words."""
    at = np.concatenate((piece.word, piece.bigram, piece.head[piece.begun]))
    marked = target[np.concatenate((piece.doc, piece.doc, piece.doc[piece.begun]))]
    return np.bincount(at, minlength=len(piece.keys)), np.bincount(at[marked], minlength=len(piece.keys))


def score_piece(piece: Piece, target: np.ndarray, all_n: np.ndarray, all_t: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, loss under the target model and loss under the background model of each document; all_n and all_t are the keys' counts in the corpus."""
    # each bigram of a document once, with its own count
    code, first, count = np.unique(piece.doc << 32 | piece.bigram, return_index=True, return_counts=True)
    doc, bigram, word, head = code >> 32, code & 0xFFFFFFFF, piece.word[first], piece.head[first]
    mass = MASS_2 * max(1.0, totals.all_n / max(1, totals.all_t))
    p_n = (all_n[word] + 1) / (totals.all_n + totals.distinct + 2)
    p_t = (all_t[word] + MASS_1 * p_n) / (totals.all_t + MASS_1)
    p_n = (all_n[bigram] - count + mass * p_n) / (all_n[head] + mass)
    p_t = (all_t[bigram] - count * target[doc] + MASS_2 * p_t) / (all_t[head] + MASS_2)
    sums = lambda p: np.bincount(doc, -np.log(np.minimum(p, 1)) * count, len(target))
    return np.bincount(piece.doc, minlength=len(target)), sums(p_t), sums(p_n)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, as many as the largest needs."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted keys: ranges of their upper bits."""
    own, cuts = np.unique(((keys >> X.U(32)) * X.U(buckets)) >> X.U(32), return_index=True)
    for b, lo, hi in zip(own.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
        yield b, slice(lo, hi)


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """(block, first rid, texts, target) of consecutive rows of one block, of about ``limit`` bytes; columns block, rid, text, target."""
    parts: list[pa.RecordBatch] = []
    size, block = 0, None

    def joined():
        table = pa.Table.from_batches(parts).combine_chunks()
        return block, table.column("rid")[0].as_py(), table.column("text").combine_chunks(), table.column("target").to_numpy().astype(bool)

    for batch in batches:
        own, sizes, lo = batch.column("block").to_pylist(), pc.binary_length(batch.column("text")).to_pylist(), 0
        for k, (b, n) in enumerate(zip(own, sizes, strict=True)):
            if b != block or size + n > limit:
                if k > lo:
                    parts.append(batch.slice(lo, k - lo))
                if parts:
                    yield joined()
                parts, size, block, lo = [], 0, b, k
            size += n
        if lo < len(batch):
            parts.append(batch.slice(lo))
    if parts:
        yield joined()


def _answers(held: DataFrame, buckets: int, tasks: int, limit: int) -> DataFrame:
    """block, rid, bucket, n, t: the counts in the corpus of a piece's keys in a bucket, in their order; and for each bucket a row with block null and its totals."""
    names = ["bucket", "block", "rid", "keys", "n", "t"]

    def ask(batches):
        for block, rid, texts, target in _pieces(batches, limit):
            piece = read_piece(texts)
            n, t = count_piece(piece, target)
            columns: list[list] = [[] for _ in names]
            for b, s in _slices(piece.keys, buckets):
                for column, value in zip(columns, (b, block, rid, _planes(np.diff(piece.keys[s], prepend=X.U(0))), _planes(n[s]), _planes(t[s])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.binary()) for c in columns[3:])], names=names)

    def added(rows: list[dict]):
        keys = [np.cumsum(_numbers(r["keys"]), dtype=X.U) for r in rows]
        own, at = np.unique(np.concatenate(keys), return_inverse=True)
        all_n, all_t = (np.bincount(at, np.concatenate([_numbers(r[k]) for r in rows]), len(own)).astype(np.int64) for k in ("n", "t"))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        back = [[_planes(v[part]) for part in np.split(at, cuts)] for v in (all_n, all_t)]
        word = (own & X.U(1) == 0) & (own != START)
        sums = [int(word.sum()), int(all_n[word].sum()), int(all_t[word].sum())]
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([*(r[k] for r in rows), None], pa.int64()) for k in ("block", "rid", "bucket")), *(pa.array([*b, None], pa.binary()) for b in back), *(pa.array([None] * n + [s], pa.int64()) for s in sums)],
            names=["block", "rid", "bucket", "n", "t", *Totals._fields],
        )

    def by_bucket(batches):
        rows: list[dict] = []
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if rows and row["bucket"] != rows[0]["bucket"]:
                    yield from added(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from added(rows)

    asked = held.select("block", "rid", "text", "target").mapInArrow(ask, "bucket long, block long, rid long, keys binary, n binary, t binary")
    asked = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return asked.mapInArrow(by_bucket, "block long, rid long, bucket long, n binary, t binary, distinct long, all_n long, all_t long")


def _scored(held: DataFrame, answers: DataFrame, totals: Totals) -> DataFrame:
    """id, n_tokens, loss_t, loss_n of every row: a block's rows in order, the answers to each piece before its first row."""
    kind = held.schema["id"].dataType.simpleString()
    rows = held.select("block", "rid", F.lit(None).cast("long").alias("bucket"), "id", "text", "target", F.lit(None).cast("binary").alias("n"), F.lit(None).cast("binary").alias("t"))
    rows = rows.unionByName(answers.where("block is not null").select("block", "rid", "bucket", "n", "t"), allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", "rid", F.col("bucket").asc_nulls_last())

    def finish(n: list[bytes], t: list[bytes], parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        target = table.column("target").to_numpy().astype(bool)
        piece = read_piece(table.column("text").combine_chunks())
        all_n, all_t = (np.concatenate([np.zeros(0), *map(_numbers, v)]).astype(np.float64) for v in (n, t))
        if len(all_n) != len(piece.keys):
            raise RuntimeError(f"{len(all_n)} counts for {len(piece.keys)} keys")
        words, loss_t, loss_n = score_piece(piece, target, all_n, all_t, totals)
        ids = table.column("id").combine_chunks()
        yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(loss_t), pa.array(loss_n)], names=["id", "n_tokens", "loss_t", "loss_n"])

    def score(batches):
        n, t, parts = [], [], []
        for batch in batches:
            answer = pc.is_valid(batch.column("bucket")).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(answer, prepend=not answer[0])) if len(answer) else np.zeros(0, int)
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(batch)], strict=True):
                own = batch.slice(lo, hi - lo)
                if not answer[lo]:
                    parts.append(own.select(["id", "text", "target"]))
                    continue
                if parts:
                    yield from finish(n, t, parts)
                    n, t, parts = [], [], []
                n += own.column("n").to_pylist()
                t += own.column("t").to_pylist()
        if parts:
            yield from finish(n, t, parts)

    return rows.mapInArrow(score, f"id {kind}, n_tokens long, loss_t double, loss_n double")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of docs: id, n_tokens, ce_target, ce_background, score; ``targets`` has the ids of target documents."""
    marks = targets.select(F.col(id_col).alias("mark")).where("mark is not null").distinct()
    # a hash join deals both sides out without sorting texts, at every size
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(marks.hint("shuffle_hash"), F.col("id") == F.col("mark"), "left")
    rows = rows.select("id", "text", F.col("mark").isNotNull().alias("target")).withColumn("rid", F.monotonically_increasing_id())
    held = stored(rows, "scored")  # the row numbers are fixed from here on
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # rows that stay together: as many as two pieces of usual texts have
    rows_a_block = max(1, 2 * piece * max(1, n) // max(1, size))
    held = held.withColumn("block", F.shiftright("rid", min(32, rows_a_block.bit_length() - 1)))
    tasks = partitions(docs.sparkSession)
    buckets = tasks * max(1, -(-size // (BYTES_A_KEY * bucket_keys * tasks)))
    answers = stored(_answers(held, buckets, tasks, piece), "counts")
    totals = Totals(*answers.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in Totals._fields)).first())
    out = _scored(held, answers, totals)
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(F.lit(0.0))
    return out.select(F.col("id").alias(id_col), "n_tokens", mean("loss_t").alias("ce_target"), mean("loss_n").alias("ce_background"), (mean("loss_t") - mean("loss_n")).alias("score"))
