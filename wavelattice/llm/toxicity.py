"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are smoothed by absolute discounting; both
back off to one distribution, made of the counts that the discount took from both classes, so
an expression too rare to be known in one class does not speak for the other.  A document is
read by the gains of its words: the log-likelihood of each under the toxic model less that
under the ordinary one.

Three readings of the gains go through a logistic calibration on training documents that the
counts have not seen: their mean (the length-normalised comparison), the mean of those beyond
``MARKED`` alone, and the clipped sum of these, which is not normalised by length.  The mean by
itself does not do: a few toxic words in a long text hardly move it (README has the figures).
For the same reason counts at both orders are continuation counts (after how many different
words an expression stands, so a passage that many documents copy counts once) and the
discount is larger than the usual one.

Labels are learnt from rows whose crc32(id as text) modulo ``FOLDS`` is not 0.  The training
documents are a bounded sample of these: in order of a hash of the id, at most
``MAX_CLASS_DOCS`` a class and ``MAX_CLASS_BYTES`` of whole texts, the same size for both
classes.  A text that does not fit is passed over, but two of a class are always taken.  The bound keeps the models small enough to broadcast at any corpus size.

A document labelled twice is toxic if one label says so; null labels are not learnt from.
Null and empty texts score the calibration's constant; a null id counts as the text '' and is
held out.  Each row gives one row, repeated rows too; empty tables give none.  Without labelled
rows of both classes every score is 0.5.  Scores depend on the text alone; other columns are
ignored, whatever their names.  Memory follows the longest text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

FOLDS = 5
MAX_CLASS_DOCS = 3000
MAX_CLASS_BYTES = 5 << 20
#: Of the training documents every such one calibrates and is not counted.
CALIBRATE = 3
CLIP = 6.0
#: Absolute discount: a count up to it goes to the shared backoff entirely, so a rare expression speaks for neither class.
DISCOUNT = 5.0
#: Gains beyond it mark an expression; smaller ones are mostly a matter of topic.
MARKED = 1.5


class Counts(NamedTuple):
    """Sorted keys with a count for each class (column 1 toxic)."""

    keys: np.ndarray
    counts: np.ndarray


class Model(NamedTuple):
    words: np.ndarray
    word_gain: np.ndarray
    backoff_gain: np.ndarray
    pairs: np.ndarray
    pair_gain: np.ndarray
    unknown: float
    weights: np.ndarray


def tokens(block: X.Block) -> tuple[X.Words, np.ndarray]:
    low = X.lowered(block)
    words = X.find_words(low, X.ALNUM_WORD)
    return words, X.word_hashes(low, words)


def _pairs(words: X.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each bigram inside a document and the index of its first word."""
    first = np.flatnonzero(X.same_doc(words.doc, 2))
    return X.gram_hashes(hashes, 2)[first] if len(hashes) > 1 else np.zeros(0, X.U), first


def _count(keys: list[np.ndarray], contexts: list[np.ndarray], labels: list[np.ndarray]) -> Counts:
    """After how many different words of each class's texts a key stands: copied passages count once."""
    key, label = np.concatenate(keys), np.concatenate(labels)
    mark = X.mix(np.concatenate(contexts) + X.mix(key)) ^ X.mix(label.astype(X.U) + X.U(1))
    once = np.unique(mark, return_index=True)[1]
    every, at = np.unique(key[once], return_inverse=True)
    return Counts(every, np.stack([np.bincount(at[label[once] == c], minlength=len(every)) for c in (0, 1)], axis=1))


def fit_counts(texts: list[str], labels: np.ndarray) -> Model:
    """The models' log-likelihood gains (toxic less ordinary); no calibration yet."""
    parts: list[list[np.ndarray]] = [[] for _ in range(7)]
    for block in X.blocks(pa.array(texts, pa.string())):
        words, hashes = tokens(block)
        label = labels[block.lo : block.hi][words.doc]
        before = np.where(np.concatenate(([False], words.doc[1:] == words.doc[:-1])), np.roll(hashes, 1), X.U(0)) if len(hashes) else hashes
        key, first = _pairs(words, hashes)
        for part, values in zip(parts, (hashes, before, label, key, before[first], label[first], np.stack((hashes[first], hashes[first + 1]), axis=1)), strict=True):
            part.append(values)
    one = _count(*parts[:3])
    two = _count(*parts[3:6])
    # each distinct bigram once: its head and tail
    where = np.unique(np.concatenate(parts[3]), return_index=True)[1]
    head, tail = X.lookup(one.keys, np.concatenate(parts[6])[where].ravel()).reshape(-1, 2).T
    n_words = len(one.keys)
    def discounted(counts: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of each count after the discount, in its context, and what each context leaves to the backoff."""
        cut = np.minimum(counts, DISCOUNT)
        return (counts - cut) / np.maximum(total, 1), cut

    own, cut = discounted(one.counts, one.counts.sum(0))
    # what the discount took in either class, pooled: the shared backoff counts, with room for an unknown word
    back = (cut.sum(0) + 1) / np.maximum(one.counts.sum(0), 1)
    shared = (cut.sum(1) + 1.0) / (cut.sum() + n_words + 1.0)
    p_word = own + back * shared[:, None]
    sums = lambda v: np.stack([np.bincount(head, v[:, c], n_words) for c in (0, 1)], axis=1)
    context = sums(two.counts)
    own, cut = discounted(two.counts, context[head])
    back2 = np.where(context > 0, sums(cut) / np.maximum(context, 1), 1.0)
    p_pair = own + back2[head] * p_word[tail]
    gain = lambda p: (np.log(p[:, 1]) - np.log(p[:, 0])).clip(-CLIP, CLIP).astype(np.float32)
    unknown = float(np.log(back[1]) - np.log(back[0]))
    return Model(one.keys, gain(p_word), gain(back2), two.keys, gain(p_pair), unknown, np.zeros(4))


def gains(model: Model, block: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood gain per word, sum of the words' gains beyond MARKED, and number of words of each document."""
    words, hashes = tokens(block)
    n_docs = len(block.offs) - 1
    at = X.lookup(model.words, hashes)
    value = np.where(at >= 0, model.word_gain[at], model.unknown) if len(model.words) else np.zeros(len(hashes))
    key, first = _pairs(words, hashes)
    if len(key) and len(model.pairs):
        pair, head = X.lookup(model.pairs, key), at[first]
        value[first + 1] = np.where(pair >= 0, model.pair_gain[pair], value[first + 1] + np.where(head >= 0, model.backoff_gain[head], 0))
    n = np.diff(words.offs)
    marked = np.where(np.abs(value) > MARKED, value, 0)
    return np.bincount(words.doc, value, n_docs) / np.maximum(n, 1), np.bincount(words.doc, marked, n_docs), n


def _features(mean: np.ndarray, marked: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The gain per word, that of the marked words alone, and how far they speak for a class in the whole text."""
    return np.stack([mean, 10 * marked / np.maximum(n, 1), np.clip(marked, -8, 8) / 4, np.ones(len(mean))], axis=1)


def scores(model: Model, block: X.Block) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(*gains(model, block)) @ model.weights, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """Counts from most of the texts, calibration from the others; share: of label 1 among all labels."""
    held = np.arange(len(texts)) % CALIBRATE == 0
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        if held[own].all() or not held[own].any():
            held[own] = np.arange(len(own)) % CALIBRATE == 0
    if len({*labels[held].tolist()}) < 2 or len({*labels[~held].tolist()}) < 2:
        none = np.zeros(0, X.U)
        return Model(none, none, none, none, none, 0.0, np.zeros(4))
    model = fit_counts([t for t, h in zip(texts, held, strict=True) if not h], labels[~held])
    own = [gains(model, b) for b in X.blocks(pa.array([t for t, h in zip(texts, held, strict=True) if h], pa.string()))]
    x, y = _features(*(np.concatenate(p) for p in zip(*own, strict=True))), labels[held]
    # the sample is balanced; the weights bring back the classes' shares
    weight = np.where(y == 1, share, 1 - share) / np.where(y == 1, y.mean(), 1 - y.mean())
    w = np.zeros(4)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * w
        hess = (x.T * (weight * p * (1 - p))) @ x + 1e-3 * np.eye(4)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return model._replace(weights=w)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray, float]:
    """Whole texts of the sample, their labels, and the share of label 1 among all rows that may be learnt from."""
    docs = docs.select(id_col, text_col)
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    known = labels.where((fold != 0) & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(MAX_CLASS_DOCS)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumnRenamed(id_col, "of")
    # 2 * MAX_CLASS_DOCS ids at most
    held = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("of")).select("of", "y", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sized = held.select("of", "y", F.octet_length("text").alias("n"), F.xxhash64("of").alias("h")).dropDuplicates(["of"]).collect()
    take, size = [], min(sum(min(r.n, MAX_CLASS_BYTES) for r in sized if r.y == y) for y in (0, 1)) if sized else 0
    for y in (0, 1):
        left, own, long = min(size, MAX_CLASS_BYTES), [], []
        for r in sorted((r for r in sized if r.y == y), key=lambda r: (r.h, r.of)):
            if r.n <= left:
                own.append(r.of)
                left -= r.n
            else:
                long.append(r)
        # one to count and one to calibrate, however long
        long.sort(key=lambda r: (r.n, r.h, r.of))
        take += own + [r.of for r in long[: max(0, 2 - len(own))]]
    rows = held.where(F.col("of").isin(take)).dropDuplicates(["of"]).withColumn("h", F.xxhash64("of")).collect() if take else []
    rows.sort(key=lambda r: (r.h, r.of))
    return [r.text for r in rows], np.array([r.y for r in rows], np.int64), float(share)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: id, held_out, score, predicted, gain (per word), n_words."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(fit(*training_rows(docs, labels, id_col, text_col, label_col)))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            for block in X.blocks(batch.column(1)):
                mean, marked, n = gains(known.value, block)
                p = 1 / (1 + np.exp(-np.clip(_features(mean, marked, n) @ known.value.weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), pa.array(p), pa.array(mean.astype(np.float64)), pa.array(n, pa.int64())], names=["id", "score", "gain", "n_words"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"id {kind}, score double, gain double, n_words long")
    fold = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return rows.select(F.col("id").alias(id_col), (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "gain", "n_words")
