"""Routing for operators that find windows of ``width`` consecutive units that occur again.

A unit is a byte or a word.  Of the ``gram``-unit hashes in a window the smallest is its
anchor, so equal windows have equal anchors, and consecutive windows with the same anchor
form a *run*.  Runs whose anchor occurs only once anywhere hold no repeated window and are
left out; nothing else is.  The text of each distinct remaining run (its *body*) goes once
to the shard of its anchor, where a matcher decides which of its windows occur again, and
the answer goes back to all places (*members*) where that body stands.

Equal texts share their runs: they are known by 128 bits of hash, and a body by its anchor
and 64 more.  Runs of an anchor with more than ``HOT_BODIES`` distinct bodies are taken apart:
each of their windows is a body of its own, which goes to the shard of its own hash.  Equal
windows are one body then, whose members are counted by a partial sum, so a shard holds no more
than ``HOT_BODIES`` bodies of an anchor however often a window occurs and in whatever contexts.
Joins are on plain keys without a user's partitioning, so adaptive execution can split those
that are skewed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._shared import drop, split_skew, stored

HOT_BODIES = 20_000
#: Rows that a mapInArrow step returns at once.
ROWS = 1 << 16
SIDE = ("r1", "r2")


class Units(NamedTuple):
    """What a window is made of: values of a block with offsets by document, and how a body is carried."""

    split: Callable[[X.Block], tuple[np.ndarray, np.ndarray]]
    dtype: str


BYTES = Units(lambda block: (block.data, block.offs), "u1")


def _words(block: X.Block) -> tuple[np.ndarray, np.ndarray]:
    words = X.find_words(block)
    return X.word_hashes(block, words), words.offs


WORDS = Units(_words, "<u8")


class Runs(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    body: np.ndarray


def find_runs(values: np.ndarray, offs: np.ndarray, width: int, gram: int) -> Runs:
    """The runs of a block; start counts from the document's first unit."""
    none = np.zeros(0, np.int64)
    if len(values) < width:
        return Runs(none, none, none, none, none)
    prefix = X.prefix_hash(values)
    w = width - gram + 1
    m = len(values) - gram + 1
    grams = X.mix((prefix[gram:] - prefix[:m]) * X.powers(m)[1])
    # the smallest hash, leftmost if tied, of each w grams: minima from both ends of blocks of w
    packed = (grams & X.U(0xFFFFFFFF00000000)) | np.arange(m, dtype=X.U)
    square = np.concatenate((packed, np.full(-m % w, ~X.U(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & X.U(0xFFFFFFFF)).astype(np.int64)
    n_windows = np.maximum(np.diff(offs) - width + 1, 0)
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = offs[doc] + start
    own = anchor[at]
    if not len(own):
        return Runs(none, none, none, none, none)
    head = np.concatenate(([0], np.flatnonzero((own[1:] != own[:-1]) | (doc[1:] != doc[:-1])) + 1))
    count = np.diff(np.append(head, len(own)))
    body = X.range_hash(prefix, at[head], at[head] + count + width - 1)
    return Runs(doc[head], start[head], count, grams[own[head]].view(np.int64), body.view(np.int64))


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (no null), r1, r2: the text's hashes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("r1", F.xxhash64("text")).withColumn("r2", F.xxhash64(F.lit(7), "text"))


def _anchors(rows: DataFrame, units: Units, width: int, gram: int) -> DataFrame:
    """key and place (a hash of text and position) of every run."""

    def run(batches):
        for batch in batches:
            sides = [batch.column(k).to_numpy().view(X.U) for k in (1, 2)]
            for block in X.blocks(batch.column(0)):
                r = find_runs(*units.split(block), width, gram)
                place = X.mix(X.mix(sides[0][block.lo + r.doc] + r.start.astype(X.U)) + sides[1][block.lo + r.doc])
                yield pa.RecordBatch.from_arrays([pa.array(r.key, pa.int64()), pa.array(place.view(np.int64), pa.int64())], names=["key", "place"])

    return rows.select("text", *SIDE).mapInArrow(run, "key long, place long")


def _runs(rows: DataFrame, units: Units, width: int, gram: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for block in X.blocks(batch.column(0)):
                r = find_runs(*units.split(block), width, gram)
                take = pa.array(block.lo + r.doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.key, pa.int64()), pa.array(r.body, pa.int64()), *(batch.column(k).take(take) for k in (1, 2, 3)), pa.array(r.start, pa.int32()), pa.array(r.count, pa.int32())],
                    names=["key", "body", *SIDE, "id", "start", "n"],
                )

    return rows.select("text", *SIDE, "id").mapInArrow(run, f"key long, body long, r1 long, r2 long, id {kind}, start int, n int")


def _hot_windows(rows: DataFrame, members: DataFrame, units: Units, width: int) -> DataFrame:
    """Every window of some members as a member of its own, whose body it is."""
    kind = rows.schema["id"].dataType.simpleString()
    wanted = members.groupBy("id", *SIDE).agg(F.collect_list(F.struct("key", "start", "n")).alias("wanted"))

    def run(batches):
        for batch in batches:
            wanted = batch.column(1)
            for block in X.blocks(batch.column(0)):
                values, offs = units.split(block)
                for d in range(block.hi - block.lo):
                    own, prefix = wanted[block.lo + d].as_py(), X.prefix_hash(values[offs[d] : offs[d + 1]])
                    start = np.concatenate([w["start"] + np.arange(w["n"]) for w in own])
                    keys = np.repeat([w["key"] for w in own], [w["n"] for w in own])
                    side = [batch.column(k).take(pa.array(np.full(len(start), block.lo + d))) for k in (2, 3, 4)]
                    body = X.range_hash(prefix, start, start + width).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(body), *side, pa.array(start, pa.int32()), pa.array(np.ones(len(start)), pa.int32())], names=["key", "body", *SIDE, "id", "start", "n"])

    held = _with_text(rows, wanted).select("text", "wanted", *SIDE, "id")
    out = held.mapInArrow(run, f"key long, body long, r1 long, r2 long, id {kind}, start int, n int")
    return out.dropDuplicates(["key", "body", *SIDE, "start"])  # rows that repeat


def _with_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the texts (id, r1, r2) of wanted."""
    wanted = wanted.withColumnsRenamed({"id": "of", "r1": "q1", "r2": "q2"})
    return rows.join(wanted, (F.col("r1") == F.col("q1")) & (F.col("r2") == F.col("q2")) & F.col("id").eqNullSafe(F.col("of")))


def _bodies(found: DataFrame, units: Units, width: int) -> DataFrame:
    """The body of every wanted run; rows of found: text, id, wanted array<struct>."""
    kind = found.schema["id"].dataType

    def run(batches):
        names = ["shard", "key", "body", "id", "start", "n", "multi", "units"]
        for batch in batches:
            wanted, ids = batch.column(2), batch.column(1)
            for block in X.blocks(batch.column(0)):
                values, offs = units.split(block)
                out: list[list] = [[] for _ in names]
                for d in range(block.hi - block.lo):
                    own = values[offs[d] : offs[d + 1]]
                    ident = ids[block.lo + d].as_py()
                    for w in wanted[block.lo + d].as_py():
                        part = own[w["start"] : w["start"] + w["n"] + width - 1]
                        for column, value in zip(out, (w["body"] if w["alone"] else w["key"], w["key"], w["body"], ident, w["start"], w["n"], w["multi"], part.astype(units.dtype).tobytes()), strict=True):
                            column.append(value)
                    if len(out[0]) >= 4096:
                        yield _batch(out, names, ids.type)
                        out = [[] for _ in names]
                yield _batch(out, names, ids.type)

    return found.select("text", "id", "wanted").mapInArrow(run, f"shard long, key long, body long, id {kind.simpleString()}, start int, n int, multi boolean, units binary")


def _batch(columns: list[list], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"shard": pa.int64(), "key": pa.int64(), "body": pa.int64(), "id": id_type, "multi": pa.bool_(), "units": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int32())) for c, n in zip(columns, names, strict=True)], names=names)


class Shard(NamedTuple):
    """Distinct bodies that share anchors, whole anchors only: units end to end with offsets, windows of each, place of its first member."""

    units: np.ndarray
    offs: np.ndarray
    n: np.ndarray
    id_rank: np.ndarray
    start: np.ndarray
    multi: np.ndarray


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by shard, in tables of about ``limit`` bytes of units, cut between shards."""
    held, size = [], 0
    for batch in batches:
        for lo in range(0, len(batch), 2048):
            part = batch.slice(lo, 2048)
            held.append(part)
            size += part.column("units").nbytes
            if size < limit:
                continue
            table = pa.Table.from_batches(held)
            shard = table.column("shard").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                size = sum(b.column("units").nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _matched(bodies: DataFrame, units: Units, width: int, limit: int, match: Callable[[Shard, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """For each body the windows that occur again: off, len, and whether its first member is spared."""
    kind = bodies.schema["id"].dataType.simpleString()

    def run(batches):
        for table in _shards(batches, limit):
            table = table.combine_chunks()
            both = np.stack([table.column(c).to_numpy() for c in ("key", "body")])
            keep = np.sort(np.unique(both, axis=1, return_index=True)[1])  # repeated rows give a body twice
            table = table.take(pa.array(keep)).combine_chunks()
            raw = [b.as_py() for b in table.column("units")]
            values = np.frombuffer(b"".join(raw), units.dtype)
            offs = np.concatenate(([0], np.cumsum([len(b) for b in raw]))) // values.itemsize
            ids = pc.rank(table.column("id").combine_chunks(), sort_keys="ascending", null_placement="at_start", tiebreaker="dense")
            number = lambda c: table.column(c).to_numpy().astype(np.int64)
            n, multi = number("n"), table.column("multi").to_numpy()
            shard = Shard(values, offs, n, np.asarray(ids).astype(np.int64), number("start"), multi)
            again, spare = match(shard, width)
            # windows body by body, one gap between bodies so that no interval crosses
            body = np.repeat(np.arange(len(n)), n)
            first = np.cumsum(n) - n
            for flags, spared in ((again, False), (spare, True)):
                on = np.flatnonzero(flags)
                if not len(on):
                    continue
                heads = np.concatenate(([0], np.flatnonzero((np.diff(on) != 1) | (np.diff(body[on]) != 0)) + 1))
                lengths = np.diff(np.append(heads, len(on)))
                b = body[on[heads]]
                out = table.take(pa.array(b))
                yield pa.RecordBatch.from_arrays(
                    [*(out.column(c).combine_chunks() for c in ("key", "body", "id", "start")), pa.array(on[heads] - first[b], pa.int32()), pa.array(lengths, pa.int32()), pa.array([spared] * len(b), pa.bool_())],
                    names=["key", "body", "first_id", "first_start", "off", "len", "spared"],
                )

    dealt = bodies.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, f"key long, body long, first_id {kind}, first_start int, off int, len int, spared boolean")


def repeated_windows(rows: DataFrame, units: Units, width: int, gram: int, limit: int, match: Callable) -> tuple[DataFrame, DataFrame]:
    """Windows that occur again, by text: (texts: r1, r2, copies, first_id; spans: r1, r2, spans array<struct<start, len>> of window starts).

    ``rows`` as from ``identified``.  The spans are those of the text's row with the smallest id.
    """
    texts = rows.groupBy(*SIDE).agg(F.count("*").alias("copies"), F.min("id").alias("least_id"), F.count("id").alias("with_id"))
    # a null id sorts before all others
    texts = texts.select(*SIDE, "copies", F.when(F.col("with_id") == F.col("copies"), F.col("least_id")).alias("first_id"))
    keys = _anchors(rows, units, width, gram).groupBy("key").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("key")
    # as a table of its own, so that both sides of the next join are shuffles that can be split
    keys = stored(keys, "anchors")
    members = _runs(rows, units, width, gram).join(keys, "key").groupBy("key", "body", *SIDE, "start", "n").agg(F.min("id").alias("least_id"), F.count("id").alias("with_id"), F.count("*").alias("k"))
    with split_skew(rows.sparkSession):
        members = stored(members.select("key", "body", *SIDE, "start", "n", F.when(F.col("with_id") == F.col("k"), F.col("least_id")).alias("id")), "members")

    # struct order: the first place of a body is that of the smallest id, then the smallest start
    first = lambda m: m.groupBy("key", "body").agg(F.min(F.struct("id", "start", *SIDE, "n")).alias("m"), (F.count("*") > 1).alias("multi")).select("key", "body", "m.*", "multi")
    bodies = stored(first(members).withColumn("alone", F.lit(False)), "bodies")
    made = [members, bodies]
    hot = stored(bodies.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT_BODIES).select("key"), "hot")
    made.append(hot)
    if hot.limit(1).count():
        windows = stored(_hot_windows(rows, members.join(hot, "key"), units, width), "windows")
        made.append(windows)
        members = members.join(hot, "key", "left_anti").unionByName(windows)
        bodies = bodies.join(hot, "key", "left_anti").unionByName(first(windows).withColumn("alone", F.lit(True)))
    wanted = bodies.groupBy("id", *SIDE).agg(F.collect_list(F.struct("key", "body", "start", "n", "multi", "alone")).alias("wanted"))
    held = _with_text(rows, wanted)
    flags = _matched(_bodies(held, units, width), units, width, limit, match)
    places = members.join(flags, ["key", "body"])
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("start") == F.col("first_start"))
    places = places.where(~(F.col("spared") & is_first))
    spans = places.groupBy(*SIDE).agg(F.collect_list(F.struct((F.col("start") + F.col("off")).alias("start"), "len")).alias("spans"))
    spans = stored(spans, "spans")
    drop(keys, *made)
    return texts, spans


def window_starts(spans: list[dict], n_units: int, width: int) -> np.ndarray:
    """Which units a window at one of the starts covers."""
    start = np.array([s["start"] for s in spans], np.int64)
    return X.covered(n_units, start, np.array([s["len"] for s in spans], np.int64) + width - 1)

