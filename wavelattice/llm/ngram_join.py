"""Near duplicates by an n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct ``SHINGLE``-word shingles.  Shingles are
ordered by how many documents hold them (a signed count sketch of fixed size over all
documents, whose error grows with the root of their number; any order is right, rare first is
fast).  If two sets are similar, their prefixes of length ``n - overlap + l`` share at least
``l`` shingles; each document takes the ``l`` for which the estimated cost of its prefix,
postings to read and candidates to verify, is least, and its candidates must share that many
before their whole texts are compared.

Equal sets are one node.  Of a shingle's postings only those with another node are kept.
Groups of near copies are first gathered around hubs: each node is compared with the node
that most of its shingles name, which links a large group with as many comparisons as it has
members.  Only candidates in different components are left for the join itself; there each
pair has a member outside its shingle's largest component, so no group is paired with itself.
The join meets only postings that can be a pair's first common shingle: a shingle so deep in a
set that too little follows it for partners of some size is not filed for that size.

Lower-casing is of A-Z; words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words than a shingle
has its whole sequence as one shingle.  A text without words, or null, is linked with nothing.
Rows with the same id and different texts are separate; a null id is never a component's name
unless all its ids are null.  Every row gives one row, repeated rows too; empty tables give
none; other columns are ignored, whatever their names.  Memory follows the longest text.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._components import connected_components
from ._shared import drop, partitions, stored

SHINGLE = 5
PERCENT = 80
MAX_MATCHES = 4
#: Cells of the count sketch, and rows it is cut into.
CELLS, SLICES = 1 << 22, 64
#: Shingles of whole sets for each bucket of postings, or about so many; a task has several buckets, one at a time.
BUCKET_SHINGLES = 4 << 20
#: Sizes of sets that are filed together grow by this factor.
SIZE_STEP = 1.05
#: Members compared with one copy of their hub's text.
HUB_MEMBERS = 256
#: After the first, hub rounds go on while shingles' lists hold so many times as many pairs as postings.
PAIRS_PER_POSTING, HUB_ROUNDS = 100, 4


def shingle_sets(block: X.Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, end to end, with offsets by document."""
    low = X.lowered(block)
    words = X.find_words(low)
    hashes = X.word_hashes(low, words)
    whole = np.flatnonzero(X.same_doc(words.doc, SHINGLE))
    grams, doc = X.gram_hashes(hashes, SHINGLE)[whole] if len(whole) else np.zeros(0, X.U), words.doc[whole]
    n = np.diff(words.offs)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        alone = [X.mix(X.gram_hashes(hashes[words.offs[d] : words.offs[d + 1]], int(n[d])) + X.U(int(n[d])))[0] for d in short]
        grams, doc = np.concatenate((grams, np.array(alone, X.U))), np.concatenate((doc, short))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(n) + 1))


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    upto = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return upto[offs[1:]] - upto[offs[:-1]]


def set_names(grams: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    return _sums(X.mix(grams), offs), _sums(X.mix(grams ^ X.U(0xA5A5A5A5A5A5A5A5)), offs)


def _cell(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of the sketch and sign of each shingle."""
    return (grams & X.U(CELLS - 1)).astype(np.int64), 1 - 2 * (grams >> X.U(63)).astype(np.int32)


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, h1, h2 of every row; and rows with the parts of the tasks' sketches (slice, sketch)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n", "h1", "h2", "slice", "sketch"]

    def describe(batches):
        cells, id_type = np.zeros(CELLS, np.int32), None
        for batch in batches:
            id_type = batch.column(0).type
            for block in X.blocks(batch.column(1)):
                grams, offs = shingle_sets(block)
                np.add.at(cells, *_cell(grams))
                h1, h2 = set_names(grams, offs)
                k = block.hi - block.lo
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, k), pa.array(np.diff(offs), pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if id_type is not None:
            parts = [zlib.compress(c.tobytes(), 1) for c in cells.reshape(SLICES, -1)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, id_type), none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(describe, f"id {kind}, n long, h1 long, h2 long, slice int, sketch binary"), "sets")


def _sketch(described: DataFrame) -> np.ndarray:
    """The sum of the tasks' sketches: CELLS numbers, whatever the input's size; added up in two steps, so that no task reads more than the root of their number."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = np.frombuffer(zlib.decompress(part.as_py()), np.int32).astype(np.int64)
                held[k] = held[k] + cells if k in held else cells
        # beyond the bounds a shingle is as frequent as can be
        parts = [zlib.compress(v.clip(-0x7FFFFFFF, 0x7FFFFFFF).astype(np.int32).tobytes(), 1) for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "sketch"])

    rows = described.where("slice is not null").select("slice", "sketch")
    fan = max(1, math.isqrt(rows.select("slice").count() // SLICES))
    for keys in ((["slice", F.pmod(F.monotonically_increasing_id(), F.lit(fan))], ["slice"]) if fan > 1 else (["slice"],)):
        rows = rows.repartition(*keys).mapInArrow(add, "slice int, sketch binary")
    out = np.zeros((SLICES, CELLS // SLICES), np.int32)
    for k, part in rows.collect():  # SLICES rows
        out[k] = np.frombuffer(zlib.decompress(part), np.int32)
    return out.ravel()


def _up(top, bottom):
    return -(-top // bottom)


def _whole(top, bottom):
    """``_up`` for columns."""
    return F.ceil(top / bottom)


def probe_length(n, matches, up=_up):
    """Prefix of a set that meets sets up to its own size."""
    return n - up(PERCENT * n, 100) + matches


def index_length(n, matches, up=_up):
    """Prefix of a set that is met by sets of its size or more."""
    return n - up(2 * PERCENT * n, 100 + PERCENT) + matches


def choose_prefix(grams: np.ndarray, offs: np.ndarray, sketch: np.ndarray, noise: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of each set's shingles (an index array), their ranks, and the matches each set asks for."""
    n = np.diff(offs)
    doc = np.repeat(np.arange(len(n)), n)
    cell, sign = _cell(grams)
    often = np.maximum(sketch[cell].astype(np.int64) * sign, 0)
    order = np.lexsort((grams, often, doc))
    rank = np.arange(len(grams)) - offs[doc]
    # the usual load of a cell says nothing about a shingle
    excess = np.maximum(often[order] - 2 * noise - 1, 0)
    upto = np.concatenate(([0], np.cumsum(excess)))
    best, matches = None, np.ones(len(n), np.int64)
    for m in range(1, MAX_MATCHES + 1):
        length = np.minimum(probe_length(n, m), n)
        postings = upto[offs[:-1] + length] - upto[offs[:-1]]
        cost = postings + length + (n / 8 + 1) * postings / m
        better = np.ones(len(n), bool) if best is None else (cost < best) & (m <= -(-PERCENT * n // 100))
        best = cost if best is None else np.where(better, cost, best)
        matches = np.where(better, m, matches)
    return order, rank, matches


def _postings(docs: DataFrame, text_col: str, sketch: np.ndarray, tasks: int, buckets: int) -> DataFrame:
    """Prefix postings with another node: token, h1, h2, n, matches, rank."""
    known = docs.sparkSession.sparkContext.broadcast(sketch)
    noise = int(np.median(np.abs(sketch)))
    packed = ["tokens", "doc", "rank", "h1", "h2", "n", "matches"]

    def deal(batches):
        for batch in batches:
            for block in X.blocks(batch.column(0)):
                grams, offs = shingle_sets(block)
                h1, h2 = set_names(grams, offs)
                n = np.diff(offs)
                order, rank, matches = choose_prefix(grams, offs, known.value, noise)
                doc = np.repeat(np.arange(len(n)), n)
                # copies within the block post once
                first = np.zeros(len(n), bool)
                first[np.unique(X.mix(h1) ^ h2, return_index=True)[1]] = True
                keep = (rank < np.maximum(probe_length(n, matches), index_length(n, MAX_MATCHES))[doc]) & first[doc]
                token, doc, rank = grams[order][keep], doc[keep], rank[keep]
                bucket = ((token >> X.U(32)) % X.U(buckets)).astype(np.int64)
                by = np.lexsort((token, bucket))
                token, doc, rank, bucket = token[by], doc[by], rank[by], bucket[by]
                own, cuts = np.unique(bucket, return_index=True)
                columns: list[list] = [[] for _ in range(len(packed) + 1)]
                for b, lo, hi in zip(own.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(token)], strict=True):
                    there, at = np.unique(doc[lo:hi], return_inverse=True)
                    for column, value in zip(columns, (b, token[lo:hi].tobytes(), at.astype("<u4").tobytes(), rank[lo:hi].astype("<u4").tobytes(), h1[there].tobytes(), h2[there].tobytes(), n[there].astype("<u4").tobytes(), matches[there].astype("u1").tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", *packed])

    def shared(rows: list[dict]):
        kinds = dict(zip(packed, (X.U, "<u4", "<u4", X.U, X.U, "<u4", "u1"), strict=True))
        part = lambda name: [np.frombuffer(r[name], kinds[name]) for r in rows]
        sizes = [len(x) for x in part("h1")]
        base = np.repeat(np.cumsum(sizes) - sizes, [len(x) for x in part("tokens")])
        token, doc, rank = (np.concatenate(part(k)) for k in packed[:3])
        table = {k: np.concatenate(part(k)) for k in packed[3:]}
        # one number for each node, the same for copies in other blocks
        node = np.unique(X.mix(table["h1"]) ^ table["h2"], return_index=True, return_inverse=True)
        doc = node[2][doc.astype(np.int64) + base]
        order = np.lexsort((doc, token))
        token, doc, rank = token[order], doc[order], rank[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        token, doc, rank = token[new], doc[new], rank[new]
        twin = np.zeros(len(token), bool)
        same = token[1:] == token[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        token, rank, at = token[twin], rank[twin], node[1][doc[twin]]
        for lo in range(0, len(token), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            values = (token[s].view(np.int64), table["h1"][at[s]].view(np.int64), table["h2"][at[s]].view(np.int64), table["n"][at[s]].astype(np.int32), table["matches"][at[s]].astype(np.int32), rank[s].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["token", "h1", "h2", "n", "matches", "rank"])

    def gather(batches):
        held, bucket = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket and held:
                    yield from shared(held)
                    held = []
                bucket = row["bucket"]
                held.append(row)
        if held:
            yield from shared(held)

    dealt = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(deal, "bucket int, " + ", ".join(f"{c} binary" for c in packed))
    dealt = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "token long, h1 long, h2 long, n int, matches int, rank int")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; texts: node, text."""
    pairs = pairs.select("a", "b")
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("copies"))
    members = pairs.join(copies, "a").join(texts.withColumnRenamed("node", "b"), "b")
    members = members.select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), "b", "text")
    hubs = copies.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.expr("sequence(0, copies - 1)")).alias("salt"), F.lit(None).cast("long").alias("b"), "text")

    def compare(batches):
        hub, own = None, None
        for batch in batches:
            a, b, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for block in X.blocks(batch.column(2)):
                grams, offs = shingle_sets(block)
                sets += np.split(grams, offs[1:-1])
            out = []
            for x, y, grams in zip(a, b, sets, strict=True):
                if y is None:
                    hub, own = x, grams
                elif x == hub:
                    both = int((X.lookup(own, grams) >= 0).sum())
                    if 100 * both >= PERCENT * (len(own) + len(grams) - both):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = hubs.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(compare, "a long, b long")


def _bounded(postings: DataFrame) -> DataFrame:
    """Postings with cap: a node's size less those shingles of its prefix that no other node's prefix has.

    Another set may hold such a shingle beyond its own prefix, so a cap alone bounds nothing.  But of two
    prefixes one ends first in the order of shingles, and what it shares with the other set stands in the
    other's prefix: the larger of the two caps bounds the overlap.  Shingles of one node, or only of nodes
    whose caps are too small for their sizes, are left out.
    """
    length = F.least("n", F.greatest(probe_length(F.col("n"), F.col("matches"), _whole), index_length(F.col("n"), MAX_MATCHES, _whole)))
    caps = postings.groupBy("node").agg((F.first("n") - (F.first(length) - F.count("*"))).cast("int").alias("cap"))
    rows = postings.join(caps, "node")
    enough = F.max(100 * F.col("cap") >= PERCENT * F.col("n"))
    open_ = rows.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y"), enough.alias("enough")).where("x <> y and enough").select("token")
    return rows.join(open_, "token")


def _may_match(a: str, b: str) -> Column:
    """Whether sizes and caps (columns with these prefixes) allow similarity."""
    both = F.col(f"{a}n") + F.col(f"{b}n")
    sizes = 100 * F.least(f"{a}n", f"{b}n") >= PERCENT * F.greatest(f"{a}n", f"{b}n")
    return sizes & ((100 + PERCENT) * F.greatest(f"{a}cap", f"{b}cap") >= PERCENT * both)


def _labelled(postings: DataFrame, links: DataFrame | None) -> DataFrame:
    """Postings with their component; those of shingles within one component are left out."""
    if links is None:
        return postings.withColumn("comp", F.col("node"))
    roots = connected_components(links)
    rows = postings.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    open_ = rows.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    return stored(rows.join(open_, "token"), "postings")


def _majors(rows: DataFrame) -> DataFrame:
    """token, major (its component with most postings), pairs (in different components)."""
    by = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    by = by.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    return by.select("token", F.col("top.comp").alias("major"), ((F.col("all") * F.col("all") - F.col("squares")) / 2).alias("pairs"))


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """Each node with the node, of another component, that most of its shingles name.

    A shingle names the node that shares the most with others: of a text and its edited copies
    that is the text, for edits bring shingles of their own, and it is similar to more of them
    than they are to each other.
    """
    lists = rows.groupBy("token").agg(F.count("*").alias("m"))
    share = rows.join(lists, "token").groupBy("node").agg(F.sum("m").alias("shared"))
    rows = rows.join(share, "node")
    best = F.max(F.struct("shared", *(F.col(c).alias(f"hub_{c}") for c in ("node", "comp", "n", "cap"))))
    hubs = rows.groupBy("token").agg(best.alias("h")).select("token", "h.hub_node", "h.hub_comp", "h.hub_n", "h.hub_cap")
    close = _may_match("", "hub_") & (F.col("comp") != F.col("hub_comp"))
    votes = rows.join(hubs, "token").where(close).groupBy(F.col("node").alias("b"), F.col("hub_node").alias("a")).agg(F.count("*").alias("c"))
    return votes.groupBy("b").agg(F.max(F.struct("c", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")


def _need(a: str, b: str) -> Column:
    """The overlap that sets of these sizes need."""
    return F.ceil(PERCENT * (F.col(a) + F.col(b)) / (100 + PERCENT))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(SIZE_STEP)).cast("int")


def _partner_classes() -> Column:
    """Size classes of the sets with which a posting can be the first common shingle: sizes that allow similarity, and so small that what follows the posting is enough."""
    n, left = F.col("n"), F.col("n") - F.col("rank")
    least = F.ceil(PERCENT * n / 100)
    most = F.least(F.floor(100 * n / PERCENT), F.floor((100 + PERCENT) * left / PERCENT) - n)
    return F.when(most >= least, F.sequence(_size_class(least), _size_class(most))).otherwise(F.array().cast("array<int>"))


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a larger, b smaller) in different components that share as many prefix shingles as the larger set asks for."""
    held = ("node", "comp", "n", "cap", "matches", "rank")
    named = rows.join(_majors(rows).select("token", "major"), "token").withColumn("own", _size_class(F.col("n"))).withColumn("other", F.explode(_partner_classes()))
    left = named.where("comp <> major").select("token", F.col("own").alias("x_class"), F.col("other").alias("y_class"), *(F.col(c).alias(f"x_{c}") for c in held))
    right = named.select("token", F.col("other").alias("x_class"), F.col("own").alias("y_class"), *(F.col(c).alias(f"y_{c}") for c in held), (F.col("comp") == F.col("major")).alias("y_major"))
    need = _need("x_n", "y_n")
    first = (F.col("x_rank") <= F.col("x_n") - need) & (F.col("y_rank") <= F.col("y_n") - need)
    once = (F.col("x_comp") != F.col("y_comp")) & (F.col("y_major") | (F.col("x_node") < F.col("y_node")))
    keys = [left[c] == right[c] for c in ("token", "x_class", "y_class")]
    pairs = left.join(right, keys[0] & keys[1] & keys[2] & once & _may_match("x_", "y_") & first)
    # which member is x may differ from shingle to shingle
    larger = (F.col("x_n") > F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") > F.col("y_node")))
    pick = lambda c, yes: F.when(larger if yes else ~larger, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))
    pairs = pairs.select(pick("node", True).alias("a"), pick("node", False).alias("b"), pick("n", True).alias("a_n"), pick("n", False).alias("b_n"), pick("matches", True).alias("m")).distinct()
    # the pair's own sizes give the overlap it needs, and so shorter prefixes than either needs for all partners
    pairs = pairs.withColumn("need", _need("a_n", "b_n"))
    of = lambda k: rows.select(F.col("node").alias(k), "token", F.col("rank").alias(f"{k}_rank"))
    shared = pairs.join(of("a"), "a").where("a_rank < a_n - need + m").join(of("b"), ["b", "token"]).where("b_rank < b_n - need + m")
    # what follows the last shared shingle bounds the overlap
    rest = F.least(F.first("a_n") - F.max("a_rank"), F.first("b_n") - F.max("b_rank")) - 1
    counted = shared.groupBy("a", "b").agg((F.count("*") >= F.first("m")).alias("enough"), (F.count("*") + rest >= F.first("need")).alias("open"))
    return counted.where("enough and open").select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable by links)."""
    described = _described(docs, id_col, text_col)
    sets = described.where("slice is null").select("id", "n", "h1", "h2")
    nodes = sets.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("least_id"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    tasks, shingles = partitions(docs.sparkSession), sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = tasks * max(1, -(-shingles // (BUCKET_SHINGLES * tasks)))
    postings = _postings(docs, text_col, _sketch(described), tasks, buckets)
    every = stored(postings.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("token", "node", "n", "matches", "rank"), "postings")
    postings = stored(_bounded(every), "postings")
    drop(every)
    # texts of the nodes that have candidates; one row of each
    wanted = postings.select("node").distinct().join(nodes, "node").select("node", "least_id", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    texts = stored(_texts(docs, wanted, id_col, text_col), "texts")

    links = None
    for round_ in range(HUB_ROUNDS):
        rows = _labelled(postings, links)
        if round_:
            pairs, size = _majors(rows).agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0], rows.count()
            if pairs <= PAIRS_PER_POSTING * size:
                break
        found = stored(_verified(_hub_pairs(rows), texts), "verified")
        links = found if links is None else links.unionByName(found)
    else:
        rows = _labelled(postings, links)
    found = stored(_verified(_candidates(rows), texts), "verified")
    links = found if links is None else links.unionByName(found)
    roots = nodes.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = roots.join(names, "root").select("h1", "h2", "n", "component_id")
    drop(postings, texts)
    out = sets.join(named, ["h1", "h2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, text: of the rows with a node's least id, one that has its set."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, F.col("id").eqNullSafe(F.col("least_id")))

    def own(batches):
        # rows that repeat stand in one partition, or in few if it is split; what is left of them does no harm
        seen: set[int] = set()
        for batch in batches:
            keep = []
            for block in X.blocks(batch.column(1)):
                h1, h2 = set_names(*shingle_sets(block))
                s = slice(block.lo, block.hi)
                keep.append((h1.view(np.int64) == batch.column(2).to_numpy()[s]) & (h2.view(np.int64) == batch.column(3).to_numpy()[s]))
            good = np.concatenate(keep) if keep else np.zeros(0, bool)
            for k in np.flatnonzero(good).tolist():
                node = batch.column(0)[k].as_py()
                good[k] = node not in seen
                seen.add(node)
            yield batch.select(["node", "text"]).filter(pa.array(good))

    return rows.select("node", "text", "g1", "g2").mapInArrow(own, "node long, text string")
