"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here: pieces with scores and types, the model type, byte
fallback and the normaliser.  From these a ``tokenizers`` model is rebuilt (unigram scores,
or for a BPE model its merges in score order), with the metaspace marker, byte fallback and a
decoder; pieces without a meaning of their own decode as the sentencepiece library decodes them.

No piece of a usual model has the marker after another character, so no merge crosses the
start of a marker run.  Texts are then cut there, each distinct part (known by 64 bits of hash)
is encoded once, by batches on ``THREADS`` threads, and the ids of a text are put together from
those of its parts.  Ids are decoded alike: cut where a marker run starts, each distinct part
once, by batches.  Whole texts are encoded instead where parts would not do: models whose
pieces cross marker runs, without dummy prefix or with a normaliser that changes texts, and
texts that hold the marker character itself.

``parity`` says that the sentencepiece library gave the same ids, and the same text from them:
it is asked for every distinct part, and for every whole text where whole texts are encoded.
Where its ids differ they stand and ``parity`` is false; where its text differs ours stands
and ``parity`` is false; without the library ``parity`` is null.

Null and empty texts have no ids.  Each row gives one row, repeated rows and null ids too;
empty tables give none; other columns are ignored, whatever their names.  Special-token
strings are ordinary text.  A literal marker character decodes as a space, as in the library,
so ``round_trip`` is false for such texts.  Memory follows the longest text of a batch.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct parts that a worker remembers before it starts anew.
CACHE = 1 << 19
#: Bytes of text that are put together at once.
BLOCK = 2 << 20
#: Threads of a batch; more spend their time waiting for each other.
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Spec(NamedTuple):
    pieces: list[tuple[str, float, int]]
    model_type: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or (varint() if wire == 2 else 0)
            if not size and wire != 2:
                raise ValueError(f"wire type {wire} in a model file")
            yield number, raw[at : at + size]
            at += size


def parse_model(raw: bytes) -> Spec:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    return Spec(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def _merges(spec: Spec) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score first."""
    score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER)}
    found = [(-score[p], len(p[:k]), p[:k], p[k:]) for p in score for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: x[:2])]


def build_tokenizer(spec: Spec):
    """A ``tokenizers.Tokenizer`` with the model's normaliser and decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), None)
    if spec.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback)
    elif spec.model_type == BPE:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, _merges(spec), unk_token=None if unknown is None else spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([*_spoken(spec), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    return tokenizer


def _spoken(spec: Spec) -> list:
    """Decoders of pieces that do not decode as they are written."""
    from tokenizers import decoders

    written = [p for p, _, kind in spec.pieces if kind in (NORMAL, USER)]
    odd = [(p, " ⁇ " if kind == UNKNOWN else "") for p, _, kind in spec.pieces if kind in (UNKNOWN, CONTROL)]
    return [decoders.Replace(p, said) for p, said in odd if not any(p in w for w in written)]


def _ragged(offs: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the items ``offs[i]:offs[i + 1]`` for each i of index, end to end, and the offsets of the result."""
    sizes = offs[index + 1] - offs[index]
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offs[index] - (ends - sizes), sizes), np.concatenate(([0], ends))


class _Known:
    """Arrays by 64-bit hash."""

    def __init__(self, dtype: str):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.hashes, self.entry = np.zeros(0, X.U), np.zeros(0, np.int64)
        self.flat, self.offs, self.wrong = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, bool)

    def unknown(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the sorted distinct hashes have no entry; makes room for them."""
        found = X.lookup(self.hashes, hashes) < 0
        if len(self.hashes) + found.sum() > CACHE and len(self.hashes):
            self.clear()
            found[:] = True
        return np.flatnonzero(found)

    def add(self, hashes: np.ndarray, values: list[bytes], wrong: list[bool]) -> None:
        """Sorted hashes and what they stand for."""
        size = np.dtype(self.dtype).itemsize
        at = np.searchsorted(self.hashes, hashes)
        entries = len(self.wrong) + np.arange(len(hashes))
        self.hashes, self.entry = np.insert(self.hashes, at, hashes), np.insert(self.entry, at, entries)
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(values), self.dtype)))
        self.offs = np.concatenate((self.offs, self.offs[-1] + np.cumsum([len(v) // size for v in values], dtype=np.int64)))
        self.wrong = np.concatenate((self.wrong, np.array(wrong, bool)))

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        return self.entry[X.lookup(self.hashes, hashes)]


class Codec:
    """Encodes and decodes blocks of texts."""

    def __init__(self, raw: bytes, parity: bool = True):
        from tokenizers import Tokenizer, decoders

        self.spec = parse_model(raw)
        self.tokenizer = build_tokenizer(self.spec)
        # parts are normalised already, and keep their leading space
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.decoder = decoders.Sequence([*_spoken(self.spec), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.library = None
        if parity:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        crosses = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.spec.pieces if kind in (NORMAL, USER))
        self.by_part = self.spec.dummy_prefix and not self.spec.charsmap and not self.spec.squeeze and not crosses
        self.marked = np.array([kind in (NORMAL, USER) and p.startswith(MARK) for p, _, kind in self.spec.pieces])
        self.blank = np.array([kind in (NORMAL, USER) and not p.strip(MARK) for p, _, kind in self.spec.pieces])
        self.ids, self.texts = _Known("<i4"), _Known("u1")

    def _library_ids(self, parts: list[str]) -> list[list[int]]:
        """Of parts that start with a space, which the library adds itself.  A space alone would be an empty text, so it is asked for after another part."""
        found = self.library.encode([p[1:] or "a " for p in parts], num_threads=1)
        before = len(self.library.encode("a"))
        return [ids if len(p) > 1 else ids[before:] for p, ids in zip(parts, found, strict=True)]

    def _encode_parts(self, parts: list[str]) -> tuple[list[bytes], list[bool]]:
        found = [e.ids for e in self.plain.encode_batch_fast([p.replace(" ", MARK) for p in parts], add_special_tokens=False)]
        other = self._library_ids(parts) if self.library else found
        return [array("i", ids).tobytes() for ids in other], [a != b for a, b in zip(found, other, strict=True)]

    def _encode_whole(self, texts: list[str]) -> list[tuple[np.ndarray, bool | None]]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not self.library:
            return [(np.array(ids, "<i4"), None) for ids in found]
        return [(np.array(o, "<i4"), ids == o) for ids, o in zip(found, self.library.encode(texts, num_threads=1), strict=True)]

    def encode_block(self, block: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their offsets by text, and whether the library's ids differ."""
        data, offs, n = block.data, block.offs, block.hi - block.lo
        whole = np.full(n, not self.by_part)
        if self.by_part and len(data) > 2:
            mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            whole[np.searchsorted(offs, mark, "right") - 1] = True
        # a space before each text, which begins its first part
        sizes = np.where(whole, 0, np.diff(offs))
        take, begin = _ragged(offs, np.flatnonzero(sizes)) if sizes.any() else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        spaced = np.insert(data[take], begin[:-1], 0x20)
        begin = begin + np.arange(len(begin))
        space = spaced == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[begin[:-1]] = True
        start = np.flatnonzero(start)
        end = np.append(start, len(spaced))[1:]
        hashes = X.range_hash(X.prefix_hash(spaced), start, end)
        own, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        if len(fresh := self.ids.unknown(own)):
            raw = spaced.tobytes()
            self.ids.add(own[fresh], *self._encode_parts([raw[start[k] : end[k]].decode() for k in first[fresh]]))
        entry = self.ids.entries(own)[at] if len(own) else np.zeros(0, np.int64)
        places, upto = _ragged(self.ids.offs, entry)
        flat = self.ids.flat[places]
        cuts = np.zeros(n + 1, np.int64)
        parts = np.searchsorted(start, begin)  # parts before each text that has some
        cuts[1:][sizes > 0] = np.diff(upto[parts])
        cuts = np.cumsum(cuts)
        wrong = np.zeros(n, bool)
        bad = np.flatnonzero(self.ids.wrong[entry])
        wrong[np.flatnonzero(sizes)[np.searchsorted(parts, bad, "right") - 1]] = True
        if whole.any():
            raw, where = data.tobytes(), np.flatnonzero(whole)
            done = dict(zip(where.tolist(), self._encode_whole([raw[offs[k] : offs[k + 1]].decode() for k in where]), strict=True))
            every = [done[k][0] if k in done else flat[cuts[k] : cuts[k + 1]] for k in range(n)]
            flat, cuts = np.concatenate(every), np.concatenate(([0], np.cumsum([len(e) for e in every])))
            wrong[where] = [same is False for _, same in done.values()]
        return flat, cuts, wrong

    def _decode_parts(self, parts: list[list[int]]) -> tuple[list[bytes], list[bool]]:
        said = self.plain.decode_batch(parts, skip_special_tokens=False)
        other = self.library.decode(parts) if self.library else said
        # the library drops the space of the dummy prefix
        return [t.encode() for t in said], [a != b and a != " " + b for a, b in zip(said, other, strict=True)]

    def decode_block(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all texts, their offsets by text, and whether the library's texts differ."""
        if not self.by_part:
            lists = [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            said = self.tokenizer.decode_batch(lists, skip_special_tokens=False)
            wrong = [a != b for a, b in zip(said, self.library.decode(lists), strict=True)] if self.library and lists else [False] * len(lists)
            raw = [t.encode() for t in said]
            return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))), np.array(wrong, bool)
        some = np.flatnonzero(np.diff(offs))
        start = self.marked[ids]
        start[1:] &= ~self.blank[ids[:-1]]
        start[offs[some]] = True
        start = np.flatnonzero(start)
        end = np.append(start, len(ids))[1:]
        hashes = X.range_hash(X.prefix_hash(ids), start, end)
        own, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        if len(fresh := self.texts.unknown(own)):
            self.texts.add(own[fresh], *self._decode_parts([ids[start[k] : end[k]].tolist() for k in first[fresh]]))
        entry = self.texts.entries(own)[at] if len(own) else np.zeros(0, np.int64)
        places, upto = _ragged(self.texts.offs, entry)
        flat = self.texts.flat[places]
        cuts = np.append(upto, upto[-1])[np.searchsorted(start, offs)]
        wrong = np.zeros(len(offs) - 1, bool)
        wrong[np.searchsorted(offs, start[self.texts.wrong[entry]], "right") - 1] = True
        # the space of the dummy prefix
        head = cuts[:-1][np.diff(cuts) > 0]
        drop = head[flat[head] == 0x20]
        return np.delete(flat, drop), cuts - np.searchsorted(drop, cuts), wrong

    def round_trip(self, block: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool | None]]:
        """Ids and their offsets, the bytes decoded from them and their offsets, and parity of both."""
        ids, offs, wrong = self.encode_block(block)
        text, cuts, other = self.decode_block(ids, offs)
        return ids, offs, text, cuts, [None] * len(wrong) if self.library is None else (~(wrong | other)).tolist()

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for block in X.blocks(pa.array(texts, pa.string()), BLOCK):
            ids, offs, _ = self.encode_block(block)
            out += [x.tolist() for x in np.split(ids, offs[1:-1])]
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        if not ids:
            return []
        text, cuts, _ = self.decode_block(np.array([x for i in ids for x in i], "<i4"), np.concatenate(([0], np.cumsum([len(i) for i in ids]))))
        return [x.tobytes().decode() for x in np.split(text, cuts[1:-1])]


@functools.lru_cache(maxsize=1)
def shared_codec(raw: bytes) -> Codec:
    """The codec of this process: tasks that a worker runs one after another use one model and one cache."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    return Codec(raw)


def _by_blocks(docs: DataFrame, id_col: str, text_col: str, model: str, schema: str, make) -> DataFrame:
    """make(block, ids, offs, text, cuts) gives the columns between id and parity."""
    with open(model, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in schema.split(", ")), "parity"]

    def run(batches):
        codec = shared_codec(raw.value)
        for batch in batches:
            for block in X.blocks(batch.column(1), BLOCK):
                *done, parity = codec.round_trip(block)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), *make(block, *done), pa.array(parity, pa.bool_())], names=names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, {schema}, parity boolean")
    return out.withColumnRenamed("id", id_col)


def _texts(raw: np.ndarray, offs: np.ndarray) -> list[memoryview]:
    held = memoryview(np.ascontiguousarray(raw)).cast("B")
    size = raw.itemsize
    return [held[size * a : size * b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def sentencepiece_codec(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: id, token_ids array<int>, decoded string, parity boolean."""

    def make(block, ids, offs, text, cuts):
        lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
        return lists, pa.array([str(t, "utf-8") for t in _texts(text, cuts)], pa.string())

    return _by_blocks(docs, id_col, text_col, model, "token_ids array<int>, decoded string", make)


def codec_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: n_bytes, n_tokens, ids_sha256 (ids as little-endian int32), decoded_sha256, round_trip, parity.

    The digests are taken where the ids are made, so the ids themselves do not travel.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def make(block, ids, offs, text, cuts):
        own, back = _texts(block.data, block.offs), _texts(text, cuts)
        return pa.array(np.diff(block.offs)), pa.array(np.diff(offs)), pa.array(map(sha, _texts(ids, offs)), pa.string()), pa.array(map(sha, back), pa.string()), pa.array([a == b for a, b in zip(own, back, strict=True)], pa.bool_())

    return _by_blocks(docs, id_col, text_col, model, "n_bytes long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean", make)
