"""Binary waveform sets ('WAVE' files, versions 1.0 to 1.6 read, 1.6 written).

A file is a header (see ``schemas.SETS``) and a record for each receive channel; tables hold
one row a channel and transmission (``schemas.RECORDS``, with ``path``).  Complex samples have
their imaginary part in ``im``, which is null for real ones.  Headers are read by seeking, so
no samples are; sets are written row by row, so none is held whole.  Channels of a set that is
written with a number of transmissions may lack some: their samples are NaNs of a pattern of its
own, by which they are left out again when they are read.
"""

from __future__ import annotations

import io
import struct
import uuid
import warnings
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listed, open_file, opened, read_files, seekable, system_of

#: Fixed values of the format: sample types by code.
TYPES = {b"I2": "<i2", b"I4": "<i4", b"I8": "<i8", b"F2": "<f2", b"F4": "<f4", b"F8": "<f8", b"C4": "<c8", b"C8": "<c16"}
CODES = {v[1:]: k for k, v in TYPES.items()}
DEFAULT_TRANSMISSIONS = 10240
#: Bits of a sample (or of each part of a complex one) of a transmission that a channel lacks, by their number; no arithmetic makes such a NaN.
ABSENT = {2: 0x7E57, 4: 0x7FD74156, 8: 0x7FFD574156454E41}


class FormatError(ValueError):
    """A file is not what it should be."""


class Cursor:
    """Reads an open file from its start on."""

    def __init__(self, file):
        self.file = file

    def _bytes(self, size: int) -> bytes:
        out = self.file.read(size)
        if len(out) < size:
            raise EOFError
        return out

    def take(self, layout: str) -> tuple:
        return struct.unpack(layout, self._bytes(struct.calcsize(layout)))

    def values(self, dtype: str, n: int) -> np.ndarray:
        return np.frombuffer(self._bytes(np.dtype(dtype).itemsize * n), dtype)

    def skip(self, dtype: str, n: int) -> None:
        """Pass over values; their last byte must be there."""
        if n:
            self.file.seek(np.dtype(dtype).itemsize * n - 1, io.SEEK_CUR)
            self._bytes(1)


def _parts(dtype: np.dtype) -> int:
    """Bytes of a real number of a type."""
    return dtype.itemsize // (2 if dtype.kind == "c" else 1)


def absent_row(dtype: np.dtype, n: int) -> bytes:
    size = _parts(dtype)
    return np.full(n * dtype.itemsize // size, ABSENT[size], f"<u{size}").tobytes()


def present(block: np.ndarray) -> np.ndarray:
    """Which transmissions (ntx, wl) of a channel are there."""
    if block.dtype.kind == "i" or not block.size:
        return np.ones(len(block), bool)
    size = _parts(block.dtype)
    return (np.ascontiguousarray(block).view(f"<u{size}") != ABSENT[size]).any(axis=1)


def parse_header(data) -> tuple[dict, Cursor]:
    """The header of a file's bytes, or of an open file, and what follows it."""
    c = Cursor(io.BytesIO(data) if isinstance(data, bytes) else data)
    try:
        magic, major, minor = c.take("<4s2I")
    except EOFError:
        raise FormatError("no WAVE header") from None
    if magic != b"WAVE":
        raise FormatError("no WAVE header")
    if major != 1 or minor > 6:
        raise FormatError(f"version {major}.{minor} is unknown")
    head: dict = {"version": f"{major}.{minor}", "minor": minor, "temps": None, "gcount": 0, "gsize": 0, "txstart": 0, "tgc": None, "txlist": None}
    try:
        if minor > 4:
            head["temps"] = c.values("<f4", 2).astype(float).tolist()
        code = c.take("<2s")[0]
        if code not in TYPES:
            raise FormatError(f"sample type {code!r} is unknown")
        head["typecode"] = code.decode()
        head["f2c"], head["nsamp"], head["nrx"], head["ntx"] = c.take("<4I")
        if minor > 1:
            count, size = c.take("<2H")
            if count and not size:
                size = DEFAULT_TRANSMISSIONS // count
                if size * count != DEFAULT_TRANSMISSIONS:
                    raise FormatError(f"{count} groups have no common size")
            head["gcount"], head["gsize"] = count, size if count else 0
            if minor >= 4:
                head["txstart"] = c.take("<I")[0]
            n = 256 if minor < 6 else c.take("<I")[0]
            tgc = c.values("<f4", n).astype(float)
            if n and (minor > 5 or tgc.any()):
                head["tgc"] = tgc.tolist()
        elif minor == 0:
            head["txlist"] = (c.values("<u4", head["ntx"]).astype(int) - 1).tolist()
    except EOFError:
        raise FormatError("the header ends early") from None
    return head, c


def parse_records(head: dict, c: Cursor, duplicates: bool = False, skip_empty: bool = True, strict: bool = True, headers_only: bool = False):
    """(rid, li, gi, position, ws, wl, samples (ntx, wl), or None for headers alone) of each channel; reading stops at the first repeated one unless allowed."""
    minor, dtype, seen, n, running = head["minor"], TYPES[head["typecode"].encode()], set(), 0, -1
    while head["nrx"] == 0 or n < head["nrx"]:
        try:
            if minor == 2:
                running += 1
                rid = running
            else:
                rid = c.take("<I")[0] - (minor < 2)
            if minor > 1:
                li, gi, px, py, pz, ws, wl = c.take("<2I3f2I")
                if minor == 2 and wl == head["nsamp"] and ws == 1:
                    ws = 0
            else:
                (px, py, pz, ws, wl), li, gi = c.take("<3f2I"), 0, 0
            if not duplicates and rid in seen:
                warnings.warn(f"channel {rid} is repeated; the rest is not read", stacklevel=2)
                break
            block = c.skip(dtype, head["ntx"] * wl) if headers_only else c.values(dtype, head["ntx"] * wl).reshape(head["ntx"], wl)
        except EOFError:
            break
        seen.add(rid)
        if wl or not skip_empty:
            n += 1
            yield rid, li, gi, (px, py, pz), ws, wl, block
    if head["nrx"] and n != head["nrx"]:
        if strict:
            raise FormatError(f"the header says {head['nrx']} channels, {n} were read")
        warnings.warn(f"the header says {head['nrx']} channels, {n} were read", stacklevel=2)


_HEAD = ["path", "version", "temps", "typecode", "f2c", "nsamp", "nrx", "ntx", "gcount", "gsize", "txstart", "tgc"]
_HEAD_DDL = "path string, version string, temps array<double>, typecode string, f2c long, nsamp long, nrx long, ntx long, gcount long, gsize long, txstart long, tgc array<double>"


def _files(spark: SparkSession, paths: tuple[str, ...], seek: bool) -> tuple[DataFrame, Callable]:
    """Rows to open, and what opens them: path, file of each row of a batch."""
    if seek and seekable(*paths):
        return listed(spark, *paths), lambda batch: ((p, open_file(p)) for p in batch.column(0).to_pylist())
    return read_files(spark, *paths), lambda batch: ((p, opened(c.as_py())) for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))


def read_sets(spark: SparkSession, *paths: str) -> DataFrame:
    """The files' headers."""
    files, each = _files(spark, paths, True)

    def run(batches):
        for batch in batches:
            heads = [{"path": p, **parse_header(f)[0]} for p, f in each(batch)]
            kinds = [pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), *[pa.int64()] * 7, pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in heads], t) for k, t in zip(_HEAD, kinds, strict=True)], names=_HEAD)

    return files.mapInArrow(run, _HEAD_DDL)


_RECORD = ["path", "rid", "row", "li", "gi", "px", "py", "pz", "ws", "wl", "data", "im"]


def read_records(spark: SparkSession, *paths: str, duplicates: bool = False, skip_empty: bool = True, strict: bool = True, headers_only: bool = False) -> DataFrame:
    """A row a channel and transmission; with headers_only one a channel, with neither row nor samples."""
    kinds = [pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 3, *[pa.int64()] * 2, pa.list_(pa.float64()), pa.list_(pa.float64())]
    files, each = _files(spark, paths, headers_only)

    def run(batches):
        for batch in batches:
            for path, file in each(batch):
                head, c = parse_header(file)
                order = list(head["txlist"] or range(head["ntx"]))
                for rid, li, gi, pos, ws, wl, block in parse_records(head, c, duplicates, skip_empty, strict, headers_only):
                    rows = [None] if block is None else order
                    if block is not None and not (there := present(block)).all():
                        rows, block = [row for row, own in zip(order, there, strict=True) if own], block[there]
                    data = [None] if block is None else list(block.real.astype(float))
                    im = list(block.imag.astype(float)) if block is not None and np.iscomplexobj(block) else [None] * len(rows)
                    own = [[path], [rid], None, [li], [gi], *[[p] for p in pos], [ws], [wl]]
                    arrays = [pa.array(rows if v is None else v * len(rows), t) for v, t in zip(own, kinds[:10], strict=True)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(data, kinds[10]), pa.array(im, kinds[11])], names=_RECORD)

    return files.mapInArrow(run, "path string, rid long, row long, li long, gi long, px double, py double, pz double, ws long, wl long, data array<double>, im array<double>")


def channel_list(records: DataFrame) -> DataFrame:
    """rid, position and group of every channel over all files; a channel that two files have is an error."""
    rows = records.select("path", "rid", "px", "py", "pz", "li", "gi").distinct()
    once = rows.groupBy("rid").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("px", "py", "pz", "li", "gi")))
    return once.select(F.when(F.col("n") == 1, F.col("rid")).otherwise(F.raise_error(F.lit("a channel is in two files")).cast("long")).alias("rid"), "px", "py", "pz", "li", "gi")


def gain_curves(sets: DataFrame) -> DataFrame:
    return sets.select("path", F.posexplode("tgc").alias("k", "tgc"))


def file_header(typecode: str, f2c: int, nsamp: int, nrx: int, ntx: int, groups: tuple[int, int] | None = None, txstart: int = 0, temps: tuple[float, float] | None = None, tgc: list[float] | None = None) -> bytes:
    """The header of a version 1.6 file; no number of channels (0) means all that follow."""
    raw = [struct.pack("<4s2I", b"WAVE", 1, 6), np.array(temps or (np.nan, np.nan), "<f4").tobytes(), struct.pack("<2s4I2HI", typecode.encode(), f2c, nsamp, nrx, ntx, *(groups or (0, 0)), txstart)]
    return b"".join([*raw, struct.pack("<I", len(tgc or [])), np.array(tgc or [], "<f4").tobytes()])


def write_sets(records: DataFrame, folder: str, name: str = "path", typecode: str = "F4", nsamp: int | None = None, f2c: int = 0, txstart: int = 0, groups: tuple[int, int] | None = None, temps: tuple[float, float] | None = None, tgc: list[float] | None = None, compression: str | None = None, append: bool = False, open_ended: bool = False, ntx: int | None = None) -> int:
    """Write a version 1.6 file for each set, named by a column; channels in order; how many files were written.

    A file is written row by row from a sorted partition.  open_ended files state no number of
    channels, and ``append`` adds channels to such a file, of the same type and transmissions.
    With ntx the rows 0 to ntx - 1 are a channel's transmissions, of which it may lack some (of
    no integer type); without it all channels of a set must have as many rows.
    """
    if append and compression:
        raise ValueError("a compressed file cannot be added to")
    dtype = np.dtype(TYPES[typecode.encode()])
    gaps = ntx is not None and dtype.kind != "i"
    complex_ = dtype.kind == "c"
    records = records if "im" in records.columns else records.withColumn("im", F.lit(None).cast("array<double>"))
    channels = records.groupBy(F.col(name).alias("_name"), "rid").agg(F.count("*").alias("n"), F.max(F.col("ws") + F.col("wl")).alias("end"), F.min(F.size("data") == F.col("wl")).alias("fits"), (F.min("wl") == F.max("wl")).alias("even"))
    sums = channels.groupBy("_name").agg(F.count("*").alias("_nrx"), F.min("n").alias("_lo"), F.max("n").alias("_ntx"), F.max("end").alias("_end"), F.min(F.col("fits") & F.col("even")).alias("_fits"))
    rows = records.join(sums, F.col(name) == F.col("_name")).select("_name", "rid", "row", "li", "gi", "px", "py", "pz", "ws", "wl", "data", "im", "_nrx", "_lo", "_ntx", "_end", "_fits")
    # by a hash of our own: what is dealt by the name alone counts as dealt by the join, which Spark may yet turn into another, and a set would be in several tasks
    rows = rows.repartition(F.xxhash64("_name")).sortWithinPartitions("_name", "rid", "row")

    def start(row: dict, system, root: str):
        n, path = nsamp if nsamp is not None else row["_end"], f"{root}/{row['_name']}"
        size = row["_ntx"] if ntx is None else ntx
        if (row["_lo"] < size and not gaps) or row["_ntx"] > size or not row["_fits"] or row["_end"] > n:
            raise FormatError(f"a channel does not fit set {row['_name']}")
        if append:
            with system.open_input_file(path) as f:
                head, _ = parse_header(f)
            if head["nrx"] or head["typecode"] != typecode or head["ntx"] != size or row["_end"] > head["nsamp"]:
                raise FormatError(f"set {row['_name']} takes no such channels")
            with system.open_input_file(path) as f:
                before = f.read()
        else:
            before = file_header(typecode, f2c, n, 0 if open_ended else row["_nrx"], size, groups, txstart, temps, tgc)
        half = f"{root}/.{row['_name']}.{uuid.uuid4().hex}"
        out = system.open_output_stream(half, compression={"gzip": "gzip", "bzip2": "bz2", None: None}[compression])
        out.write(before)
        return out, half, path

    def write(batches):
        system, root = system_of(folder)
        system.create_dir(root, recursive=True)
        out, own, done, due, wl = None, None, 0, 0, 0

        def lack(upto: int) -> None:
            if gaps and due < upto:
                out.write(absent_row(dtype, (upto - due) * wl))

        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in ("data", "im")}
                if own is None or row["_name"] != own[0]:
                    if out:
                        lack(ntx)
                        out.close()
                        system.move(half, path)
                    (out, half, path), own, done = start(row, system, root), (row["_name"], None), done + 1
                    due = ntx
                if row["rid"] != own[1]:
                    lack(ntx)
                    out.write(struct.pack("<3I3f2I", *(row[c] for c in ("rid", "li", "gi", "px", "py", "pz", "ws", "wl"))))
                    own, due, wl = (row["_name"], row["rid"]), 0, row["wl"]
                if gaps:
                    if not due <= row["row"] < ntx:
                        raise FormatError(f"channel {row['rid']} has a transmission twice or beyond {ntx}")
                    lack(row["row"])
                    due = row["row"] + 1
                data = batch.column("data")[k].values.to_numpy(zero_copy_only=False)
                if complex_ and (im := batch.column("im")[k]).is_valid:
                    data = data + 1j * im.values.to_numpy(zero_copy_only=False)
                out.write(data.astype(dtype).tobytes())
        if out:
            lack(ntx)
            out.close()
            system.move(half, path)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
