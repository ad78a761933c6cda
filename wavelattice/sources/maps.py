"""Zip files of waveforms by pair: a JSON header and a data block for each store operation.

Complex samples have their imaginary part in ``im``, which is null for real ones.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listed, open_file, read_files, seekable

#: Entries are named prefix.header.id and prefix.data.id; any prefix is read.
ENTRY = re.compile(r"(.+)\.(header|data)\.([0-9a-f]+)")
PREFIX = "waves"
METHODS = {None: zipfile.ZIP_STORED, "deflate": zipfile.ZIP_DEFLATED, "bzip2": zipfile.ZIP_BZIP2, "lzma": zipfile.ZIP_LZMA}


def parse_map(data, keys_only: bool = False):
    """(t, r, nsamp, dstart, samples) of every record of a file's bytes, or of an open file; entries without their partner are passed over."""
    with zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data) as z:
        parts: dict[tuple[str, str], dict[str, str]] = {}
        for name in z.namelist():
            if m := ENTRY.fullmatch(name):
                held = parts.setdefault((m[1], m[3]), {})
                if m[2] in held:
                    raise OSError(f"entry {name} is repeated")
                held[m[2]] = name
        for own, names in parts.items():
            if len(names) < 2:
                continue
            head = json.loads(z.read(names["header"]))
            if "nsamp" not in head or "records" not in head:
                raise OSError(f"header {own[1]} is malformed")
            block, at = b"" if keys_only else z.read(names["data"]), 0
            for rec in sorted(head["records"], key=lambda x: x["offset"]):
                if keys_only:
                    yield rec["t"], rec["r"], None, None, None
                    continue
                if rec["offset"] != at:
                    raise OSError(f"record {rec['t']}, {rec['r']} of {own[1]} does not follow the one before")
                try:
                    dtype = np.dtype(rec["byteorder"] + rec["typechar"])
                except TypeError:
                    raise OSError(f"sample type of record {rec['t']}, {rec['r']} is unknown") from None
                end = at + dtype.itemsize * rec["datalength"]
                if end > len(block):
                    raise OSError(f"record {rec['t']}, {rec['r']} ends early")
                yield rec["t"], rec["r"], head["nsamp"], rec["datastart"], np.frombuffer(block[at:end], dtype)
                at = end


def read_maps(spark: SparkSession, *paths: str, keys_only: bool = False) -> DataFrame:
    """path, seq, t, r, nsamp, dstart, data, im in file order; with keys_only the headers alone are read, by seeking."""
    names, kinds = ["path", "seq", "t", "r", "nsamp", "dstart", "data", "im"], [pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.float64())] * 2]
    seek = keys_only and seekable(*paths)

    def run(batches):
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                rows: list[tuple] = []
                for seq, (t, r, n, d, x) in enumerate(parse_map(open_file(path) if seek else batch.column(1)[k].as_py(), keys_only)):
                    rows.append((path, seq, t, r, n, d, None if x is None else x.real.astype(float), x.imag.astype(float) if np.iscomplexobj(x) else None))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], kind) for c, kind in enumerate(kinds)], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], kind) for c, kind in enumerate(kinds)], names=names)

    files = listed(spark, *paths) if seek else read_files(spark, *paths)
    return files.mapInArrow(run, "path string, seq long, t long, r long, nsamp long, dstart long, data array<double>, im array<double>")


def last_of_each(rows: DataFrame) -> DataFrame:
    """One row a pair: the last in file order."""
    return rows.groupBy("t", "r").agg(F.max_by(F.struct("nsamp", "dstart", "data", "im"), F.struct("path", "seq")).alias("w")).select("t", "r", "w.*")


def single_wave(rows: DataFrame) -> DataFrame:
    """The rows, which must be one."""
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError("a map of one waveform was expected")
    return rows


def encode_map(waves: list[tuple], dtype: str = "<f4", compression: str | None = None, before: bytes | None = None, prefix: str = PREFIX) -> bytes:
    """A zip file of (t, r, nsamp, dstart, data), a submap for each nsamp, or more submaps in a file's bytes."""
    if compression not in METHODS:
        raise ValueError(f"compression {compression!r} is unknown")
    held = io.BytesIO(before or b"")
    kind = np.dtype(dtype)
    with zipfile.ZipFile(held, "a" if before else "w", METHODS[compression]) as z:
        for nsamp in dict.fromkeys(w[2] for w in waves):
            own, raw, records, at = uuid.uuid4().hex, [], [], 0
            for t, r, _, dstart, data in (w for w in waves if w[2] == nsamp):
                part = np.asarray(data).astype(kind).tobytes()
                records.append({"t": t, "r": r, "datastart": dstart, "datalength": len(data), "typechar": kind.char, "byteorder": "<", "offset": at})
                raw.append(part)
                at += len(part)
            z.writestr(f"{prefix}.data.{own}", b"".join(raw))
            z.writestr(f"{prefix}.header.{own}", json.dumps({"nsamp": nsamp, "records": records}))
    return held.getvalue()


#: Waves that a file of ``map_files`` holds at most.
FILE_WAVES = 10_000


def map_files(waves: DataFrame, dtype: str = "<f4", compression: str | None = None, prefix: str = PREFIX) -> DataFrame:
    """name, content: files of at most FILE_WAVES waves, one after the other from each partition."""
    held = waves.select("t", "r", "nsamp", "dstart", "data", waves["im"] if "im" in waves.columns else F.lit(None).cast("array<double>").alias("im"))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"part-{uuid.uuid4().hex}.wmz"]), pa.array([encode_map(rows, dtype, compression, prefix=prefix)], pa.binary())], names=["name", "content"])

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            views = [b.column(c).to_pylist() for c in range(4)]
            for k, (t, r, n, d) in enumerate(zip(*views, strict=True)):
                data, im = (b.column(c)[k] for c in (4, 5))
                x = data.values.to_numpy(zero_copy_only=False)
                rows.append((t, r, n, d, x + 1j * im.values.to_numpy(zero_copy_only=False) if im.is_valid else x))
                if len(rows) == FILE_WAVES:
                    yield made(rows)
                    rows = []
        if rows:
            yield made(rows)

    return held.mapInArrow(run, "name string, content binary")
