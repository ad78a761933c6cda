"""Key maps (npz and text), fire captures, dense matrices and spectral groups."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files


def parse_keymat(data: bytes, nkeys: int = 1) -> list[tuple[list[int], list[float]]]:
    """(keys, values) rows of an npz file, or else of text with nkeys key columns."""
    if data[:2] != b"PK":
        table = np.loadtxt(io.BytesIO(data), ndmin=2)
        keys = table[:, :nkeys]
        if np.any(keys != np.floor(keys)):
            raise ValueError("a key is no whole number")
        return [(k.astype(int).tolist(), v.tolist()) for k, v in zip(keys, table[:, nkeys:], strict=True)]
    with np.load(io.BytesIO(data)) as f:
        if set(f.files) - {"comment"} != {"keys", "values", "lengths"}:
            raise ValueError("the arrays are not those of a key map")
        keys, values, lengths = f["keys"], f["values"], f["lengths"]
    if not np.issubdtype(keys.dtype, np.integer) or keys.ndim not in (1, 2):
        raise ValueError("keys must be one or two dimensions of whole numbers")
    if values.ndim != 1 or not np.issubdtype(values.dtype, np.number):
        raise ValueError("values must be one dimension of numbers")
    if lengths.ndim > 1 or (lengths.ndim == 1 and len(lengths) != len(keys)):
        raise ValueError("lengths do not belong to the keys")
    lengths = np.broadcast_to(lengths, len(keys))
    if lengths.sum() != len(values):
        raise ValueError("lengths do not add up to the values")
    ends = np.cumsum(lengths)
    keys = keys.reshape(len(keys), -1)
    return [(k.tolist(), values[e - n : e].tolist()) for k, e, n in zip(keys, ends, lengths, strict=True)]


def read_keymats(spark: SparkSession, *paths: str, nkeys: int = 1) -> DataFrame:
    """path, keys, values."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = parse_keymat(content.as_py(), nkeys)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["path", "keys", "values"])

    return read_files(spark, *paths).mapInArrow(run, "path string, keys array<long>, values array<double>")


def merged_keymats(rows: DataFrame) -> DataFrame:
    """One row a key, in order; of scalar values the largest stays, arrays must be unique."""
    held = rows.groupBy("keys").agg(F.max("values").alias("values"), F.count("*").alias("n"))
    good = (F.col("n") == 1) | (F.size("values") == 1)
    return held.select("keys", F.when(good, F.col("values")).otherwise(F.raise_error(F.lit("arrays with equal keys")).cast("array<double>")).alias("values")).orderBy("keys")


def encode_keymat(rows: list[tuple], comment: str | None = None, compressed: bool = False) -> bytes:
    """An npz file of (keys, values) rows, in key order; equal lengths are stored once."""
    rows = sorted((tuple(np.atleast_1d(k).tolist()), np.atleast_1d(v)) for k, v in rows)
    if len({len(k) for k, _ in rows}) > 1:
        raise TypeError("keys differ in length")
    lengths = np.array([len(v) for _, v in rows], int)
    keys = np.array([k if len(k) > 1 else k[0] for k, _ in rows], dtype=np.int64)
    values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    if len(set(lengths.tolist())) <= 1:
        lengths = np.array(lengths[0] if len(lengths) else 0)
    held = io.BytesIO()
    extra = {} if comment is None else {"comment": comment}
    (np.savez_compressed if compressed else np.savez)(held, keys=keys, values=values, lengths=lengths, **extra)
    return held.getvalue()


#: Rows that a file of ``keymat_files`` holds at most.
FILE_KEYS = 100_000


def keymat_files(rows: DataFrame, compressed: bool = False) -> DataFrame:
    """name, content: npz files of at most FILE_KEYS rows (keys, values) each, by ranges of the keys in order."""
    ranged = rows.select("keys", "values").repartitionByRange("keys").sortWithinPartitions("keys")

    def made(held: list[tuple]) -> pa.RecordBatch:
        name = "-".join(map(str, held[0][0]))
        return pa.RecordBatch.from_arrays([pa.array([f"keys-{name}.npz"]), pa.array([encode_keymat(held, compressed=compressed)], pa.binary())], names=["name", "content"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for k in range(len(batch)):
                held.append(tuple(c[k].values.to_numpy(zero_copy_only=False) for c in batch.columns))
                if len(held) == FILE_KEYS:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    return ranged.mapInArrow(run, "name string, content binary")


def keymat_lines(rows: DataFrame) -> DataFrame:
    """value: lines of key then value columns, for the text writer."""
    return rows.orderBy("keys").select(F.concat_ws(" ", F.transform("keys", lambda k: k.cast("string")), F.transform("values", lambda v: v.cast("string"))).alias("value"))


def read_captures(spark: SparkSession, *paths: str, rep: int | None = None) -> DataFrame:
    """path, channel, rep, data of capture files: four lines of header, then channel, repetition, samples."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = np.loadtxt(io.BytesIO(content.as_py()), delimiter=",", skiprows=4, ndmin=2)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(table), pa.string()), pa.array(table[:, 0].astype(int)), pa.array(table[:, 1].astype(int)), pa.array(table[:, 2:].tolist(), pa.list_(pa.float64()))], names=["path", "channel", "rep", "data"])

    rows = read_files(spark, *paths).mapInArrow(run, "path string, channel long, rep long, data array<double>")
    return rows if rep is None else rows.where(F.col("rep") == rep)


def capture_counts(captures: DataFrame) -> DataFrame:
    """path, channels, reps; an error for a capture that is not rectangular."""
    by = captures.groupBy("path", "channel").agg(F.count("*").alias("n"), F.countDistinct("rep").alias("d"))
    out = by.groupBy("path").agg(F.count("*").alias("channels"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("d").alias("reps"))
    return out.select("path", "channels", F.when((F.col("lo") == F.col("hi")) & (F.col("hi") == F.col("reps")), F.col("reps")).otherwise(F.raise_error(F.lit("a capture is not rectangular")).cast("long")).alias("reps"))


def fire_sequence(captures: DataFrame, order: list[str]) -> DataFrame:
    """fire, channel, rep, data: captures in the order of their files' names (few)."""
    place = F.create_map(*(x for k, p in enumerate(order) for x in (F.lit(p), F.lit(k))))
    return captures.select(F.element_at(place, F.regexp_extract("path", r"([^/]*)$", 1)).cast("long").alias("fire"), "channel", "rep", "data")


def encode_matrix(values: np.ndarray) -> bytes:
    """Shape as int32 numbers, then the values with the first index fastest."""
    return np.array(values.shape, "<i4").tobytes() + np.asfortranarray(values).tobytes(order="F")


def decode_matrix(data: bytes, ndim: int, dtype: str) -> np.ndarray:
    shape = np.frombuffer(data, "<i4", ndim)
    return np.frombuffer(data, dtype, offset=4 * ndim).reshape(shape, order="F")


#: A spectral representation's record: a complex value and an index; a group starts with its count.
SPECTRAL = np.dtype([("val", "<c8"), ("idx", "<i8")])


def spectral_groups(data: bytes) -> list[np.ndarray]:
    rows, at, out = np.frombuffer(data, SPECTRAL), 0, []
    while at < len(rows):
        n = int(rows["idx"][at])
        if at + 1 + n > len(rows):
            raise ValueError("a group ends early")
        out.append(rows[at + 1 : at + 1 + n])
        at += 1 + n
    return out


def encode_spectral(groups: list[np.ndarray]) -> bytes:
    out = []
    for g in groups:
        head = np.zeros(1, SPECTRAL)
        head["idx"] = len(g)
        out += [head.tobytes(), np.asarray(g, SPECTRAL).tobytes()]
    return b"".join(out)


def read_spectral(spark: SparkSession, *paths: str, counts_only: bool = False) -> DataFrame:
    """path, grp, pos, re, im, idx; or path, grp, n."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, g in enumerate(spectral_groups(content.as_py())):
                    if counts_only:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([len(g)], pa.int64())], names=["path", "grp", "n"])
                    else:
                        values = (np.arange(len(g)), g["val"].real, g["val"].imag, g["idx"])
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(g), pa.string()), pa.array([k] * len(g), pa.int64()), *(pa.array(np.ascontiguousarray(v)) for v in values)], names=["path", "grp", "pos", "re", "im", "idx"])

    return read_files(spark, *paths).mapInArrow(run, "path string, grp long, n long" if counts_only else "path string, grp long, pos long, re float, im float, idx long")
