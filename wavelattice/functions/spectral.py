"""Kernels over tables of waves: Arrow batches in, Arrow batches out, one row a signal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels as K

_KINDS = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}


def views(column: pa.Array) -> list:
    """The values of a column; lists as arrays over the column's own buffer."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    return [flat[a:b] if ok else None for a, b, ok in zip(offs[:-1].tolist(), offs[1:].tolist(), valid, strict=True)]


def packed(values: list, kind: pa.DataType) -> pa.Array:
    """A column of values; arrays go into one buffer."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    none = np.array([v is None for v in values], bool)
    offs = np.concatenate(([0], np.cumsum([0 if v is None else len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate([np.zeros(0), *(v for v in values if v is not None)])
    out = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, kind.value_type))
    return pc.if_else(pa.array(none), pa.scalar(None, kind), out) if none.any() else out


def _refused(n_kinds: int, error: Exception) -> tuple[tuple, str]:
    return (None,) * n_kinds, str(error)


_ERRORS = (ValueError, IndexError, np.linalg.LinAlgError)


def apply(waves: DataFrame, columns: list[str], made: dict[str, str], kernel: Callable[..., tuple], keys: list[str] = ("t", "r"), alike: list[str] | None = None) -> DataFrame:
    """keys and the values that kernel(*columns) returns for each row.

    made: name and type of each value.  A ValueError or IndexError of the kernel gives nulls
    and its message in ``status``, so that one bad signal does not end a job.  With ``alike``
    the kernel gets all rows of a batch at once whose values in these columns and whose arrays'
    lengths are the same: those columns as they are, arrays as rows of a matrix.
    """
    keys = list(keys)
    kinds = [_KINDS[k] for k in made.values()]
    schema = [f"{k} {waves.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} {k}" for n, k in made.items()] + ["status string"]

    def each(args: list[list]) -> list[tuple[tuple, str]]:
        out = []
        for row in zip(*args, strict=True):
            try:
                out.append((kernel(*row), "ok"))
            except _ERRORS as e:
                out.append(_refused(len(kinds), e))
        return out

    def together(args: list[list]) -> list[tuple[tuple, str]]:
        groups: dict[tuple, list[int]] = {}
        for k, row in enumerate(zip(*args, strict=True)):
            groups.setdefault(tuple(v if c in alike else np.shape(v) for c, v in zip(columns, row, strict=True)), []).append(k)
        out: list = [None] * len(args[0])
        for members in groups.values():
            own = [a[members[0]] if c in alike else np.stack([a[k] for k in members]) for c, a in zip(columns, args, strict=True)]
            try:
                values = kernel(*own)
                for at, k in enumerate(members):
                    out[k] = (tuple(v[at] if np.ndim(v) > 1 else v for v in values), "ok")
            except _ERRORS as e:
                for k in members:
                    out[k] = _refused(len(kinds), e)
        return out

    def run(batches):
        for batch in batches:
            args = [views(batch.column(c)) for c in columns]
            done = (each if alike is None else together)(args)
            arrays = [packed([values[k] for values, _ in done], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *arrays, pa.array([status for _, status in done], pa.string())], names=[*keys, *made, "status"])

    return waves.select(*dict.fromkeys([*keys, *columns])).mapInArrow(run, ", ".join(schema))


WAVE = ["nsamp", "dstart", "data"]
_SIGNAL = {"nsamp": "long", "dstart": "long", "data": "array<double>"}
_WINDOW = ["nsamp", "dstart"]


def envelope(waves: DataFrame) -> DataFrame:
    return apply(waves, WAVE, _SIGNAL, lambda n, d, x: (n, d, K.envelope(x)), alike=_WINDOW)


def transform(waves: DataFrame, start: int = 0, length: int | None = None) -> DataFrame:
    """re and im of the real transform over a window."""

    def kernel(n, d, x):
        y = K.spectrum(x, d, start, length or n)
        return y.real, y.imag

    return apply(waves, WAVE, {"re": "array<double>", "im": "array<double>"}, kernel, alike=_WINDOW)


def inverse(spectra: DataFrame, n: int) -> DataFrame:
    return apply(spectra, ["re", "im"], {"data": "array<double>"}, lambda re, im: (np.fft.irfft(re + 1j * im, n),), alike=[])


def oversample(waves: DataFrame, n: int) -> DataFrame:
    return apply(waves, WAVE, _SIGNAL, lambda s, d, x: (s * n, d * n, K.resample(x, n)), alike=_WINDOW)


def shift(waves: DataFrame, delay: str, cyclic: bool = False) -> DataFrame:
    """Each signal delayed by a column's samples."""
    return apply(waves, [*WAVE, delay], _SIGNAL, lambda n, d, x, s: (n, 0, K.delay_by(x, d, n, s, cyclic)))


def bandpass(waves: DataFrame, start: int, end: int, tail: int = 0) -> DataFrame:
    return apply(waves, WAVE, _SIGNAL, lambda n, d, x: (n, 0, K.bandpass(x, d, n, start, end, tail)), alike=_WINDOW)


def delay(pairs: DataFrame, osamp: int = 1, negative: bool = False, keys=("t", "r")) -> DataFrame:
    """delay and sign of data against ref (columns dstart, data, ref_start, ref)."""
    return apply(pairs, ["dstart", "data", "ref_start", "ref"], {"delay": "double", "sign": "int"}, lambda d, x, s, y: K.find_delay(x, d, y, s, osamp, negative), list(keys))


def align(pairs: DataFrame, osamp: int = 1) -> DataFrame:
    """data shifted onto ref (columns nsamp, dstart, data, ref_start, ref)."""

    def kernel(n, d, x, s, y):
        return n, 0, K.delay_by(x, d, n, -K.find_delay(x, d, y, s, osamp)[0])

    return apply(pairs, [*WAVE, "ref_start", "ref"], _SIGNAL, kernel)


def denoise(waves: DataFrame, **options) -> DataFrame:
    return apply(waves, WAVE, _SIGNAL, lambda n, d, x: (n, d, K.denoise(x, **options)))


def isolate_peak(waves: DataFrame, hint: str | None = None, window=None, tail: int = 0, **options) -> DataFrame:
    """The signal cut around its peak, with the peak's index, prominence and width."""

    def kernel(n, d, x, *index):
        peak = K.choose_peak(x, d, index[0] if index else None, **options)
        lo, hi = K.peak_window(x, d, n, peak, window)
        cut = K.spread(x, d, lo, hi - lo)
        if tail:
            if 2 * tail > len(cut):
                raise ValueError("the window is shorter than its tails")
            cut[:tail] *= K.hann(2 * tail)[:tail]
            cut[len(cut) - tail :] *= K.hann(2 * tail)[tail:]
        return n, lo, cut, int(peak[0]), float(peak[1]), float(peak[2])

    return apply(waves, [*WAVE, *([hint] if hint else [])], {**_SIGNAL, "peak": "long", "prominence": "double", "width": "double"}, kernel)


def arrivals(waves: DataFrame, **options) -> DataFrame:
    return apply(waves, WAVE, {"at": "double"}, lambda n, d, x: (K.arrival_sample(x, d, **options),))


def exponents(waves: DataFrame, degree: int) -> DataFrame:
    def kernel(n, d, x):
        rate, amp = K.prony(x, degree)
        order = np.argsort(-np.abs(amp))
        return rate.real[order], rate.imag[order], np.abs(amp)[order]

    return apply(waves, WAVE, {"decay": "array<double>", "frequency": "array<double>", "amplitude": "array<double>"}, kernel)
