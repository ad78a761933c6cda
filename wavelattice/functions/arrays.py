"""Column functions on signals held as arrays; all run in the JVM.

A signal is (nsamp, dstart, data); samples outside the data are zero.  Bounds are columns or
numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _steps(n: Column) -> Column:
    """0 .. n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def dense(data: Column, dstart, start, length) -> Column:
    """Samples start .. start + length, zero outside the data."""
    first = as_column(start) - as_column(dstart)
    return F.transform(_steps(as_column(length)), lambda i: F.when((i + first >= 0) & (i + first < F.size(data)), F.get(data, (i + first).cast("int"))).otherwise(F.lit(0.0)))


def overlap(a_start, a_length, b_start, b_length) -> tuple[Column, Column]:
    """Start and length of two windows' intersection; length 0 where they are apart."""
    a, b = as_column(a_start), as_column(b_start)
    start = F.greatest(a, b)
    return start, F.greatest(F.lit(0), F.least(a + as_column(a_length), b + as_column(b_length)) - start)


def scale(data: Column, k) -> Column:
    return F.transform(data, lambda v: v * as_column(k))


def divide(data: Column, k) -> Column:
    return F.transform(data, lambda v: v / as_column(k))


def floor_divide(data: Column, k) -> Column:
    return F.transform(data, lambda v: F.floor(v / as_column(k)).cast("double"))


def negate(data: Column) -> Column:
    return F.transform(data, lambda v: -v)


def magnitude(data: Column) -> Column:
    return F.transform(data, F.abs)


def add(a: Column, a_start, b: Column, b_start, sign: int = 1) -> tuple[Column, Column]:
    """Start and data of a + sign * b over the union of their windows."""
    a0, b0 = as_column(a_start), as_column(b_start)
    start = F.least(a0, b0)
    length = F.greatest(a0 + F.size(a), b0 + F.size(b)) - start
    return start, F.zip_with(dense(a, a0, start, length), dense(b, b0, start, length), lambda x, y: x + sign * y)


def mean(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda a, v: a + v) / F.size(data)


def debias(data: Column) -> Column:
    m = mean(data)
    return F.transform(data, lambda v: v - m)


def sign_square(data: Column) -> Column:
    return F.transform(data, lambda v: v * F.abs(v))


def hann_tail(i: Column, tail: int) -> Column:
    """Rising half of a Hann window of 2 * tail samples."""
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (2 * tail - 1))


def window(data: Column, dstart, start, length, tail: int = 0, relative: str | None = None, nsamp=None) -> tuple[Column, Column]:
    """Start and data of a signal cut to a window, with Hann tails at the window's ends.

    relative: None for an absolute window; 'datawin' counts start from the data's, and the
    length is then what is added to the data's end; 'signal' adds the length to nsamp.
    """
    if tail < 0:
        raise ValueError("tails must not be negative")
    start, length, dstart = as_column(start), as_column(length), as_column(dstart)
    if relative == "datawin":
        end = dstart + F.size(data) + length
        start = dstart + start
        length = end - start
    elif relative == "signal":
        length = as_column(nsamp) + length - start
    elif relative is not None:
        raise ValueError("relative must be 'signal' or 'datawin'")
    if tail:
        length = F.when(length >= 2 * tail, length).otherwise(F.raise_error(F.lit("window is shorter than its tails")).cast("long"))
    first, n = overlap(start, length, dstart, F.size(data))
    cut = dense(data, dstart, first, n)
    if not tail:
        return first, cut
    at = first - start

    def weight(i: Column) -> Column:
        k = i + at
        left = F.when(k < tail, hann_tail(k, tail)).otherwise(1.0)
        right = F.when(k >= length - tail, hann_tail(length - 1 - k, tail)).otherwise(1.0)
        return left * right

    return first, F.zip_with(cut, F.transform(_steps(n), weight), lambda v, w: v * w)


def trim(data: Column, dstart, start, end) -> tuple[Column, Column]:
    """The data window with its start and end moved."""
    return window(data, dstart, start, end, relative="datawin")


def shift(data: Column, dstart, d, nsamp, cyclic: bool = False) -> tuple[Column, Column]:
    """Start and data after a delay of d whole samples; shift by 0 changes nothing."""
    d, n, dstart = as_column(d), as_column(nsamp), as_column(dstart)
    if cyclic:
        return F.lit(0).cast("long"), F.transform(_steps(n), lambda i: _cyclic_sample(data, dstart, F.pmod(i - d, n)))
    first, length = overlap(dstart + d, F.size(data), F.lit(0), n)
    return first, dense(data, dstart + d, first, length)


def _cyclic_sample(data: Column, dstart: Column, at: Column) -> Column:
    k = at - dstart
    return F.when((k >= 0) & (k < F.size(data)), F.get(data, k.cast("int"))).otherwise(F.lit(0.0))


def roll_left(data: Column, k) -> Column:
    """Cyclic roll of a whole array."""
    n = F.size(data)
    k = F.pmod(as_column(k), n).cast("int")
    return F.concat(F.slice(data, k + 1, n - k), F.slice(data, F.lit(1), k))


def spectrum_index(n: Column, real: bool) -> Column:
    """Bin numbers in the order of a transform of n samples."""
    if real:
        return _steps(F.floor(n / 2) + 1)
    return F.transform(_steps(n), lambda k: F.when(k < F.ceil(n / 2), k).otherwise(k - n))


def gain_curve(tgc: Column, samples: int = 16) -> Column:
    """A gain in dB for each ``samples`` samples as factors a sample."""
    return F.transform(_steps(F.size(tgc) * samples), lambda i: F.pow(F.lit(10.0), -F.get(tgc, F.floor(i / samples).cast("int")) / 20))


def walsh_sign(code, index) -> Column:
    """Sign of an index in a Walsh-Hadamard row: the parity of shared bits."""
    return 1 - 2 * (F.bit_count(as_column(code).bitwiseAND(as_column(index))) % 2)


def pack_key(t: Column, r: Column, strict: bool = True) -> Column:
    """Both halves of a pair in 32 bits; each must fit 16, unless strict is false: then what is beyond runs into the other half."""
    if not strict:
        return F.shiftleft(t.cast("long"), 16).bitwiseOR(r.cast("long"))
    good = (t >= 0) & (t < 65536) & (r >= 0) & (r < 65536)
    return F.when(good, F.shiftleft(t.cast("long"), 16).bitwiseOR(r.cast("long"))).otherwise(F.raise_error(F.lit("a key half is outside 0..65535")).cast("long"))


def unpack_key(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 16), key.bitwiseAND(65535)


def group_pair(t: Column, r: Column, size: int) -> tuple[Column, Column]:
    """The unordered pair of groups of a pair."""
    a, b = F.floor(t / size), F.floor(r / size)
    return F.least(a, b), F.greatest(a, b)


def strict_int(x: Column, least: int | None = None) -> Column:
    """x as a whole number; an error where it is none or too small."""
    good = x == F.floor(x)
    if least is not None:
        good &= x >= least
    return F.when(good, x.cast("long")).otherwise(F.when(x.isNotNull(), F.raise_error(F.lit("not an allowed whole number")).cast("long")))


def number_ranges(text: Column) -> Column:
    """'2,5,7-12' as sorted distinct numbers."""
    part = lambda p, k: F.get(F.split(p, "-"), F.lit(k)).cast("long")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(text, r"\s", ""), ","), lambda p: F.sequence(part(p, 0), F.coalesce(part(p, 1), part(p, 0)))))))


def replace(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns in place of those of the same names.

    By way of other names: inside a lambda a name would be taken for the new column beside it.
    """
    made = rows.withColumns({f"_new_{n}": c for n, c in columns.items()})
    return made.drop(*columns).withColumnsRenamed({f"_new_{n}": n for n in columns})
