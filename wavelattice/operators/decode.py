"""Records of an acquisition: selection, transmit order, group maps and Hadamard decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import kernels as K


def select_record(records: DataFrame, rid: int, rows: list[int] | None = None, start: int | None = None, length: int | None = None) -> DataFrame:
    """A channel's transmissions in the given order, in a window with zero fill."""
    out = records.where(F.col("rid") == rid)
    if rows is not None:
        place = F.array_position(F.array(*map(F.lit, rows)), F.col("row"))
        out = out.where(place > 0).withColumn("place", place - 1)
    if start is not None:
        out = A.replace(out, data=A.dense(F.col("data"), F.col("ws"), start, length), ws=F.lit(start).cast("long"), wl=F.lit(length).cast("long"))
    return out.orderBy("place" if rows is not None else "row")


def headers(records: DataFrame) -> DataFrame:
    return records.select("rid", "li", "gi", "px", "py", "pz", "ws", "wl").distinct().orderBy("rid")


def to_global_time(records: DataFrame, f2c: int, nsamp: int, cyclic: bool = False) -> DataFrame:
    """Signals moved by the sampling offset, cut or wrapped at the ends."""
    start, data = A.shift(F.col("data"), F.col("ws"), f2c, nsamp, cyclic)
    return A.replace(records, data=data, ws=start.cast("long")).withColumn("wl", F.size("data").cast("long"))


def upsert_records(records: DataFrame, changed: DataFrame, nsamp: int) -> DataFrame:
    """Channels of changed in place of those they name; windows must lie within nsamp and fit the data."""
    good = (F.col("ws") >= 0) & (F.col("ws") + F.col("wl") <= nsamp) & (F.size("data") == F.col("wl"))
    checked = changed.withColumn("data", F.when(F.col("data").isNull(), F.array_repeat(F.lit(0.0), F.col("wl").cast("int"))).otherwise(F.col("data")))
    checked = checked.withColumn("wl", F.when(good, F.col("wl")).otherwise(F.raise_error(F.lit("a record's window does not fit")).cast("long")))
    return records.join(changed.select("rid").distinct(), "rid", "left_anti").unionByName(checked)


def delete_records(records: DataFrame, rids: list[int]) -> DataFrame:
    return records.where(~F.col("rid").isin(rids))


def empty_like(table: DataFrame) -> DataFrame:
    return table.sparkSession.createDataFrame([], table.schema)


def transmit_of(elements: DataFrame, groupmap: DataFrame, heads: DataFrame | None, size: int | None) -> DataFrame:
    """e, tx: group * size + index, from the group map or else the element's own header; the element itself without groups."""
    if size is None:
        return elements.select("e", F.col("e").alias("tx"))
    rows = elements.join(groupmap.select("e", "l", "g"), "e", "left")
    if heads is not None:
        rows = rows.join(heads.select(F.col("rid").alias("e"), "li", "gi"), "e", "left")
        rows = rows.withColumns({"l": F.coalesce("l", "li"), "g": F.coalesce("g", "gi")})
    return rows.select("e", (F.col("g") * size + F.col("l")).alias("tx"))


def row_of(tx: Column, txstart: int, ntx: int, maxtx: int) -> Column:
    """Row of a transmission that counts round from maxtx to 0; an error outside the rows."""
    row = F.when(tx < txstart, tx + maxtx).otherwise(tx) - txstart
    return F.when((tx >= 0) & (row >= 0) & (row < ntx), row).otherwise(F.raise_error(F.lit("no such transmission")).cast("long"))


def transmit_indices(spark, txstart: int, ntx: int, maxtx: int) -> DataFrame:
    return spark.range(ntx).select(F.col("id").alias("row"), F.pmod(F.col("id") + txstart, F.lit(maxtx)).alias("tx"))


def single_groups(indices: DataFrame) -> DataFrame:
    """A list of transmissions out of sequence as groups of one: e, l, g by row."""
    return indices.select(F.col("tx").alias("e"), F.lit(0).cast("long").alias("l"), F.col("row").alias("g"))


def check_group_map(groupmap: DataFrame, heads: DataFrame) -> DataFrame:
    """Elements of which the map and the header disagree; none if the map is right."""
    return groupmap.join(heads.select(F.col("rid").alias("e"), "li", "gi"), "e").where("l <> li or g <> gi")


def transmit_sign(transmission, group, own_index, own_group) -> Column:
    """Sign of an element in a coded transmission of a group; 0 for another group's."""
    return F.when(A.as_column(group) != A.as_column(own_group), F.lit(0)).otherwise(A.walsh_sign(transmission, own_index)).cast("int")


def hadamard_join(samples: DataFrame, size: int) -> DataFrame:
    """Decoded samples (rid, g, l, s, v) of coded ones (rid, g, row, s, v): signed means over a group's transmissions.

    Sums are partial before the shuffle.  ``hadamard_decode`` does the same on whole records.
    """
    rows = samples.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("w", A.walsh_sign(F.col("row"), F.col("l")) * F.col("v"))
    return rows.groupBy("rid", "g", "l", "s").agg((F.sum("w") / size).alias("v"))


def hadamard_decode(records: DataFrame, size: int, nsamp: int, f2c: int = 0, signs: DataFrame | None = None, tgc: list[float] | None = None, tgc_samples: int = 16, band: tuple[int, int, int] | None = None, time_domain: bool = True, whole: bool = True) -> DataFrame:
    """rid, g, l, re, im (or data): the full decoding of each channel.

    Records are cut to [0, nsamp) in global time, a group's transmissions are transformed and
    divided by their number, flipped by sign, multiplied by the gain curve, transformed to
    frequency, limited to a band (start, end, tail), and brought back on request.  A group
    that is not whole (unless ``whole`` is false: then what it lacks is silent), or of a size that
    is no power of two, is an error.
    """
    if size & (size - 1):
        raise ValueError("a group's size must be a power of two")
    rows = records.withColumns({"g": F.floor(F.col("row") / size), "l": F.col("row") % size})
    data = A.dense(F.col("data"), F.col("ws") + f2c, 0, nsamp)
    groups = rows.groupBy("rid", "g").agg(F.array_sort(F.collect_list(F.struct("l", data.alias("data")))).alias("parts"))
    if signs is not None:
        groups = groups.join(signs.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("l", "sign"))).alias("signs")), "g", "left")
    else:
        groups = groups.withColumn("signs", F.lit(None).cast("array<struct<l: bigint, sign: int>>"))
    gain = None if tgc is None else np.repeat(10 ** (-np.asarray(tgc) / 20), tgc_samples)

    def decode(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row in batch.to_pylist():
                parts = row["parts"]
                places = [p["l"] for p in parts]
                if len(set(places)) < len(places) or (whole and len(places) < size):
                    raise ValueError(f"group {row['g']} of channel {row['rid']} is not whole")
                x = np.zeros((size, nsamp))
                x[places] = [p["data"] for p in parts]
                x = K.walsh_hadamard(x) / size if size > 1 else x
                for p in row["signs"] or ():
                    if size > 1:
                        x[p["l"]] *= p["sign"]
                if gain is not None:
                    n = min(len(gain), nsamp)
                    x[:, :n] *= gain[:n]
                    x[:, n:] *= gain[-1]
                y = np.fft.rfft(x, axis=1)
                if band is not None:
                    y *= K.band_window(y.shape[1], *band)
                if time_domain:
                    x = np.fft.irfft(y, nsamp, axis=1) if band is not None else x
                for k in range(size):
                    for column, value in zip(out, (row["rid"], row["g"], k, x[k] if time_domain else y[k].real, None if time_domain else y[k].imag), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["rid", "g", "l", "re", "im"])

    return groups.select("rid", "g", "parts", "signs").mapInArrow(decode, "rid long, g long, l long, re array<double>, im array<double>")


def shift_group(waves: DataFrame, subtriangle: int, by: int, size: int = 64, key: str = "r") -> DataFrame:
    """The signals of one run of size elements rolled left."""
    if not 0 <= subtriangle < 160:
        raise ValueError("there are 160 subtriangles")
    own = F.floor(F.col(key) / size) == subtriangle
    return waves.withColumn("data", F.when(own, A.roll_left(F.col("data"), by)).otherwise(F.col("data")))
