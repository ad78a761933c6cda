"""Queries that write files of every kind to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode, rolling
from ..operators.tomography import shared_path
from ..sources import files, maps, matrices, waveset
from . import bindings as B
from .pair_queries import _RECORDS, _records

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _sets(spark, sf_dir) -> str:
    """A file for each four channels."""
    folder = shared_path(spark, "sets")
    rows = _records(spark, sf_dir).withColumn("path", F.concat(F.lit("set"), F.floor(F.col("rid") / 4).cast("string")))
    waveset.write_sets(rows, folder, typecode="F8", nsamp=72, ntx=20)
    return folder


@query("set_round_trip", "with " + _RECORDS.removeprefix("also ") + " select rid, row, s, round(v, 6) as v from records")
def set_round_trip(spark, sf_dir):
    rows = waveset.read_records(spark, _sets(spark, sf_dir))
    return rolling.to_samples(rows, keys=("rid", "row"), start="ws").select("rid", "row", "s", F.round("v", 6).alias("v"))


@query("set_headers", "with c as (select vec_id // 20 as rid from embeddings group by 1) select 72::bigint as nsamp, 20::bigint as ntx, count(*)::bigint as nrx, count(*)::bigint as files from c group by rid // 4")
def set_headers(spark, sf_dir):
    """Headers alone: samples, transmissions and channels of each file, and the channels that are listed in it."""
    folder = _sets(spark, sf_dir)
    listed = waveset.read_records(spark, folder, headers_only=True).groupBy("path").agg(F.count("*").alias("files"))
    return waveset.read_sets(spark, folder).join(listed, "path").select("nsamp", "ntx", "nrx", "files")


@query("channel_list", "select distinct vec_id // 20 as rid, (vec_id // 20)::double as px, vec_id // 20 % 4 as li, vec_id // 20 // 4 as gi from embeddings")
def channel_list(spark, sf_dir):
    return waveset.channel_list(waveset.read_records(spark, _sets(spark, sf_dir), headers_only=True)).select("rid", "px", "li", "gi")


def _maps(spark, sf_dir) -> str:
    folder = shared_path(spark, "maps")
    files.write_files(maps.map_files(B.waves(spark, sf_dir), "<f8", "deflate"), folder)
    return folder


@query("map_round_trip", B.sql("select t, r, s, round(v, 6) as v from samples", "samples"))
def map_round_trip(spark, sf_dir):
    rows = maps.last_of_each(maps.read_maps(spark, _maps(spark, sf_dir)))
    return rolling.to_samples(rows).select("t", "r", "s", F.round("v", 6).alias("v"))


@query("map_keys", B.sql("select t, r from waves", "waves"))
def map_keys(spark, sf_dir):
    return maps.read_maps(spark, _maps(spark, sf_dir), keys_only=True).select("t", "r")


def _keymat(spark, sf_dir):
    return B.arrivals(spark, sf_dir).select(F.array("t", "r").alias("keys"), F.array("time").alias("values"))


@query("keymat_round_trip", B.sql("select t, r, round(time, 6) as time from arrivals", "arrivals"))
def keymat_round_trip(spark, sf_dir):
    folder = shared_path(spark, "keys")
    files.write_files(matrices.keymat_files(_keymat(spark, sf_dir)), folder)
    rows = matrices.merged_keymats(matrices.read_keymats(spark, folder, nkeys=2))
    return rows.select(F.col("keys")[0].alias("t"), F.col("keys")[1].alias("r"), F.round(F.col("values")[0], 6).alias("time"))


@query("keymat_text", B.sql("select t, r, round(time, 6) as time from arrivals", "arrivals"))
def keymat_text(spark, sf_dir):
    folder = shared_path(spark, "lines")
    matrices.keymat_lines(_keymat(spark, sf_dir)).write.text(folder)
    rows = matrices.read_keymats(spark, folder, nkeys=2)
    return rows.select(F.col("keys")[0].alias("t"), F.col("keys")[1].alias("r"), F.round(F.col("values")[0], 6).alias("time"))


@query("decoded_set", "with " + _RECORDS.removeprefix("also ") + " select rid, (row // 4)::bigint as g, l, s - 4 as s, round(sum(v * (1 - 2 * (bit_count((row % 4)::bigint & l) % 2))) / 4, 6) as v from records, (select unnest(range(0, 4))::bigint as l) group by 1, 2, 3, 4")
def decoded_set(spark, sf_dir):
    """A file's transmissions, four by four, decoded from sample 4 on; those that a channel lacks are silent."""
    out = decode.hadamard_decode(waveset.read_records(spark, _sets(spark, sf_dir)), 4, 64, f2c=-4, whole=False)
    return out.select("rid", "g", "l", F.posexplode("re").alias("s", "v")).select("rid", "g", "l", F.col("s").cast("long").alias("s"), F.round("v", 6).alias("v"))
