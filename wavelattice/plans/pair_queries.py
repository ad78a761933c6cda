"""Queries on keyed tables: joins, selection, outliers, merging, ordering, batches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import arrivals, decode, geometry, pairs, rolling
from . import bindings as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_SPEED = """also speeds as (select a.t, a.r, a.time, sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2) + pow(s.z - p.z, 2)) / a.time as speed
from arrivals a join senders s on s.e = a.t join receivers p on p.e = a.r where a.t <> a.r),
valid as (select * from speeds where speed between 0.05 and 50)"""
_QUART = "q as (select quantile_cont(speed, 0.25) as lo, quantile_cont(speed, 0.75) as hi from valid)"


@query("clean_arrivals", B.sql(f"{_SPEED}, {_QUART} select t, r, round(time, 6) as time, round(speed, 6) as speed from valid, q where speed >= lo - 1.5 * (hi - lo) and speed <= hi + 1.5 * (hi - lo)", "arrivals", "senders", "receivers"))
def clean_arrivals(spark, sf_dir):
    rows = pairs.clean_arrivals(B.arrivals(spark, sf_dir), B.senders(spark, sf_dir), B.receivers(spark, sf_dir), (0.05, 50))
    return rows.select("t", "r", F.round("time", 6).alias("time"), F.round("speed", 6).alias("speed"))


@query("strided_arrivals", B.sql(f"{_SPEED}, {_QUART}, numbered as (select *, row_number() over (order by t, r) - 1 as k from valid) select t, r, round(speed, 6) as speed from numbered, q where k >= 2 and (k - 2) % 5 = 0 and speed >= lo - 1.5 * (hi - lo) and speed <= hi + 1.5 * (hi - lo)", "arrivals", "senders", "receivers"))
def strided_arrivals(spark, sf_dir):
    rows = pairs.clean_arrivals(B.arrivals(spark, sf_dir), B.senders(spark, sf_dir), B.receivers(spark, sf_dir), (0.05, 50), start=2, stride=5)
    return rows.select("t", "r", F.round("speed", 6).alias("speed"))


@query("grouped_outliers", B.sql("also q as (select r // 16 as g, quantile_cont(time, 0.25) as lo, quantile_cont(time, 0.75) as hi from arrivals group by 1) select t, r, round(time, 6) as time from arrivals join q on q.g = arrivals.r // 16 where time >= lo - 0.5 * (hi - lo) and time <= hi + 0.5 * (hi - lo)", "arrivals"))
def grouped_outliers(spark, sf_dir):
    rows = pairs.within_quartiles(B.arrivals(spark, sf_dir), "time", [F.floor(F.col("r") / 16)], 0.5)
    return rows.select("t", "r", F.round("time", 6).alias("time"))


@query("neighborhood_outliers", B.sql("""also w as (select t, r, avg(v * v) as e from samples group by t, r),
around as (select a.t, a.r, b.e from w a join w b on abs(b.t - a.t) <= 1 and abs(b.r - a.r) <= 1),
q as (select t, r, quantile_cont(e, 0.25) as lo, quantile_cont(e, 0.75) as hi, count(*) as n from around group by t, r)
select w.t, w.r, n, e between lo - 1.5 * (hi - lo) and hi + 1.5 * (hi - lo) as keep from w join q on w.t = q.t and w.r = q.r""", "samples"))
def neighborhood_outliers(spark, sf_dir):
    w = B.samples(spark, sf_dir).groupBy("t", "r").agg(F.avg(F.col("v") * F.col("v")).alias("e"))
    ends = w.select(F.col("t").alias("e")).unionByName(w.select(F.col("r").alias("e"))).distinct()
    near = ends.select("e", F.explode(F.array(F.col("e") - 1, F.col("e") + 1)).alias("n"))
    return pairs.neighbourhood_outliers(w, near, "e").select("t", "r", "n", "keep")


@query("status_counts", B.sql("select case when time < 5 then 'low-snr' when time > 45 then 'out-of-bounds' when t = r then 'backscatter' else 'valid' end as status, count(*)::bigint as n from arrivals group by 1", "arrivals"))
def status_counts(spark, sf_dir):
    rules = [("low-snr", F.col("time") < 5), ("out-of-bounds", F.col("time") > 45), ("backscatter", F.col("t") == F.col("r"))]
    return pairs.status_counts(B.arrivals(spark, sf_dir), rules)


_TARGETS = "also a as (select * from arrivals where time < 40), b as (select * from arrivals where time > 10)"


@query("multi_target_join", B.sql(f"{_TARGETS} select a.t, a.r, round(a.time, 6) as first_time, round(b.time + 1, 6) as second_time from a join b on a.t = b.t and a.r = b.r", "arrivals"))
def multi_target_join(spark, sf_dir):
    a = B.arrivals(spark, sf_dir)
    rows = pairs.common_arrivals([a.where("time < 40"), a.where("time > 10").withColumn("time", F.col("time") + 1)])
    return rows.select("t", "r", F.round(F.col("times")[0], 6).alias("first_time"), F.round(F.col("times")[1], 6).alias("second_time"))


def _trmap(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return rows.groupBy(F.col("l_partkey").alias("r")).agg(F.collect_set("l_suppkey").alias("ts"))


_PAIRS = "pairs as (select distinct l_partkey as r, l_suppkey as t from lineitem where l_quantity > 45)"


@query("pair_extract", B.sql(f"also {_PAIRS} select t, r, round(time, 6) as time from arrivals where (t, r) in (select (t, r) from pairs)", "arrivals"))
def pair_extract(spark, sf_dir):
    return pairs.extract_pairs(B.arrivals(spark, sf_dir), _trmap(spark, sf_dir)).select("t", "r", F.round("time", 6).alias("time"))


@query("pair_exclude", B.sql(f"also {_PAIRS} select a.t, a.r, round(time, 6) as time from arrivals a anti join pairs p on a.t = p.t and a.r = p.r", "arrivals"))
def pair_exclude(spark, sf_dir):
    return pairs.exclude_pairs(B.arrivals(spark, sf_dir), _trmap(spark, sf_dir)).select("t", "r", F.round("time", 6).alias("time"))


@query("backscatter", B.sql("select t, r, round(time, 6) as time from arrivals where t = r", "arrivals"))
def backscatter(spark, sf_dir):
    return pairs.backscatter(B.arrivals(spark, sf_dir)).select("t", "r", F.round("time", 6).alias("time"))


@query("exclude_groups", B.sql("select t, r, round(time, 6) as time from arrivals where t // 8 not in (1, 3)", "arrivals"))
def exclude_groups(spark, sf_dir):
    return pairs.exclude_groups(B.arrivals(spark, sf_dir), [1, 3], 8).select("t", "r", F.round("time", 6).alias("time"))


@query("default_window_lookup", B.sql("also known as (select e, (e % 20)::bigint as start, 30::bigint as length from senders where e % 3 = 0) select w.t, w.r, coalesce(k.start, 4)::bigint as start, coalesce(k.length, 50)::bigint as length from waves w left join known k on k.e = w.t", "waves", "senders"))
def default_window_lookup(spark, sf_dir):
    known = B.senders(spark, sf_dir).where("e % 3 = 0").select(F.col("e").alias("t"), (F.col("e") % 20).alias("start"), F.lit(30).cast("long").alias("length"))
    rows = pairs.with_default(B.waves(spark, sf_dir).select("t", "r"), known, {"start": 4, "length": 50}, ["t"])
    return rows.select("t", "r", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))


@query("window_overlap", "select vec_id, greatest(vec_id % 40, 16)::bigint as start, greatest(0, least(vec_id % 40 + 20, 48) - greatest(vec_id % 40, 16))::bigint as length from embeddings")
def window_overlap(spark, sf_dir):
    start, length = A.overlap(F.col("vec_id") % 40, 20, 16, 32)
    return B.table(spark, sf_dir, "embeddings").select("vec_id", start.cast("long").alias("start"), length.cast("long").alias("length"))


@query("key_pack_unpack", B.sql("select t, r, (t << 16 | r)::bigint as key, ((t << 16 | r) >> 16)::bigint as t2, ((t << 16 | r) & 65535)::bigint as r2 from arrivals", "arrivals"))
def key_pack_unpack(spark, sf_dir):
    rows = B.arrivals(spark, sf_dir).select("t", "r", A.pack_key(F.col("t"), F.col("r"), strict=False).alias("key"))
    t, r = A.unpack_key(F.col("key"))
    return rows.select("t", "r", "key", t.alias("t2"), r.alias("r2"))


@query("equiv_keys", B.sql("select least(t // 4, r // 4)::bigint as a, greatest(t // 4, r // 4)::bigint as b, count(*)::bigint as n from waves group by 1, 2", "waves"))
def equiv_keys(spark, sf_dir):
    a, b = A.group_pair(F.col("t"), F.col("r"), 4)
    return B.waves(spark, sf_dir).groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


@query("reciprocal_average", B.sql("select a.t, a.r, a.s, round((a.v + b.v) / 2, 6) as v from samples a join samples b on a.t = b.r and a.r = b.t and a.s = b.s where a.t < a.r", "samples"))
def reciprocal_average(spark, sf_dir):
    rows = rolling.to_samples(pairs.reciprocal_average(B.waves(spark, sf_dir)))
    return rows.select("t", "r", "s", F.round("v", 6).alias("v"))


@query("tx_rows", "select p_partkey as e, ((p_partkey // 8) * 8 + p_partkey % 8)::bigint as tx, (case when (p_partkey // 8) * 8 + p_partkey % 8 < 10 then (p_partkey // 8) * 8 + p_partkey % 8 + 100000000 else (p_partkey // 8) * 8 + p_partkey % 8 end - 10)::bigint as tx_row from part")
def tx_rows(spark, sf_dir):
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("e"))
    groups = part.select("e", (F.col("e") % 8).alias("l"), F.floor(F.col("e") / 8).alias("g"))
    rows = decode.transmit_of(part, groups, None, 8)
    return rows.select("e", "tx", decode.row_of(F.col("tx"), 10, 100_000_000, 100_000_000).alias("tx_row"))


@query("transmit_signs", B.sql("select t, r, (case when t // 8 <> r // 8 then 0 else 1 - 2 * (bit_count((t % 8)::bigint & (r % 8)::bigint) % 2) end)::integer as sign from waves", "waves"))
def transmit_signs(spark, sf_dir):
    sign = decode.transmit_sign(F.col("t") % 8, F.floor(F.col("t") / 8), F.col("r") % 8, F.floor(F.col("r") / 8))
    return B.waves(spark, sf_dir).select("t", "r", sign.alias("sign"))


@query("batch_split", B.sql("select t, r, (ntile(4) over (partition by t order by r) - 1)::integer as batch from arrivals", "arrivals"))
def batch_split(spark, sf_dir):
    return pairs.near_equal_batches(B.arrivals(spark, sf_dir), 4, ["t"], "r").select("t", "r", "batch")


@query("keymat_merge_largest", B.sql("also b as (select t, r, 52 - time as time from arrivals where t % 2 = 0) select t, r, round(max(time), 6) as time from (select * from arrivals union all select * from b) group by t, r", "arrivals"))
def keymat_merge_largest(spark, sf_dir):
    a = B.arrivals(spark, sf_dir)
    rows = pairs.merge_largest(a, a.where("t % 2 = 0").withColumn("time", 52 - F.col("time")))
    return rows.select("t", "r", F.round("time", 6).alias("time"))


@query("keymat_merge_last", B.sql("select t, r, round(case when t % 2 = 0 then 52 - time else time end, 6) as time from arrivals", "arrivals"))
def keymat_merge_last(spark, sf_dir):
    a = B.arrivals(spark, sf_dir)
    rows = pairs.merge_last(a, a.where("t % 2 = 0").withColumn("time", 52 - F.col("time")))
    return rows.select("t", "r", F.round("time", 6).alias("time"))


@query("cached_delays", B.sql("select t, r, round(case when r % 4 = 0 then -1 else time end, 6) as time from arrivals", "arrivals"))
def cached_delays(spark, sf_dir):
    a = B.arrivals(spark, sf_dir)
    cache = a.where("r % 4 = 0").withColumn("time", F.lit(-1.0))
    return pairs.uncached(a, cache).unionByName(cache).select("t", "r", F.round("time", 6).alias("time"))


@query("capture_shape", "select (vec_id % 25)::bigint as channel, count(*)::bigint as n, count(distinct vec_id // 25)::bigint as reps from embeddings group by 1")
def capture_shape(spark, sf_dir):
    rows = B.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("channel"), F.floor(F.col("vec_id") / 25).alias("rep"))
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.countDistinct("rep").alias("reps"))


@query("round_trip_times", B.sql("select s.e, p.e as f, round(2 * (sqrt(pow(s.x - p.x, 2) + pow(s.y - p.y, 2) + pow(s.z - p.z, 2)) - 0.25) / 1.5 + 3, 6) as time from senders s, reflectors p", "senders", "reflectors"))
def round_trip_times(spark, sf_dir):
    near = B.reflectors(spark, sf_dir)
    rows = pairs.round_trip_times(B.senders(spark, sf_dir), near, 1.5, 0.25, 3.0)
    order = near.agg(F.array_sort(F.collect_list("e")).alias("fs"))
    rows = rows.crossJoin(F.broadcast(order)).select("e", F.explode(F.arrays_zip("fs", "times")).alias("p"))
    return rows.select("e", F.col("p.fs").alias("f"), F.round("p.times", 6).alias("time"))


_SETS = B.sql("""also a as (select distinct t, r from arrivals where time < 25), b as (select distinct t, r from arrivals where time > 20)
select 'common' as kind, count(*)::bigint as n from (select * from a intersect select * from b) union all select 'less', count(*)::bigint from (select * from a except select * from b)
union all select 'all', count(*)::bigint from (select * from a union select * from b) union all select 'elements', count(*)::bigint from (select t from a union select r from a)""", "arrivals")


@query("set_ops", _SETS)
def set_ops(spark, sf_dir):
    rows = B.arrivals(spark, sf_dir)
    a, b = rows.where("time < 25").select("t", "r"), rows.where("time > 20").select("t", "r")
    n = lambda kind, d: d.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    ends = a.select("t").unionByName(a.select(F.col("r").alias("t"))).distinct()
    return n("common", a.intersect(b)).unionByName(n("less", a.subtract(b))).unionByName(n("all", a.unionByName(b).distinct())).unionByName(n("elements", ends))


@query("element_rows", B.sql("select r, (dense_rank() over (order by r) - 1)::bigint as place, n from (select r, count(*)::bigint as n from arrivals group by r)", "arrivals"))
def element_rows(spark, sf_dir):
    counts = B.arrivals(spark, sf_dir).groupBy("r").agg(F.count("*").alias("n"))
    return rolling.numbered(counts, ["r"]).select("r", F.col("_k").cast("long").alias("place"), "n")


@query("equalize_group", B.sql("also peaks as (select t, r, max(abs(v)) as peak from samples group by t, r), top as (select t, max(peak) as g from peaks group by t) select x.t, x.r, x.s, round(v / g, 6) as v from samples x join top on top.t = x.t", "samples"))
def equalize_group(spark, sf_dir):
    w = B.waves(spark, sf_dir).withColumn("peak", F.array_max(A.magnitude(F.col("data"))))
    rows = rolling.to_samples(pairs.equalize(w, ["t"]))
    return rows.select("t", "r", "s", F.round("v", 6).alias("v"))


@query("longest_groups", "with n as (select l_suppkey as t, l_partkey as r, count(*) as n, sum(l_quantity) as q from lineitem group by 1, 2) select t, r, n::bigint as n, round(q, 4) as q from n where n = (select max(n) from n)")
def longest_groups(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("t"), F.col("l_partkey").alias("r"), F.col("l_orderkey").alias("file"), F.col("l_quantity").alias("data"))
    held = pairs.longest_groups(rows)
    return held.select("t", "r", F.size("members").cast("long").alias("n"), F.round(F.aggregate("members", F.lit(0.0), lambda a, v: a + v), 4).alias("q"))


@query("peak_limits", B.sql("also peaks as (select t, r, max(abs(v)) as peak from samples group by t, r) select round(max(peak), 6) as top, round(avg(peak) + 2 * stddev_pop(peak), 6) as soft, round(median(peak), 6) as middle, count(*)::bigint as n from peaks", "samples"))
def peak_limits(spark, sf_dir):
    w = B.waves(spark, sf_dir).select(F.array_max(A.magnitude(F.col("data"))).alias("p"))
    return w.agg(F.round(F.max("p"), 6).alias("top"), F.round(F.avg("p") + 2 * F.stddev_pop("p"), 6).alias("soft"), F.round(F.percentile("p", F.lit(0.5)), 6).alias("middle"), F.count("*").alias("n"))


@query("content_owners", "select item_id, sha256(text) as digest, (row_number() over (partition by sha256(text) order by item_id) - 1)::bigint as place, count(*) over (partition by sha256(text))::bigint as holders from benchmark")
def content_owners(spark, sf_dir):
    rows = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), F.sha2("text", 256).alias("hash"))
    out = pairs.content_owners(rows)
    return out.select(F.col("path").alias("item_id"), F.col("hash").alias("digest"), F.col("place").cast("long").alias("place"), "holders")


@query("number_ranges", "select unnest([2, 5, 7, 8, 9, 10, 11, 12])::bigint as n")
def number_ranges(spark, sf_dir):
    return spark.range(1).select(F.explode(A.number_ranges(F.lit("5, 2,7-12,8-9"))).alias("n"))


@query("random_pairs", B.sql("select floor(count(*) * 0.1)::bigint as n, floor(count(*) * 0.1)::bigint as distinct_pairs, floor(count(*) * 0.1)::bigint as known, true as alike from arrivals", "arrivals"))
def random_pairs(spark, sf_dir):
    """A tenth of the pairs, each once, all of them there, the same when drawn again."""
    rows = B.arrivals(spark, sf_dir)
    one, two = pairs.random_pairs(rows, 0.1, 7), pairs.random_pairs(rows, 0.1, 7)
    known = one.join(rows.select("t", "r"), ["t", "r"], "left_semi").agg(F.count("*").alias("known"))
    same = one.select("t", "r").exceptAll(two.select("t", "r")).agg((F.count("*") == 0).alias("alike"))
    return one.agg(F.count("*").alias("n"), F.countDistinct("t", "r").alias("distinct_pairs")).crossJoin(known).crossJoin(same)


@query("shuffled", B.sql("select t, r, round(time, 6) as time from arrivals", "arrivals"))
def shuffled(spark, sf_dir):
    return pairs.shuffled(B.arrivals(spark, sf_dir), 3).select("t", "r", F.round("time", 6).alias("time"))


@query("arrival_columns", B.sql("also parts as (select l_suppkey as t, l_partkey as r, l_linenumber % 2 as f, list(l_quantity order by l_quantity) as v from lineitem group by 1, 2, 3), whole as (select t, r, flatten(list(v order by f)) as v from parts group by t, r) select t, r, round(v[1] * 20, 4) as first, round(v[-1] * 20, 4) as last from whole where len(v) = (select max(len(v)) from whole)", "arrivals"))
def arrival_columns(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem")
    file = lambda k: rows.where(F.col("l_linenumber") % 2 == k).groupBy(F.col("l_suppkey").alias("t"), F.col("l_partkey").alias("r")).agg(F.array_sort(F.collect_list("l_quantity")).alias("values"))
    out = arrivals.arrival_columns([file(0), file(1)], [0, -1], 20.0)
    return out.select("t", "r", F.round(F.col("times")[0], 4).alias("first"), F.round(F.col("times")[1], 4).alias("last"))


@query("merged_batches", "select l_suppkey as src, l_linenumber::bigint as grp, (row_number() over (partition by l_suppkey, l_linenumber order by l_orderkey, l_partkey, l_quantity) - 1)::bigint as pos from lineitem")
def merged_batches(spark, sf_dir):
    """Groups cut into three batches of their own numbering, put together again and dealt by group."""
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").cast("long").alias("grp"), F.struct("l_orderkey", "l_partkey", "l_quantity").alias("o"))
    cut = pairs.near_equal_batches(rows, 3, ["src", "grp"], "o")
    local = cut.withColumn("pos", F.row_number().over(W.partitionBy("src", "grp", "batch").orderBy("o")).cast("long") - 1)
    return pairs.regroup(pairs.merge_batches(local)).select("src", "grp", "pos")


@query("member_shifts", B.sql("also w as (select t, r, 2.0::double + r % 3 as first, 2.0::double + (r % 3) * 2 as second from waves) select t, r, 0::bigint as member, 0.0::double as shift from w union all select t, r, 1, case when r % 4 = 0 then 0 else first - second end from w", "waves"))
def member_shifts(spark, sf_dir):
    w = B.waves(spark, sf_dir)
    groups = w.select("t", "r", F.array("data", "data").alias("members"))
    times = w.where("r % 4 <> 0").select("t", "r", F.array(2.0 + F.col("r") % 3, 2.0 + F.col("r") % 3 * 2).alias("times"))
    rows = pairs.shifted_members(groups, times)
    return rows.select("t", "r", F.col("member").cast("long").alias("member"), F.col("shift").cast("double").alias("shift"))


@query("content_hash", "select item_id, sha256(unhex(substring(hex(encode(text)), 1, 40))) as digest from benchmark")
def content_hash(spark, sf_dir):
    """Names of the first bytes; the second engine has 256 bits only, so those are shown."""
    rows = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    named = pairs.content_hash(rows, 20)
    check = rows.select("path", F.sha2(F.substring("content", 1, 20), 512).alias("hash"), F.sha2(F.substring("content", 1, 20), 256).alias("digest"))
    return named.join(check, ["path", "hash"]).select(F.col("path").alias("item_id"), "digest")


@query("first_hits", B.sql("select t, r, tri from (select l_suppkey as t, l_linenumber::bigint as r, l_partkey as tri, row_number() over (partition by l_suppkey, l_linenumber order by l_extendedprice, l_partkey) as k from lineitem) where k <= 2", "arrivals"))
def first_hits(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("t"), F.col("l_linenumber").cast("long").alias("r"), F.col("l_partkey").alias("tri"), F.col("l_extendedprice").alias("at"))
    return geometry.first_hits(rows, 2).select("t", "r", "tri")


def _records(spark, sf_dir):
    """A channel each 20 embeddings, transmissions in groups of four."""
    k = F.col("vec_id")
    return B.table(spark, sf_dir, "embeddings").select(
        F.floor(k / 20).alias("rid"), (k % 20).alias("row"), (F.floor(k / 20) % 4).alias("li"), F.floor(F.floor(k / 20) / 4).alias("gi"), *((F.floor(k / 20) * s).cast("double").alias(c) for c, s in (("px", 1.0), ("py", 0.5), ("pz", 0.25))),
        F.lit(4).cast("long").alias("ws"), F.lit(64).cast("long").alias("wl"), F.col("embedding").cast("array<double>").alias("data"),
    )


_RECORDS = "also records as (select vec_id // 20 as rid, vec_id % 20 as row, unnest(range(0, 64))::bigint + 4 as s, unnest(embedding)::double as v from embeddings)"


def _record_samples(rows):
    return rolling.to_samples(rows, keys=("rid", "row"), start="ws").select("rid", "row", "s", F.round("v", 6).alias("v"))


@query("record_window", "with " + _RECORDS.removeprefix("also ") + ", g as (select unnest(range(0, 3)) as place, unnest([7, 0, 19])::bigint as row), s as (select unnest(range(-2, 10))::bigint as s) select place::bigint as place, g.row, s.s, round(coalesce(v, 0), 6) as v from g, s left join records r on r.rid = 3 and r.row = g.row and r.s = s.s")
def record_window(spark, sf_dir):
    rows = decode.select_record(_records(spark, sf_dir), 3, [7, 0, 19], -2, 12)
    return rolling.to_samples(rows, keys=("place", "row"), start="ws").select(F.col("place").cast("long").alias("place"), "row", "s", F.round("v", 6).alias("v"))


@query("record_headers", "select distinct vec_id // 20 as rid, vec_id // 20 % 4 as li, vec_id // 20 // 4 as gi, (vec_id // 20)::double as px, (vec_id // 20) * 0.5::double as py, (vec_id // 20) * 0.25::double as pz, 4::bigint as ws, 64::bigint as wl from embeddings")
def record_headers(spark, sf_dir):
    return decode.headers(_records(spark, sf_dir))


@query("record_global_time", "with " + _RECORDS.removeprefix("also ") + " select rid, row, s - 9 as s, round(v, 6) as v from records where s >= 9")
def record_global_time(spark, sf_dir):
    return _record_samples(decode.to_global_time(_records(spark, sf_dir), -9, 72))


@query("changed_records", "with " + _RECORDS.removeprefix("also ") + " select rid, row, s, round(case when rid % 3 = 1 then -2 * v when rid % 3 = 2 then 0 else v end, 6) as v from records where rid % 5 <> 0 or rid > 10".replace("rid % 5 <> 0 or rid > 10", "rid not in (0, 5, 10)"))
def changed_records(spark, sf_dir):
    """Some channels replaced, some emptied, some deleted."""
    rows = _records(spark, sf_dir)
    twice = rows.where("rid % 3 = 1").withColumn("data", A.scale(F.col("data"), -2.0))
    empty = rows.where("rid % 3 = 2").withColumn("data", F.lit(None).cast("array<double>"))
    return _record_samples(decode.delete_records(decode.upsert_records(rows, twice.unionByName(empty), 68), [0, 5, 10]))


@query("group_map_faults", "select distinct vec_id // 20 as e from embeddings where vec_id // 20 % 7 = 3")
def group_map_faults(spark, sf_dir):
    heads = decode.headers(_records(spark, sf_dir))
    claimed = heads.select(F.col("rid").alias("e"), F.col("li").alias("l"), (F.col("gi") + F.when(F.col("rid") % 7 == 3, 1).otherwise(0)).alias("g"))
    return decode.check_group_map(claimed, heads).select("e")


@query("transmissions", "with n as (select count(*) as n from supplier), r as (select unnest(range(0, n)) as row, n from n) select row::bigint as row, ((row + 5) % n)::bigint as tx, ((row + 5) % n)::bigint as e, 0::bigint as l, row::bigint as g from r")
def transmissions(spark, sf_dir):
    n = B.table(spark, sf_dir, "supplier").count()
    rows = decode.transmit_indices(spark, 5, n, n)
    return rows.join(decode.single_groups(rows).withColumn("row", F.col("g")), "row").select("row", "tx", "e", "l", "g")
