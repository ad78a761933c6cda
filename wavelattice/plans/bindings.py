"""The supplied tables seen as the canonical tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NSAMP = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 receivers a transmission."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.floor(F.col("vec_id") / 25).alias("t"), (F.col("vec_id") % 25).alias("r"), F.lit(NSAMP).cast("long").alias("nsamp"), F.lit(0).cast("long").alias("dstart"), F.col("embedding").cast("array<double>").alias("data"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rolling import to_samples

    return to_samples(waves(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ch, s, v: the events of each user in time order."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "events")
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.select(F.col("user_id").alias("ch"), at.cast("long").alias("s"), F.col("value").alias("v"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("t"), F.col("l_partkey").alias("r")).agg(F.avg("l_quantity").alias("time"))


def senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("e"), (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (k % 7).cast("double").alias("z"))


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("e"), (F.col("p_retailprice") / 100).alias("x"), F.col("p_size").cast("double").alias("y"), (k % 11).cast("double").alias("z"))


def reflectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One a nation."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("e"), (0.5 + k * 0.5).alias("x"), (1.5 + F.col("n_regionkey") * 1.5).alias("y"), (0.25 + (k % 7) * 0.25).alias("z"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path a customer, across a box of 8 x 8 x 8."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("t"), (1_000_000 + n).cast("long").alias("r"), (k * 7 % 61 / 8).alias("sx"), (k * 11 % 59 / 8).alias("sy"), F.lit(0.25).alias("sz"),
        (k * 13 % 53 / 8).alias("ex"), (n * 3 % 25 / 4).alias("ey"), F.lit(7.75).alias("ez"),
    )


def voxels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """vid, v of a grid of one slab of 8 x 8 voxels an embedding, and its shape."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.posexplode("embedding").alias("p", "v")).select((F.col("vec_id") * 64 + F.col("p")).alias("vid"), F.col("v").cast("double").alias("v")), (rows.count(), 8, 8)


def points(rows: DataFrame) -> DataFrame:
    """t, r, points of segments."""
    return rows.select("t", "r", F.array(F.array("sx", "sy", "sz"), F.array("ex", "ey", "ez")).alias("points"))


#: The same as SQL common table expressions.
CTE = {
    "waves": "waves as (select vec_id // 25 as t, vec_id % 25 as r, embedding from embeddings)",
    "samples": "samples as (select t, r, unnest(range(0, 64))::bigint as s, unnest(embedding)::double as v from waves)",
    "series": "series as (select user_id as ch, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as s, value as v from events)",
    "arrivals": "arrivals as (select l_suppkey as t, l_partkey as r, avg(l_quantity) as time from lineitem group by 1, 2)",
    "senders": "senders as (select s_suppkey as e, s_acctbal / 1000 as x, s_nationkey::double as y, (s_suppkey % 7)::double as z from supplier)",
    "reflectors": "reflectors as (select n_nationkey::bigint as e, 0.5::double + n_nationkey * 0.5 as x, 1.5::double + n_regionkey * 1.5 as y, 0.25::double + n_nationkey % 7 * 0.25 as z from nation)",
    "segments": "segments as (select c_custkey as t, (1000000 + c_nationkey)::bigint as r, (c_custkey * 7 % 61)::double / 8 as sx, (c_custkey * 11 % 59)::double / 8 as sy, 0.25::double as sz, (c_custkey * 13 % 53)::double / 8 as ex, (c_nationkey * 3 % 25)::double / 4 as ey, 7.75::double as ez from customer)",
    "voxels": "voxels as (select vec_id * 64 + unnest(range(0, 64)) as vid, unnest(embedding)::double as v from embeddings)",
    "receivers": "receivers as (select p_partkey as e, p_retailprice / 100 as x, p_size::double as y, (p_partkey % 11)::double as z from part)",
}


def sql(body: str, *needed: str) -> str:
    """A query over some of the expressions above."""
    order = [k for k in CTE if k in needed or (k == "waves" and "samples" in needed)]
    return "with " + ", ".join(CTE[k] for k in order) + (", " if body.startswith("also ") else " ") + body.removeprefix("also ")
