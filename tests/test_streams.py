from pyspark.sql import functions as F

from wavelattice.streaming import streams

DATA = "/root/testdata/sf0.001"


def test_streams_append_once_and_skip_what_is_cached(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)], "t long, r long, v double")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream = streams.follow(spark, f"{tmp_path}/in", rows.schema)
        streams.append(stream, f"{tmp_path}/out", f"{tmp_path}/c1", lambda d: d.withColumn("v", F.col("v") * 2)).awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2.0, 4.0, 6.0]

    rows.where("r = 2").write.parquet(f"{tmp_path}/in2")
    for name in ("in2", "in"):
        stream = streams.follow(spark, f"{tmp_path}/{name}", rows.schema)
        streams.append_uncached(stream, f"{tmp_path}/cache", f"{tmp_path}/{name}-c", ["t", "r"], lambda d: d.withColumn("v", -F.col("v")), name).awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/cache").collect()) == [-3.0, -2.0, -1.0]


def test_windows_agree_with_the_batch_form(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(1).write.parquet(f"{tmp_path}/e")
    stream = streams.windowed_levels(streams.follow(spark, f"{tmp_path}/e", events.schema), "ts", "event_type", "value", "1 day", "1 hour")
    query = stream.writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = events.groupBy(F.window("ts", "1 day"), "event_type").count().count()
    assert spark.sql("select sum(n) from levels").first()[0] == events.count() and spark.table("levels").count() == want
