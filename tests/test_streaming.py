from pyspark.sql import functions as F

from basalt.streaming.trace import once, windowed_counts

SF = "/root/testdata/sf0.001"


def _stream(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    return batch.withColumn("ts", F.col("ts").cast("timestamp")), stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_windows_equal_batch(spark):
    batch, stream = _stream(spark)
    _run(windowed_counts(stream), "complete", "windows")
    want = {tuple(r)[:3] for r in windowed_counts(batch).collect()}
    assert {tuple(r)[:3] for r in spark.table("windows").collect()} == want


def test_once(spark):
    batch, stream = _stream(spark)
    _run(once(stream.union(stream), "event_id"), "append", "seen")
    assert spark.table("seen").count() == batch.count()
