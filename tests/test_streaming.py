from pyspark.sql import functions as F

from lexitide.streaming.live import clean_stream


def test_clean_stream(spark, tmp_path):
    rows = [(1, 0, 0, 10, "a"), (1, 1, 0, 10, " a "), (1, 2, 5, 5, "no time"), (1, 3, 20, 30, ""), (1, 4, 20, 30, "啊" * 30), (2, 0, 0, 10, "a")]
    df = spark.createDataFrame(rows, "media_id long, seg_idx long, start_ms long, end_ms long, text string").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = clean_stream(stream).writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.media_id, r.text.strip()) for r in spark.table("live").collect()) == [(1, "a"), (2, "a")]
