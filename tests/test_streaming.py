from fathomline.streaming.pings import sessions, window_counts


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = window_counts(stream, late="400 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(120)
    whole = {(r.start, r.kind): r.n for r in window_counts(events).collect()}
    assert {(r.start, r.kind): r.n for r in spark.table("counts").collect()} == whole
    assert sum(r.n for r in sessions(events).collect()) == events.count()
