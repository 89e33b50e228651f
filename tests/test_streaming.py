from massloom.streaming import scans

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_match_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS).selectExpr("cast(ts as timestamp) as ts", "event_type as scan_type", "value")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = scans.intensity_by_window(stream, "ts", "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        q.processAllAvailable()
        got = spark.table("windows").count(), spark.table("windows").selectExpr("sum(n)").first()[0]
    finally:
        q.stop()
    assert got[1] == batch.count() and got[0] == scans.intensity_by_window(batch, "ts", "1 day", "1 hour").count()


def test_running_top_k(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", 3.0), (1, "B", 5.0), (1, "C", 4.0), (2, "D", 1.0)], "scan long, peptide string, score double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = scans.running_top_k(stream, 2).writeStream.outputMode("update").format("memory").queryName("best").start()
    try:
        q.processAllAvailable()
        got = {(r.scan, r.rank, r.peptide) for r in spark.table("best").collect()}
    finally:
        q.stop()
    assert got == {(1, 1, "B"), (1, 2, "C"), (2, 1, "D")}
