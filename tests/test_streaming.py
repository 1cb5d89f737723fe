from __future__ import annotations

from kashida.streaming import ingest


def test_uploads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("دل ملیں\nخواب ملیں\n###GHZ###\nدل  ملیں\nخواب ملیں")
    (tmp_path / "in" / "b.txt").write_text("x\ny z\nu\nv z")
    got = []
    q = ingest.each_batch(ingest.fresh_blocks(ingest.uploads(spark, str(tmp_path / "in"))), lambda items, features, n: got.append((items.count(), {(r.radif, r.confidence) for r in features.collect()}))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(n for n, _ in got) == 2 and set().union(*(f for _, f in got)) == {("ملیں", 1.0), ("z", 1.0)}


def test_windows(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", 7, "view"), (2, "2024-01-01 00:50:00", 7, "view"), (3, "2024-01-01 02:10:00", 7, "click")], "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "to_timestamp(ts) ts", "user_id", "event_type").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "e"))
    q = ingest.activity(stream).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n) for r in spark.table("activity").collect()) == [("click", 1), ("view", 2)]
    s = ingest.sessions(spark.read.parquet(str(tmp_path / "e")))
    assert sorted(r.n for r in s.collect()) == [1, 1, 1]
