import json

from factloom.streaming.feeds import new_payloads, upsert_stream, windowed_counts

SCHEMA = "source_id string, url string, body string, fetched_at timestamp"


def test_each_payload_comes_once(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    row = {"source_id": "s", "url": "u", "body": "{}", "fetched_at": "2024-01-01T00:00:00Z"}
    (drop / "1.json").write_text("\n".join(json.dumps(r) for r in (row, row, row | {"body": "[]"})))
    seen = []
    q = upsert_stream(new_payloads(spark, str(drop), SCHEMA), lambda df, i: seen.extend(r.body for r in df.collect()), str(tmp_path / "c"))
    q.awaitTermination()
    assert sorted(seen) == ["[]", "{}"]


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    drop = tmp_path / "events"
    batch = spark.read.parquet(src).selectExpr("CAST(ts AS timestamp) ts", "event_type", "value")
    batch.repartition(3).write.parquet(str(drop))
    stream = spark.readStream.schema(batch.schema).parquet(str(drop))
    out = windowed_counts(stream, "ts", "60 days", "1 day", "event_type").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    out.awaitTermination()
    want = windowed_counts(batch, "ts", "60 days", "1 day", "event_type")
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, want.collect()))
