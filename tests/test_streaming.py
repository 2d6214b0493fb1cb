"""Streaming forms on a replayed table."""

from rillrank.streaming import live


def test_session_counts(spark):
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(
        "/root/testdata/sf0.001/", pathGlobFilter="events.parquet"
    )
    query = live.session_counts(events, gap="4 hours").writeStream.format("memory").queryName("live_sessions").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    totals = spark.sql("select sum(events) e, sum(clicks) c from live_sessions").first()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert totals.e == events.count() and totals.c == events.where("event_type = 'click'").count()
