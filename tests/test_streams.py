"""Streams: resumed drains, several subscribers, rows that come twice, empty streams."""

import pytest
from pyspark.sql import functions as F

from nestra.sources.shared import stream
from nestra.streaming import replay


def write(spark, path, ids):
    spark.createDataFrame([(i, f"k{i % 3}") for i in ids], "id long, kind string").coalesce(1).write.mode("append").parquet(path)


def test_a_drain_goes_on_where_it_was(spark, tmp_path):
    folder, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")
    write(spark, f"{folder}/t.parquet", range(5))
    rows = stream(spark, folder, "t", files_per_batch=1)
    assert replay.drain(rows, out, at).count() == 5
    write(spark, f"{folder}/t.parquet", range(5, 9))
    assert sorted(r.id for r in replay.drain(rows, out, at).collect()) == list(range(9))
    assert replay.drain(rows, out, at).count() == 9
    assert replay.drain(rows.where("id > 6")).count() == 2  # another subscriber, from the start


def test_totals_over_several_batches(spark, tmp_path):
    for ids in (range(4), range(4, 10), []):
        write(spark, f"{tmp_path}/t.parquet", ids)
    totals = replay.call_totals(stream(spark, str(tmp_path), "t", files_per_batch=1), "kind", "id", 7)
    assert {(r.method, r.calls, r.errors, r.min_ms, r.max_ms) for r in replay.latest(totals, ["method"], f"{tmp_path}/at").collect()} == {("k0", 4, 1, 0, 9), ("k1", 3, 0, 1, 7), ("k2", 3, 1, 2, 8)}
    assert replay.latest(totals, ["method"], f"{tmp_path}/at").count() == 3  # nothing new
    write(spark, f"{tmp_path}/t.parquet", [30])
    assert {(r.method, r.calls, r.max_ms) for r in replay.latest(totals, ["method"], f"{tmp_path}/at").collect()} == {("k0", 5, 30), ("k1", 3, 7), ("k2", 3, 8)}
    assert replay.latest(totals.where("calls < 0"), ["method"]).collect() == []


def test_windows_close_behind_the_watermark(spark, tmp_path):
    def come(hours):
        spark.sql(f"SELECT 'k' kind, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) ts FROM VALUES {','.join(f'({h})' for h in hours)} AS x(h)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/t.parquet")

    come([0, 0, 1])
    counts = replay.windowed(stream(spark, f"{tmp_path}/in", "t"), "ts", "kind", "1 hour", "2 hours")
    now = lambda: sorted((r.begin.hour, r.n) for r in replay.latest(counts, ["begin", "kind"], f"{tmp_path}/at").collect())
    assert now() == [(0, 2), (1, 1)]
    come([9, 1])
    now()
    come([0, 9])  # the first hour is long closed
    assert now() == [(0, 2), (1, 2), (9, 2)]


def test_ids_have_no_gaps_over_batches(spark, tmp_path):
    for ids in ([5, 3], [9, 7, 8]):
        write(spark, f"{tmp_path}/in/t.parquet", ids)
    rows = stream(spark, f"{tmp_path}/in", "t", files_per_batch=1)
    first = {r.id: r.message_id for r in replay.with_ids(rows, ["id"], checkpoint=f"{tmp_path}/at").collect()}
    assert sorted(first.values()) == [0, 1, 2, 3, 4] and first[3] + 1 == first[5] and first[7] + 1 == first[8]
    write(spark, f"{tmp_path}/in/t.parquet", [1])
    assert {r.id: r.message_id for r in replay.with_ids(rows, ["id"], checkpoint=f"{tmp_path}/at").collect()} == first | {1: 5}


def test_a_full_queue_fails_and_keeps_nothing(spark, tmp_path):
    write(spark, f"{tmp_path}/in/t.parquet", range(5))
    rows = stream(spark, f"{tmp_path}/in", "t")
    assert replay.bounded(rows, 5, f"{tmp_path}/a", f"{tmp_path}/a-at").count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        replay.bounded(rows, 4, f"{tmp_path}/b", f"{tmp_path}/b-at")
    assert not (tmp_path / "b").exists()


def test_handlers_subscribers_and_metrics(spark, tmp_path):
    told = replay.Metrics()
    spark.streams.addListener(told)
    rows = replay.handled(spark, "numbers", "id long, half double", lambda: 100, lambda a, b: ((i, i / 2) for i in range(a, b)))
    assert replay.drain(rows).selectExpr("count(*) n", "sum(id) s", "sum(half) h").first() == (100, 4950, 2475)
    seen = []
    query = replay.subscribe(rows, lambda batch, number: seen.append(batch.count()), f"{tmp_path}/at")
    query.processAllAvailable()
    query.stop()
    assert not query.isActive and sum(seen) == 100
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(told)
    assert sum(q["rows"] for q in told.queries.values()) >= 100 and all(q["errors"] == 0 for q in told.queries.values())


def test_redelivered_rows_count_once(spark, tmp_path):
    spark.sql("SELECT explode(array(1, 2, 2, 3, 1)) id, timestamp_ntz'2024-01-01 00:00:00' ts").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert sorted(r.id for r in replay.drain(replay.once(stream(spark, str(tmp_path), "t"), "id", "ts", "1 hour")).collect()) == [1, 2, 3]


def test_a_failed_batch_fails_the_stream(spark, tmp_path):
    write(spark, f"{tmp_path}/t.parquet", range(3))
    rows = stream(spark, str(tmp_path), "t").select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception, match="no"):
        replay.drain(rows.select(F.col("x").cast("string")))
