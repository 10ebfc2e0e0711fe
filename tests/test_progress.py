import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from inkwell.operators import progress
from inkwell.streaming import progress as streams

T0 = datetime(2024, 1, 1)


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def test_messages(spark):
    raw = spark.createDataFrame([(1, '{"type":"next"}'), (2, "{broken"), (3, '{"type":"progress","value":0.5}'), (4, '{"type":"progress"}'), (5, '{"type":"other"}'), (6, None)], "id int, value string")
    assert [tuple(r) for r in progress.messages(raw).orderBy("id").collect()] == [(1, "next", None), (3, "progress", 0.5)]


def test_clicks_and_keys(spark):
    rows = spark.createDataFrame([(0.1, "ArrowLeft"), (0.5, "x"), (0.9, " ")], "x double, key string")
    found = rows.select(progress.action_of_click(F.col("x"), F.lit(1.0)), progress.action_of_key(F.col("key"))).collect()
    assert [tuple(r) for r in found] == [("prev", "prev"), (None, None), ("next", "next")]


def test_debounce_keeps_the_last_of_each_run(spark):
    rows = [("a", at(0), 0.1), ("a", at(200), 0.2), ("a", at(499), 0.3), ("a", at(900), 0.4), ("b", at(0), 0.9)]
    found = progress.debounced(spark.createDataFrame(rows, "k string, ts timestamp, value double"), keys=["k"])
    assert sorted(map(tuple, found.collect())) == [("a", at(499), 0.3), ("a", at(900), 0.4), ("b", at(0), 0.9)]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert progress.loaded(spark, path).count() == 0
    updates = spark.createDataFrame([("a", 1, 0.5, at(0)), ("a", 2, 0.1, at(5)), ("b", 9, 0.0, at(0))], progress.STORE)
    progress.saved_to(progress.upserted(progress.loaded(spark, path), updates), path)
    again = progress.loaded(spark, path)
    assert sorted((r.book_path, r.chapter_index) for r in again.collect()) == [("a", 2), ("b", 9)]
    books = spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], "path string, n_chapters int")
    assert sorted(map(tuple, progress.restored(books, again).collect())) == [("a", 3, 2), ("b", 3, 0), ("c", 3, 0)]
    (tmp_path / "broken.json").write_text("{not json")
    assert progress.loaded(spark, f"file://{tmp_path}/broken.json").count() == 0


def test_cursor_stays_in_the_book(spark):
    rows = [("a", at(i), kind) for i, kind in enumerate(["prev", "next", "next", "next", "other", "prev"])] + [("b", at(0), "prev")]
    found = progress.cursor(spark.createDataFrame(rows, "k string, ts timestamp, type string"), keys=["k"], last_chapter=F.lit(2))
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("b", 0)]


def test_ties(spark):
    rows = [("a", at(5), 1, 0.5), ("a", at(5), 3, 0.1), ("a", at(5), 2, 0.9)]
    events = spark.createDataFrame(rows, "k string, ts timestamp, n int, value double")
    assert progress.latest(events, keys=["k"], ts_col="ts", value_cols=["value"], order_cols=["n"]).first().value == 0.1
    store = spark.createDataFrame([("a", 9, 0.9, at(5)), ("b", 9, 0.9, at(6))], progress.STORE)
    new = spark.createDataFrame([("a", 1, 0.1, at(5)), ("b", 1, 0.1, at(5))], progress.STORE)
    assert sorted((r.book_path, r.chapter_index) for r in progress.upserted(store, new).collect()) == [("a", 1), ("b", 9)]


def test_cursor_over_many_spans(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(3)}", T0 + timedelta(minutes=rng.randrange(6000)), rng.choice(["next", "next", "prev"]), i) for i in range(3000)]
    events = spark.createDataFrame(rows, "k string, ts timestamp, type string, n int")
    for last in (0, 3, 40):
        wanted = {}
        for k, _, kind, _ in sorted(rows, key=lambda r: (r[1], r[3])):
            wanted[k] = min(last, wanted.get(k, 0) + 1) if kind == "next" else max(0, wanted.get(k, 0) - 1)
        found = progress.cursor(events, keys=["k"], last_chapter=F.lit(last), order_cols=["n"])
        assert {r.k: r.chapter for r in found.collect()} == wanted


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_streams(spark, tmp_path):
    schema = "k string, ts timestamp, type string, value double"
    rows = [("a", at(0), "next", 0.1), ("a", at(100), "next", 0.2), ("a", at(2000), "prev", 0.3), ("b", at(0), "prev", 0.4), ("z", at(10_000_000), "next", 0.5)]
    events = stream(spark, tmp_path, rows, schema)
    out = streams.debounced(streams.timed(events, late="1 second"), keys=["k"])
    query = out.writeStream.outputMode("append").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    found = sorted((r.k, r.value) for r in spark.table("runs").collect())
    assert found == [("a", 0.2), ("a", 0.3), ("b", 0.4)]
    query = streams.cursor(events, key_col="k", last_chapter=5).writeStream.outputMode("update").format("memory").queryName("places").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("places").collect())) == [("a", 1), ("b", 0), ("z", 1)]


def test_store_by_batches(spark, tmp_path):
    top = f"file://{tmp_path}/kept"
    schema = progress.STORE
    updates = stream(spark, tmp_path, [("a", 1, 0.5, at(0)), ("b", 2, 0.0, at(0))], schema)
    for more in ([], [("a", 7, 0.1, at(9))]):
        if more:
            stream(spark, tmp_path, more, schema)
        query = streams.keep_store(updates, top, str(tmp_path / "c3")).start()
        query.processAllAvailable()
        query.stop()
    store = spark.read.parquet(f"{top}/v{streams.latest_version(spark, top)}")
    assert sorted((r.book_path, r.chapter_index) for r in store.collect()) == [("a", 7), ("b", 2)]
