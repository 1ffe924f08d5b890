"""Streams: each value once, also over restarts; counters; bounded state."""

import pytest
from helpers import values
from pyspark.sql import functions as F

from contactmine.operators import extract
from contactmine.streaming import contacts as stream
from contactmine.streaming import totals as live
from contactmine.streaming.progress import ContactProgress

FIRST = [("s1", "a@x.com a@x.com http://h.com/1"), ("s2", "a@x.com b@x.com")]
SECOND = [("s3", "b@x.com c@x.com http://h.com/2"), ("s4", "http://g.com/1")]


@pytest.fixture
def drop(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def add(rows):
        frame = spark.createDataFrame(rows, "source_id string, text string")
        frame.coalesce(1).write.mode("append").parquet(str(folder))

    add.folder = str(folder)
    return add


def source(spark, folder):
    texts = spark.readStream.schema("source_id string, text string").parquet(folder)
    return extract.extract_contacts(texts, extract.LOOSE_EMAILS, extract.OVERLAPPING_URLS)


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.mark.parametrize("combine", [True, False])
def test_each_value_once_over_restarts(spark, drop, tmp_path, combine):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    progress = ContactProgress(keep=50)
    spark.streams.addListener(progress)
    for rows in (FIRST, SECOND):
        drop(rows)
        found = stream.first_seen(source(spark, drop.folder), ["kind", "value"], combine=combine)
        run(stream.start(found, checkpoint, out, available_now=True))
    written = spark.read.parquet(out)
    assert values(written) == [
        "a@x.com", "b@x.com", "c@x.com", "http://g.com/1", "http://h.com/1", "http://h.com/2"
    ]
    found = stream.first_seen(source(spark, drop.folder), ["kind", "value"], combine=combine)
    run(stream.start(found, checkpoint, out, available_now=True))
    assert spark.read.parquet(out).count() == 6
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    spark.streams.removeListener(progress)
    assert progress.values == 6 and progress.emails == 3 and progress.rows_read == 4
    assert progress.rows_per_second > 0 and any("batch" in line for line in progress.log)


def test_one_link_per_host_to_callback(spark, drop, tmp_path):
    seen = []
    for rows in (FIRST, SECOND):
        drop(rows)
        keyed = stream.by_host(source(spark, drop.folder))
        found = stream.first_seen(keyed, ["kind", "key"])
        run(stream.start(
            found, str(tmp_path / "ck"), available_now=True,
            on_batch=lambda batch, _: seen.extend(r.value for r in batch.select("value").collect()),
        ))
    assert sorted(seen) == ["a@x.com", "b@x.com", "c@x.com", "http://g.com/1", "http://h.com/1"]


def test_stop_and_go_on(spark, drop, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    drop(FIRST)
    query = stream.start(
        stream.first_seen(source(spark, drop.folder), ["kind", "value"]), checkpoint, out, name="going"
    )
    query.processAllAvailable()
    query.stop()
    drop(SECOND)
    found = stream.first_seen(source(spark, drop.folder), ["kind", "value"])
    run(stream.start(found, checkpoint, out, available_now=True))
    assert spark.read.parquet(out).count() == 6


def test_bounded_state(spark, drop, tmp_path):
    out = str(tmp_path / "out")
    drop([*FIRST, *FIRST])
    timed = source(spark, drop.folder).withColumn("seen_at", F.current_timestamp())
    found = stream.first_seen(timed, ["kind", "value"], "seen_at", "1 hour")
    run(stream.start(found, str(tmp_path / "ck"), out, available_now=True))
    assert values(spark.read.parquet(out)) == ["a@x.com", "b@x.com", "http://h.com/1"]


def test_live_totals_by_reason(spark, tmp_path):
    """Three batches, copies within and across them, rows that come too late."""
    folder = tmp_path / "events"
    folder.mkdir()
    schema = "kind string, value string, at timestamp"
    batches = [
        [("email", "a@x.com", "10:00"), ("email", "a@x.com", "10:01"), ("email", "b@trash.net", "10:02"), ("url", "http://bad.org/1", "10:03")],
        [("email", "a@x.com", "10:08"), ("email", "c@x.com", "10:12"), ("email", "d@9.com", "10:13"), ("url", "http://good.org/", "10:14"), ("email", "e@x.com", "10:04")],
        [("email", "late@x.com", "09:00"), ("email", "f.png@x.com", "10:40"), ("email", "g@x.com", "10:41"), ("email", "late2@x.com", "10:02")],
        [("email", "late3@x.com", "10:05"), ("email", "h@x.com", "10:45")],
    ]
    lists = [spark.createDataFrame([(e,)], "entry string") for e in ("trash.net", "bad.org")]
    seen = {}

    def keep(rows, _):
        seen.update({(r.window.start.strftime("%H:%M"), r.kind, r.reason): r.n_values for r in rows.collect()})

    for rows in batches:
        frame = spark.createDataFrame([(k, v, f"2026-01-01 {t}:00") for k, v, t in rows], "kind string, value string, at string")
        frame.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(folder))
        contacts = spark.readStream.schema(schema).parquet(str(folder))
        totals = live.totals_by_reason(live.snapshot_verdicts(contacts, *lists), "at", "20 minutes", "10 minutes")
        run(live.start(totals, str(tmp_path / "ck"), keep, available_now=True))
    assert seen == {
        ("10:00", "email", "kept"): 3, ("10:00", "email", "disposable"): 1, ("10:00", "url", "blocked_host"): 1,
        ("10:10", "email", "kept"): 1, ("10:10", "email", "digit"): 1, ("10:10", "url", "kept"): 1, ("10:40", "email", "kept"): 3,
    }
