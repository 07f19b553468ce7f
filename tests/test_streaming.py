import json
from datetime import datetime, timedelta

import pytest
from rowtools import as_tuples
from pyspark.sql import functions as F

from postprism.functions.dates import posting_time
from postprism.operators.conform import posting_key
from postprism.sources import feeds
from postprism.streaming import intake

SCHEMA = "event_id long, ts timestamp_ntz, item string"
START = datetime(2024, 1, 4)  # a window of seven days starts here


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.fixture
def stream(spark, tmp_path):
    def open_stream():
        from pyspark.sql.types import _parse_datatype_string

        return (
            spark.readStream.schema(_parse_datatype_string(SCHEMA))
            .option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", 1)
            .parquet(str(tmp_path / "in"))
        )

    (tmp_path / "in").mkdir()
    return open_stream


def test_intake_takes_each_file_once(spark, stream, tmp_path):
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    land(spark, folder, "a", [(1, START, "x")])
    intake.append_stream(stream(), out, state, 1)
    land(spark, folder, "b", [(2, START, "y"), (3, START, "x")])
    intake.append_stream(stream(), out, state, 2)
    intake.append_stream(stream(), out, state, 3)
    assert sorted(as_tuples(spark.read.parquet(out), "collection_id", "event_id")) == [(1, 1), (2, 2), (2, 3)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_repeats_across_batches_are_dropped(spark, stream, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        folder = str(tmp_path / "in")
        land(spark, folder, "a", [(1, START, "x"), (2, START, "x"), (3, START, "y")])
        land(spark, folder, "b", [(4, START + timedelta(days=1), "x"), (5, START + timedelta(days=1), "z")])
        first = intake.dedup_stream(stream(), ["item"], "ts", "30 days")
        table = intake.run_to_table(first.select("item", "ts"), str(tmp_path / "out"), str(tmp_path / "state"))
        assert sorted(row[0] for row in as_tuples(table, "item")) == ["x", "y", "z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture
def state_on_disk(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", intake.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_repeats_are_never_forgotten(spark, stream, tmp_path, state_on_disk):
    """History, repeats within and across batches, a stop and a restart, an early row that arrives late, and NULL keys."""
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    history = spark.createDataFrame([("old", START), ("old", START)], "item string, ts timestamp_ntz")

    def run():
        first = intake.dedup_against_history(stream(), ["item"], ["event_id"], history)
        return sorted(as_tuples(intake.run_to_table(first, out, state), "event_id", "item"), key=str)

    land(spark, folder, "a", [(9, START, "x"), (4, START, "x"), (5, START, "old"), (6, START, None), (7, START, None)])
    assert run() == [(4, "x"), (6, None)]
    # Years later, and with a smaller id than what was kept.
    land(spark, folder, "b", [(1, START + timedelta(days=3_000), "x"), (11, START, "y"), (12, START, "old")])
    land(spark, folder, "c", [(2, START, "y"), (3, START, "z"), (13, START, None)])
    assert run() == sorted([(4, "x"), (6, None), (11, "y"), (3, "z")], key=str) or run() == sorted([(4, "x"), (6, None), (2, "y"), (3, "z")], key=str)
    assert len(run()) == 4  # nothing new


def test_history_needs_its_state_store(spark, stream):
    with pytest.raises(ValueError, match="providerClass"):
        intake.dedup_against_history(stream(), ["item"], ["event_id"])


def test_window_shares_over_batches(spark, stream, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, "a", [(i, START + timedelta(hours=i), "x" if i % 3 else "y") for i in range(6)])
    land(spark, folder, "b", [(9, START + timedelta(days=8), "y"), (10, START + timedelta(days=6, hours=23), "x")])
    counts = intake.window_counts(stream(), "ts", "item", "7 days", "1 hour")
    table = intake.window_shares(intake.run_updates(counts, str(tmp_path / "out"), str(tmp_path / "state")))
    assert sorted(as_tuples(table)) == [
        (START, "x", 5, 71.4),
        (START, "y", 2, 28.6),
        (START + timedelta(days=7), "y", 1, 100.0),
    ]


def test_finished_windows_are_appended_once(spark, stream, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, "a", [(1, START, "x")])
    land(spark, folder, "b", [(2, START + timedelta(days=9), "x")])
    land(spark, folder, "c", [(3, START + timedelta(days=9), "y")])
    land(spark, folder, "d", [(4, START, "x")])  # too late by now
    counts = intake.window_counts(stream(), "ts", "item", "7 days", "1 hour")
    table = intake.run_to_table(counts, str(tmp_path / "out"), str(tmp_path / "state"))
    assert as_tuples(table) == [(START, "x", 1)]


def test_feed_payloads_are_taken_as_they_land(spark, tmp_path):
    """Intake of a feed under collection ids, and first arrivals per company and title across collections."""
    folder = tmp_path / "remoteok"
    folder.mkdir()

    def payload(name, *titles):
        items = [{"legal": "notice"}] + [{"position": title, "company": "Acme", "date": "2024-01-04"} for title in titles]
        (folder / name).write_text(json.dumps(items))

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    payload("1.json", "Data Analyst", "BI Developer")
    intake.append_stream(feeds.stream_feed(spark, str(folder), "remoteok"), out, state, 1)
    payload("2.json", "data analyst", "Data Engineer")
    intake.append_stream(feeds.stream_feed(spark, str(folder), "remoteok"), out, state, 2)
    rows = as_tuples(spark.read.parquet(out), "collection_id", "item_no", "title", "remote")
    assert sorted(rows) == [
        (1, 1, "Data Analyst", True), (1, 2, "BI Developer", True), (2, 1, "data analyst", True), (2, 2, "Data Engineer", True),
    ]

    stream = feeds.stream_feed(spark, str(folder), "remoteok", files_per_batch=1).select(
        "title", *posting_key(), posting_time(F.col("posted")).alias("ts")
    )
    first = intake.dedup_stream(stream, ["_company", "_title"], "ts", "30 days").select("_title")
    table = intake.run_to_table(first, str(tmp_path / "first"), str(tmp_path / "first-state"))
    assert sorted(as_tuples(table)) == [("bi developer",), ("data analyst",), ("data engineer",)]
