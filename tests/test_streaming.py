import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from terralog.operators.lookup import Key, answer_with, lookup_first
from terralog.streaming.lookups import keep_answers, land, land_latest, lookup_stream, stored_answers
from terralog.streaming.rate import rate_breaches

KEYS = [Key("country", "name"), Key("iso2", "code")]
START = dt.datetime(2024, 1, 1)


def at(minutes, seconds=0):
    return START + dt.timedelta(minutes=minutes, seconds=seconds)


@pytest.fixture
def stream_of(spark, tmp_path):
    """Write batches as files and read them as a stream, one file per micro-batch."""

    def make(*batches):
        for i, batch in enumerate(batches):
            batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{i}"))
        reader = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1)
        return reader.option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    return make


def test_lookup_stream_equals_batch(table, stream_of, tmp_path):
    dim = table("name string, code string", [("Ambria", "AM"), ("Twin", "T1"), ("twin", "T2")])
    one = table("req_id long, country string, iso2 string", [(1, "TWIN ", None), (2, "x", "am"), (3, None, "")], pos=False)
    two = table("req_id long, country string, iso2 string", [(4, "Ambria", "zz"), (5, "ambria", None)], pos=False)
    stream = lookup_stream(stream_of(one, two), dim, KEYS, ["name", "code"], "{answer.name}")
    streamed = land(stream, str(tmp_path / "out"))
    kept = stored_answers(dim, KEYS, ["name", "code"], str(tmp_path / "answers"))
    again = one.sparkSession.readStream.schema(one.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    same = land(lookup_stream(again, dim, KEYS, ["name", "code"], "{answer.name}", answers=kept), str(tmp_path / "same"))
    assert sorted(rows(same)) == sorted(rows(streamed))
    batch = lookup_first(one.unionByName(two), dim, KEYS, ["name", "code"], "{answer.name}")
    assert rows(streamed.orderBy("req_id")) == rows(batch.orderBy("req_id"))
    with pytest.raises(ValueError, match="streaming"):
        lookup_stream(one, dim, KEYS, ["name"], "x")


def test_kept_answers_follow_a_growing_table(spark, table, tmp_path):
    """Each run reads the new rows only; an earlier position that arrives later wins; a run without rows changes nothing."""
    schema = "name string, code string"
    dim = table(schema, [("Ambria", "AM"), ("Twin", "T1"), ("twin", "T2"), (None, "N"), ("AMBRIA ", "A2"), ("Late", "T2")])
    asked = table("req_id long, country string, iso2 string", [(1, "twin", None), (2, "ambria", None), (3, None, "t2"), (4, "late", None), (5, "", "")], pos=False)
    seen = None
    for k, lot in enumerate([[5, 4], [2], [], [0, 1, 3]]):
        part = dim.where(F.col("_pos").isin(lot)) if lot else dim.limit(0)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        seen = part if seen is None else seen.unionByName(part)
        stream = spark.readStream.schema(dim.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        kept = keep_answers(stream, KEYS, ["name", "code"], str(tmp_path / "kept"))
        got = answer_with(asked, kept, KEYS, "{answer.name}")
        want = lookup_first(asked, seen, KEYS, ["name", "code"], "{answer.name}")
        assert sorted(rows(got), key=str) == sorted(rows(want), key=str)


def test_a_restarted_run_goes_on(table, stream_of, tmp_path):
    dim = table("name string, code string", [("Ambria", "AM")])
    first = table("req_id long, country string, iso2 string", [(1, "ambria", None)], pos=False)
    out = str(tmp_path / "out")
    assert land(lookup_stream(stream_of(first), dim, KEYS, ["name"], "x"), out).count() == 1
    first.withColumn("req_id", F.lit(2).cast("long")).coalesce(1).write.parquet(str(tmp_path / "in" / "b9"))
    again = first.sparkSession.readStream.schema(first.schema).option("recursiveFileLookup", True)
    got = land(lookup_stream(again.parquet(str(tmp_path / "in")), dim, KEYS, ["name"], "x"), out)
    assert sorted(rows(got, "req_id")) == [(1,), (2,)]


EVENTS = [(at(0, s), "busy") for s in range(4)] + [(at(1, s), "calm") for s in range(3)] + [(at(2), "busy")]


def test_rate_is_breached_above_the_maximum_only(table):
    events = table("ts timestamp, client string", EVENTS, pos=False)
    assert rows(rate_breaches(events, max_requests=3)) == [("busy", at(0), at(2), 4, 1)]
    assert rows(rate_breaches(events, max_requests=4)) == []
    plain = table("ts timestamp_ntz, client string", EVENTS, pos=False)
    assert rows(rate_breaches(plain, max_requests=3), "client", "n") == [("busy", 4)]


def test_default_allowance(spark):
    events = spark.range(802).select(
        F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 100)).alias("ts"),
        F.when(F.col("id") < 400, "at").otherwise("above").alias("client"),
    )
    assert rows(rate_breaches(events), "client", "n", "rejected") == [("above", 402, 2)]


def test_stream_emits_closed_windows_once_and_drops_late_events(table, stream_of, tmp_path):
    schema = "ts timestamp_ntz, client string"
    one = table(schema, EVENTS, pos=False)
    closing = table(schema, [(at(9), "tail")], pos=False)
    evicting = table(schema, [(at(9, 10), "tail")], pos=False)
    late = table(schema, [(at(0, 50), "busy"), (at(9, 30), "tail")], pos=False)
    got = land(rate_breaches(stream_of(one, closing, evicting, late), max_requests=0, lateness="1 minute"), str(tmp_path / "out"))
    assert sorted(rows(got, "client", "window_start", "n")) == [
        ("busy", at(0), 4), ("busy", at(2), 1), ("calm", at(0), 3),
    ]


def test_a_finished_stream_has_its_open_windows_too(table, stream_of, tmp_path):
    schema = "ts timestamp_ntz, client string"
    batches = [table(schema, EVENTS[k::3], pos=False) for k in range(3)]
    stream = rate_breaches(stream_of(*batches), max_requests=2, lateness="1 hour")
    got = land_latest(stream, str(tmp_path / "out"), ["client", "window_start"])
    events = table("ts timestamp, client string", EVENTS, pos=False)
    assert sorted(rows(got)) == sorted(rows(rate_breaches(events, max_requests=2))) != []
