"""Event-time operators over streams give what they give over batches."""

import os

import pyarrow.parquet as pq
import pytest

from braidwork.operators.windows import latest
from braidwork.streaming import windows as S

D = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark, tmp_path):
    """The events in three files, so that a stream takes several batches; streams take files by their times, here those of the events."""
    events = spark.read.parquet(f"{D}/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "events"))
    files = sorted((tmp_path / "events").glob("*.parquet"), key=lambda f: pq.read_table(f, columns=["ts"])["ts"][0].as_py())
    for i, f in enumerate(files):
        os.utime(f, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    return str(tmp_path / "events")


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def complete(spark, df, tmp_path, name, mode="complete"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows(spark, parts, tmp_path):
    batch = spark.read.parquet(parts)
    for name, f in (("tumbling", lambda df: S.tumbling(df, "ts", ["event_type"], "6 hours", "1 day")), ("sliding", lambda df: S.sliding(df, "ts", ["event_type"], "6 hours", "3 hours", "1 day")), ("sessions", lambda df: S.sessions(df, "ts", ["user_id"], "30 minutes", "1 day"))):
        got = complete(spark, f(stream(spark, parts)), tmp_path, name)
        text = lambda df: sorted(tuple(map(str, r)) for r in df.selectExpr("string(start)", "string(end)", *df.columns[2:]).collect())
        assert text(got) == text(f(batch))


def test_first_seen(spark, parts, tmp_path):
    got = complete(spark, S.first_seen(stream(spark, parts).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "1000 days"), tmp_path, "first_seen", "append")
    assert got.count() == spark.read.parquet(parts).select("user_id", "event_type").distinct().count()


def test_running_runs(spark, tmp_path):
    for i, rows in enumerate([[("a", "x"), ("a", "x")], [("a", "x"), ("b", "y")], [("b", "z")]]):
        spark.createDataFrame(rows, "k string, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    df = spark.readStream.schema("k string, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = complete(spark, S.running_runs(df, "k", "v"), tmp_path, "running", "update")
    rows = {tuple(r) for r in got.collect()}
    assert ("a", "x", 3) in rows
    assert ("b", "z", 1) in rows


def test_upserts(spark, parts, tmp_path):
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    q = S.upsert_batches(stream(spark, parts), str(tmp_path / "table"), keys, order, str(tmp_path / "cp"))
    q.awaitTermination(120)
    newest = max((tmp_path / "table").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    want = latest(spark.read.parquet(parts), keys, order)
    assert sorted(r.event_id for r in spark.read.parquet(str(newest)).collect()) == sorted(r.event_id for r in want.collect())
