"""Published snapshots: failed writes, two writers, replays of a stream."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arealis.operators import ledger as L
from arealis.operators import snapshots as SN

ROWS = "source_key string, status string, at int"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_and_a_failed_write(spark, tmp_path):
    table = SN.Published(spark, str(tmp_path / "t"))
    assert table.version() == 0
    with pytest.raises(FileNotFoundError):
        table.read()
    one = spark.createDataFrame([("a", "ok", 1), ("b", "ok", 1)], ROWS)
    assert table.write(one) == 1 and rows(table.read()) == rows(one)
    broken = one.withColumn("at", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(PySparkException):
        table.write(broken)
    assert table.version() == 1 and rows(table.read()) == rows(one)
    two = one.withColumn("share", F.lit(0.123456))
    assert table.write(two, fmt="csv", digits=2, partition_by=["status"]) == 2
    assert rows(table.read().select("source_key", "status", "at", "share")) == [("a", "ok", 1, 0.12), ("b", "ok", 1, 0.12)]
    assert rows(table.read(1)) == rows(one)
    assert table.write(table.read(1).where("at > 5")) == 3 and table.read().count() == 0 and table.read().columns == one.columns
    table.prune(keep=1)
    assert table.version() == 3 and table.read().count() == 0
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("snapshot-")]) == 1


def test_of_two_writers_the_second_is_refused(spark, tmp_path):
    mine, theirs = (SN.Published(spark, str(tmp_path / "t")) for _ in range(2))
    began = mine.write(spark.createDataFrame([("a", "ok", 1)], ROWS))
    both = mine.version(), theirs.version()
    assert both == (began, began)
    theirs.write(spark.createDataFrame([("b", "ok", 2)], ROWS), both[1])
    with pytest.raises(SN.Conflict):
        mine.write(spark.createDataFrame([("c", "ok", 3)], ROWS), both[0])
    assert rows(mine.read()) == [("b", "ok", 2)] and mine.version() == 2


def test_sidecars_as_a_stream(spark, tmp_path):
    arrivals = [[("a", "failed", 1), ("b", "ok", 1)], [("a", "ok", 2), ("a", "failed", 3)], [("c", "manual", 4), ("b", "failed", 4)]]
    table, folder = SN.Published(spark, str(tmp_path / "ledger")), str(tmp_path / "in")
    want = None
    for k, part in enumerate(arrivals):
        df = spark.createDataFrame(part, ROWS)
        df.coalesce(1).write.mode("append").json(folder)
        stream = spark.readStream.schema(ROWS).json(folder)
        SN.follow(stream, table, str(tmp_path / "state"), order="at").awaitTermination()
        last = df.groupBy("source_key").agg(F.max_by(F.struct(*df.columns), "at").alias("r")).select("r.*")
        want = last if want is None else L.upsert(want, last)
        assert rows(table.read()) == rows(want) and table.version() == k + 1
    again = spark.createDataFrame(arrivals[0], ROWS)
    assert not SN.upsert_batch(table, again, 2, "sidecars") and table.version() == 3  # a repeated batch changes nothing
    assert SN.upsert_batch(table, again, 0, "another stream") and table.version() == 4
