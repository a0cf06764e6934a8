"""Silences are told to the microsecond, in any time zone."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmark.streaming import streams as ST


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_a_last_heartbeat_is_no_silence_before_itself(spark, tmp_path, zone):
    hour, t0 = timedelta(hours=1), datetime(2024, 1, 1, 0, 0, 0, 123457, UTC)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # worker 1 is silent after its last heartbeat, 2 between two, 3 only for as long as is let
        for i, rows in enumerate([[(1, t0), (2, t0), (3, t0)], [(2, t0 + 7 * hour), (3, t0 + 6 * hour)], [(2, t0 + 9 * hour), (3, t0 + 9 * hour)]]):
            micros = [(w, int((x - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))) for w, x in rows]
            spark.createDataFrame(micros, "worker long, us long").select("worker", F.timestamp_micros("us").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        beats = spark.readStream.schema("worker long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
        name = "silent_" + zone.split("/")[-1].lower()
        query = ST.silent_workers(beats, 6 * 3600).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        at = lambda x: int((x - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
        got = {tuple(r) for r in spark.table(name).select("worker", F.unix_micros("last_seen"), F.unix_micros("silent_from")).collect()}
        assert got == {(w, at(t0), at(t0 + 6 * hour)) for w in (1, 2)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
