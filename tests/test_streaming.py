import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cellgrid.streaming.hourly_cells import hourly_cells, run_available, stream_events

SCHEMA = "event_id long, ts timestamp_ntz, CellID long, event_type string, value double"
START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def arrive(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")


def run(spark, folder, tmp_path):
    events = stream_events(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    return run_available(hourly_cells(events, {"smsin": "view"}, delay="6 hours"), str(tmp_path / "out"), str(tmp_path / "state"))


def closed(spark, tmp_path):
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_watermark_late_rows_redelivery_and_restart(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    arrive(spark, folder, 1, [(1, at(0.5), 7, "view", 2.0), (2, at(0.6), 7, "click", 3.0), (2, at(0.6), 7, "click", 3.0), (3, at(9.5), 7, "view", 1.0)])
    first = run(spark, folder, tmp_path)
    assert first.read == 4 and first.late == 0
    assert closed(spark, tmp_path) == [(7, at(0), 2.0, 2)]  # the watermark is 3:30; the hour of 9:30 is open

    # A new start from the same folder: 3 again, an event that is late, one that is out of order but in time.
    arrive(spark, folder, 2, [(3, at(9.5), 7, "view", 1.0), (4, at(3.4), 7, "view", 50.0), (5, at(4.0), 8, "view", 4.0), (6, at(20), 7, None, None)])
    second = run(spark, folder, tmp_path)
    assert second.read == 4 and second.late == 1
    expected = [(7, at(0), 2.0, 2), (7, at(9), 1.0, 1), (8, at(4), 4.0, 1)]
    assert closed(spark, tmp_path) == expected

    assert run(spark, folder, tmp_path).read == 0 and closed(spark, tmp_path) == expected  # nothing new

    # The process died after the sink had written and before the batch was marked as done.
    done = sorted(int(n) for n in os.listdir(tmp_path / "state" / "commits") if n.isdigit())
    os.remove(tmp_path / "state" / "commits" / str(done[-1]))
    crc = tmp_path / "state" / "commits" / f".{done[-1]}.crc"
    if crc.exists():
        os.remove(crc)
    arrive(spark, folder, 3, [(7, at(40), 7, "view", 9.0), (None, at(41), 7, "view", 9.0), (8, None, 7, "view", 9.0)])
    run(spark, folder, tmp_path)
    assert closed(spark, tmp_path) == sorted(expected + [(7, at(20), 0.0, 1)])


def test_state_follows_the_delay(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    kept = []
    for n in range(3):
        arrive(spark, folder, n, [(1000 * n + i, at(50 * n + i / 4), 1, "view", 1.0) for i in range(200)])
        kept.append(run(spark, folder, tmp_path).state_rows)
    assert max(kept) < 80  # 24 ids and hours of the last six, not 600 events
    assert sum(r[3] for r in closed(spark, tmp_path)) >= 3 * 200 - 40


def test_state_partitions_follow_the_cores_and_not_the_shuffles(spark, tmp_path):
    folder, keys = str(tmp_path / "in"), ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")
    os.makedirs(folder)
    before = {key: spark.conf.get(key, None) for key in keys}

    def stores(operator):
        return len([n for n in os.listdir(tmp_path / "state" / "state" / str(operator)) if n.isdigit()])

    try:
        for n, shuffles in enumerate((64, 2)):  # the second run goes on with the partitions of the first
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            arrive(spark, folder, n, [(100 * n + i, at(50 * n + i / 4), i % 3, "view", 1.0) for i in range(100)] * 2)
            assert run(spark, folder, tmp_path).read == 200
            assert stores(0) == stores(1) == min(64, spark.sparkContext.defaultParallelism) < 64
            assert spark.conf.get("spark.sql.shuffle.partitions") == str(shuffles)  # the session's own setting stays
        hours = closed(spark, tmp_path)
        assert len(hours) == 3 * (25 + 18) and sum(r[3] for r in hours) == 100 + 4 * 18  # all of the first, and of the second up to 18 hours
        events = stream_events(spark, folder, spark.createDataFrame([], SCHEMA).schema)
        few = run_available(hourly_cells(events, {"smsin": "view"}, delay="6 hours"), str(tmp_path / "o"), str(tmp_path / "s"), state_partitions=1)
        assert few.read == 400 and [n for n in os.listdir(tmp_path / "s" / "state" / "0") if n.isdigit()] == ["0"]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_a_store_takes_disk_for_its_rows_only(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark._jsc.sc().conf())

    def manifests():
        found = [os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f.startswith("MANIFEST")]
        return {f: os.stat(f).st_blocks * 512 for f in found if os.path.exists(f)}

    before = manifests()
    arrive(spark, folder, 1, [(i, at(i / 4), 7, "view", 1.0) for i in range(100)])
    assert run(spark, folder, tmp_path).read == 100
    added = {f: size for f, size in manifests().items() if f not in before}
    assert added and max(added.values()) < 1_000_000  # RocksDB would set 4 MB aside in each


def test_batch_form_is_the_plain_aggregate(spark):
    rows = [(1, at(0.5), 7, "view", 2.0), (1, at(0.5), 7, "view", 2.0), (2, at(1.5), 7, "view", None), (3, None, 7, "view", 1.0)]
    hours = hourly_cells(spark.createDataFrame(rows, SCHEMA), {"smsin": "view"})
    assert sorted(map(tuple, hours.collect())) == [(7, at(0), 2.0, 1), (7, at(1), 0.0, 1)]
    assert hourly_cells(spark.createDataFrame([], SCHEMA), {"smsin": "view"}).count() == 0
    assert hours.where(F.col("smsin") < 0).isEmpty()
