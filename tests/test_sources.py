import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import collapse
from cellgrid.plans.daily_run import DailyRun
from cellgrid.sources import cdr_files, tables
from cellgrid.sources.manifest import ManifestLog
from cellgrid.sources.report_store import ReportStore
from cellgrid.sources.serving_store import ServingStore
from cellgrid.streaming.daily_files import stream_daily_files, write_collapsed

MS = 1383260400000  # 2013-10-31 23:00 UTC, midnight in Milan


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


@pytest.fixture
def dirty(tmp_path):
    write(tmp_path, "sms-call-internet-mi-2013-11-01.csv",
          "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet\n"
          f"{MS},1,39,1.5,,abc,2,10\n{MS},1,49,0.5,1,,NaN,\n{MS},2,39,,,,,\n,3,39,1,1,1,1,1\n{MS},,39,1,1,1,1,1\n")
    write(tmp_path, "sms-call-internet-mi-2013-11-02.csv",
          "CellID\tdatetime\tcountrycode\tinternet\tsmsin\tsmsout\tcallin\tcallout\n"
          f"1\t{MS}\t39\t7\t1\t1\t1\t1\n4\t2013-11-02 05:00:00\t39\t7\t1\t1\t1\t1\n")
    write(tmp_path, "other.csv", "a,b\n1,2\n")
    return str(tmp_path)


def collapsed(spark, folder, **options):
    raw, roles = cdr_files.read_daily_files(spark, folder)
    out = collapse.collapse_country_codes(raw, cell_col=roles.cell, time_col=roles.time, activities=roles.activities)
    return raw, tables.normalise_time(out, "datetime", **options)


def test_dirty_files(spark, dirty):
    raw, out = collapsed(spark, dirty)
    rows = {(r.CellID, r._source_file[-6:-4]): r for r in out.collect()}
    assert set(rows) == {(1, "01"), (2, "01"), (1, "02"), (4, "02")}
    first = rows[(1, "01")]
    assert (first.smsin, first.smsout, first.callin, first.callout, first.internet) == (2.0, 1.0, 0.0, 2.0, 10.0)
    assert rows[(2, "01")].internet == 0.0
    assert rows[(1, "02")].internet == 7.0  # other column order and delimiter, read by name
    assert first.datetime == dt.datetime(2013, 10, 31, 23)
    assert rows[(4, "02")].datetime == dt.datetime(2013, 11, 2, 5)
    counts = {r._source_file[-6:-4]: (r.raw_rows, r.collapsed_rows) for r in collapse.collapse_counts(raw).collect()}
    assert counts == {"01": (5, 2), "02": (2, 2)}


def test_cell_keys_are_whole_numbers(spark, tmp_path):
    cells = ["7", " 8 ", "9.0", "nan", "1.7", "", "abc", "1e3", "9223372036854775807", "1e300", "-inf", "+3"]
    lines = "".join(f"{MS},{c},1\n" for c in cells)
    write(tmp_path, "sms-call-internet-mi-2013-11-03.csv", "datetime,CellID,smsin\n" + lines)
    raw, _ = cdr_files.read_daily_files(spark, str(tmp_path))
    got = sorted(r.CellID for r in raw.filter("CellID IS NOT NULL").collect())
    assert got == [3, 7, 8, 9, 1000, 9223372036854775807]
    assert collapse.rejected_rows(raw).first().without_cell == 6


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from cellgrid import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster())


def test_local_clock(spark, dirty):
    _, out = collapsed(spark, dirty, tz="Europe/Rome")
    assert out.filter("CellID = 2").first().datetime == dt.datetime(2013, 11, 1, 0)


def test_missing_files_and_columns(spark, tmp_path):
    write(tmp_path, "notes.csv", "x\n1\n")
    with pytest.raises(FileNotFoundError, match="notes.csv"):
        cdr_files.find_daily_files(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        cdr_files.find_daily_files(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        cdr_files.detect_roles(["a", "time", "smsin"])
    with pytest.raises(ValueError):
        cdr_files.detect_roles(["cell", "date", "x"])
    roles = cdr_files.detect_roles(["Square_Cell", "x_time", "internet", "smsin"])
    assert roles == cdr_files.Roles("Square_Cell", "x_time", ("smsin", "internet"))
    assert [cdr_files.sniff_delimiter(h) for h in ("a;b,c;d", "a\tb", "a|b", "a")] == [";", "\t", "|", ","]


def test_time_normalisation(spark):
    text = spark.createDataFrame([("2024-01-01 05:00:00",), (str(MS),), ("rubbish",), (None,)], "t string")
    soft = [r[0] for r in tables.normalise_time(text, "t", on_bad="null").collect()]
    assert soft == [dt.datetime(2024, 1, 1, 5), dt.datetime(2013, 10, 31, 23), None, None]
    with pytest.raises(Exception, match="unreadable time"):
        tables.normalise_time(text, "t").collect()
    numbers = spark.createDataFrame([(MS,)], "t long")
    assert tables.normalise_time(numbers, "t").first()[0] == dt.datetime(2013, 10, 31, 23)


def test_stage_tables(spark, tmp_path):
    base = str(tmp_path / "t")
    assert tables.load_table(spark, base, required=False) is None
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, base)
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 3), "a")], "id long, datetime timestamp_ntz, s string")
    tables.write_table(df, base, fmt="csv")
    assert tables.load_table(spark, base).first().s == "a"
    assert tables.load_table(spark, base, schema=df.schema).first() == df.first()
    write(tmp_path, "plain.csv", "id,datetime,s\n1,2024-01-01 03:00:00,a\n")
    assert tables.load_table(spark, str(tmp_path / "plain"), schema=df.schema).first() == df.first()
    inferred = tables.normalise_time(tables.load_table(spark, str(tmp_path / "plain")))
    assert inferred.first().datetime == dt.datetime(2024, 1, 1, 3)
    tables.write_table(df.withColumn("s", F.lit("b")), base)
    assert tables.load_table(spark, base).first().s == "b"  # Parquet comes first
    tables.write_table(df, base)
    assert tables.load_table(spark, base).count() == 1


def test_calendar(spark, tmp_path):
    write(tmp_path, "c.csv", "date,name\n2013-11-01,Ognissanti\n")
    assert tables.load_calendar(spark, str(tmp_path / "c.csv")).first().date == dt.date(2013, 11, 1)
    plain = tables.load_calendar(spark, str(tmp_path / "c.csv"), date_column="day")
    assert plain.columns == ["date", "name"]
    spark.createDataFrame([("2013-11-01",)], "date string").write.parquet(str(tmp_path / "c.parquet"))
    assert tables.load_calendar(spark, str(tmp_path / "c.parquet")).first().date == dt.date(2013, 11, 1)


def test_sampling_step(spark):
    def step(minutes):
        rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m),) for m in minutes]
        return collapse.sampling_step(spark.createDataFrame(rows, "datetime timestamp_ntz")).collect()

    assert step([0, 0, 10, 20, 80])[0].step_seconds == 600
    assert step([0, 10, 70])[0].step_seconds == 600  # a tie: the smallest
    assert step([0, 60 * 24, 120 * 24])[0].step_seconds == 86400  # across days
    assert step([0]) == []


def test_file_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    header = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet\n"
    for day in (1, 2, 3):
        lines = [f"2013-11-0{day} 0{h}:00:00,{c},{k},1,2,3,4,{h}" for h in range(3) for c in (1, 2) for k in (39, 49)]
        write(raw, f"sms-call-internet-mi-2013-11-0{day}.csv", header + "\n".join(lines) + "\n")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for attempt in (check, check, check + "2"):  # once, a restart, and a replay of everything
        stream, roles = stream_daily_files(spark, str(raw), files_per_batch=1)
        write_collapsed(stream, roles, out, attempt).awaitTermination()
    _, batch = collapsed(spark, str(raw))
    streamed = spark.read.option("basePath", out).parquet(out).select(*batch.columns)
    assert streamed.count() == batch.count() == 18
    assert streamed.exceptAll(batch).isEmpty()


def test_serving_store_is_all_or_nothing(spark, tmp_path):
    store = ServingStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.read("cases")
    one = spark.range(3)
    with pytest.raises(ValueError):
        store.reload({"cases": one})
    store.reload({"cases": one, "sources": one, "reports": one})
    broken = one.select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        store.reload({"cases": spark.range(5), "sources": broken, "reports": one})
    assert store.read("cases").count() == 3
    store.replace("reports", store.read("reports").filter("id > 0"))
    assert (store.read("cases").count(), store.read("reports").count()) == (3, 2)
    store.create_views()
    assert spark.sql("SELECT count(*) FROM reports").first()[0] == 2
    assert len(store.remove_old()) == 1 and store.read("cases").count() == 3
    rival = ServingStore(spark, store.base)
    rival._latest = lambda: (1, "earlier")  # started before the last reload
    with pytest.raises(Exception, match="exists"):
        rival.reload({"cases": one, "sources": one, "reports": one})
    assert store.read("reports").count() == 2


def test_one_of_several_writers_wins(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "m"))
    assert log.latest() is None
    log.commit(1, {"by": "first"})

    def write(i):
        try:
            ManifestLog(spark, log.folder).commit(2, {"by": i})
            return i
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        winners = [w for w in pool.map(write, range(24)) if w is not None]
    assert len(winners) == 1 and log.latest() == (2, {"by": winners[0]})
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if not p.name.endswith(".crc")) == ["00000001.json", "00000002.json"]


def test_two_reloads_at_once(spark, tmp_path):
    base = str(tmp_path / "s")
    ServingStore(spark, base).reload({n: spark.range(1) for n in ServingStore.TABLES})
    entered = Barrier(2)

    def reload(n):
        store = ServingStore(spark, base)
        latest = store._latest()
        store._latest = lambda: latest
        entered.wait()
        try:
            store.reload({name: spark.range(n) for name in ServingStore.TABLES})
            return n
        except FileExistsError:
            return None

    with ThreadPoolExecutor(2) as pool:
        done = [n for n in pool.map(reload, (5, 6)) if n is not None]
    assert len(done) == 1 and {ServingStore(spark, base).read(n).count() for n in ServingStore.TABLES} == {done[0]}


def test_report_store_leaves_untouched_buckets(spark, tmp_path):
    store = ReportStore(spark, str(tmp_path / "r"), buckets=8)
    stamp = [F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz") for d in (1, 2)]
    assert store.read().count() == 0 and store.upsert(spark.createDataFrame([], "case_id long, report_text string")) == []
    store.upsert(spark.createDataFrame([(i, f"a{i}") for i in range(100, 0, -1)], "case_id long, report_text string"), now=stamp[0])
    first = {r.case_id: r for r in store.read().collect()}
    assert [first[i].id for i in range(1, 101)] == list(range(1, 101))
    before = set(store.read().inputFiles())
    touched = store.upsert(spark.createDataFrame([(7, "new"), (500, "more"), (501, "more")], "case_id long, report_text string"), now=stamp[1])
    assert 1 <= len(touched) <= 3
    after = set(store.read().inputFiles())
    assert len(before - after) <= len(touched) and len(before & after) >= len(before) - len(touched)
    rows = {r.case_id: r for r in ReportStore(spark, store.base).read().collect()}
    assert len(rows) == 102 and rows[7].report_text == "new" and (rows[7].id, rows[7].generated_at) == (7, first[7].generated_at)
    assert [rows[i].id for i in (500, 501)] == [101, 102] and rows[500].generated_at == dt.datetime(2024, 1, 2)
    assert all(rows[i] == first[i] for i in first if i != 7)


def test_layouts_of_many_files_in_one_job(spark, tmp_path):
    for i in range(1000):
        d = ";" if i % 3 == 0 else ","
        write(tmp_path, f"sms-call-internet-mi-{i:04d}.csv", d.join(["datetime", "CellID", "smsin"]) + "\n" + f"{d.join(['1', '2', '3'])}\n" * (i % 4))
    write(tmp_path, "sms-call-internet-mi-9999.csv", "")
    paths = cdr_files.find_daily_files(spark, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("layouts", "")
    try:
        layouts = cdr_files.read_layouts(spark, paths)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(tracker.getJobIdsForGroup("layouts")) <= 3  # the listing, the scan and its regrouping
    assert [len(f) for f in layouts.values()] == [334, 666] and list(layouts)[0] == "datetime;CellID;smsin"
    assert next(iter(layouts.values()))[0].endswith("/sms-call-internet-mi-0000.csv")
    assert cdr_files.read_layouts(spark, []) == {}


def test_daily_run_and_reload(spark, tmp_path):
    """A week with an evening peak in one block of cells: chain, serving tables, and the same again."""
    raw = tmp_path / "raw"
    raw.mkdir()
    header = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet\n"
    for day in range(1, 6):
        lines = []
        for h in range(24):
            for c in range(1, 26):
                block = c in (7, 8, 12, 13) and h in (18, 19) and day >= 3
                lone = (c, h, day) == (25, 3, 3)
                value = 10 + (c * h) % 5 + (50 if block or lone else 0)
                lines.append(f"2024-01-0{day} {h:02d}:00:00,{c},39,1,1,1,1,{value}")
        write(raw, f"sms-call-internet-mi-2024-01-0{day}.csv", header + "\n".join(lines) + "\n")
    run = DailyRun(spark, str(tmp_path / "out"), grid_size=5, holidays=("2024-01-06",))
    store = run.run(str(raw))
    first = {n: sorted(map(tuple, store.read(n).collect())) for n in ("cases", "sources")}
    classes = [(r.cell_id, r.classification, r.reason) for r in store.read("cases").collect()]
    assert (25, "ANOMALOUS", "isolated — only 0/3 neighbors at risk") in classes
    assert {c for c, k, _ in classes if k == "ROUTINE"} == {7, 8, 12, 13}
    ids = sorted(r[0] for r in first["cases"])
    assert ids == list(range(1, len(ids) + 1)) and first["sources"]
    assert store.read("reports").count() == len(ids)
    for name in ("quality_files", "quality_rejected", "known_patterns", "diagnosis_all_horizons"):
        assert not spark.read.parquet(f"{tmp_path}/out/{name}.parquet").isEmpty()
    over = store.read("cases").filter("covered > deficit + 1e-6")
    assert over.isEmpty()
    again = run.run(str(raw))
    assert {n: sorted(map(tuple, again.read(n).collect())) for n in ("cases", "sources")} == first
