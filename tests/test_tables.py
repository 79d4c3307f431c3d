"""Published tables: whole versions only, repeats and aborted runs harmless; runs that change a store."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from airtrace import schemas
from airtrace.plans import lifecycle as L
from airtrace.session import folders, materialise, owned_files
from airtrace.sources import tables
from airtrace.streaming import ingest

T0 = datetime(2025, 1, 1, 10)
SCHEMA = "id long, kind string, seen timestamp"


def rows(spark, *ids):
    return spark.createDataFrame([(i, "ab"[i % 2], T0 + timedelta(hours=9 * i) if i else None) for i in ids], SCHEMA)


def ids(spark, store, **where):
    return sorted(r.id for r in tables.read(spark, store, "t", **where).collect())


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "store")


def test_a_load_and_its_repeat(spark, store):
    for _ in range(2):
        version = tables.load(rows(spark, 0, 1, 2, 3), store, "t", "seen", by=["kind"])
    assert version.number == 1 and ids(spark, store) == [0, 1, 2, 3]
    assert {e.part for e in version.of("t")} == {
        "date=__HIVE_DEFAULT_PARTITION__/kind=a", "date=2025-01-01/kind=b", "date=2025-01-02/kind=a", "date=2025-01-02/kind=b"}
    assert ids(spark, store, since="2025-01-02", until="2025-01-02") == [2, 3]


def test_a_version_stays_what_it_was(spark, store):
    first = tables.load(rows(spark, 1, 2), store, "t", "seen", run="one")
    tables.load(rows(spark, 3), store, "t", "seen", run="two")
    assert ids(spark, store) == [1, 2, 3] and ids(spark, store, version=first) == [1, 2]
    assert tables.latest(spark, f"{store}-none").number == 0


def test_half_finished_manifests_and_runs_are_not_seen(spark, store):
    tables.load(rows(spark, 1), store, "t", "seen")
    tables.stage(rows(spark, 2, 3), store, "t", "dead", "seen")
    (spark.range(1).write.parquet(f"{store}/manifest/v=2"))  # a folder without the file of a manifest
    for f in folders(spark, f"{store}/manifest"):
        assert f in ("v=1", "v=2")
    import os
    for name in os.listdir(f"{store}/manifest/v=2"):
        os.remove(f"{store}/manifest/v=2/{name}")
    assert ids(spark, store) == [1]
    assert tables.load(rows(spark, 4), store, "t", "seen", run="next").number == 3 and ids(spark, store) == [1, 4]


def test_a_conflict_fails(spark, store):
    now = tables.load(rows(spark, 1, 2), store, "t", "seen")
    old = tuple(now.of("t"))
    new, _ = tables.stage(rows(spark, 5), store, "t", "x", "seen")
    tables.publish(spark, store, tables.Change("x", "x", tuple(new), old))
    with pytest.raises(RuntimeError, match="meanwhile"):
        tables.publish(spark, store, tables.Change("y", "y", (), old))
    assert ids(spark, store) == [5]


def test_new_columns_and_other_types(spark, store):
    tables.load(rows(spark, 1), store, "t", "seen", run="one")
    tables.load(rows(spark, 2).withColumn("more", F.lit(7)), store, "t", "seen", run="two")
    assert {(r.id, r.more) for r in tables.read(spark, store, "t").collect()} == {(1, None), (2, 7)}
    with pytest.raises(ValueError):
        tables.load(rows(spark, 3).withColumn("more", F.lit("x")), store, "t", "seen", run="three")
    assert ids(spark, store) == [1, 2]


def test_an_empty_table(spark, store):
    version = tables.load(rows(spark), store, "t", "seen")
    assert version.of("t") == [] and ids(spark, store) == []


@pytest.mark.parametrize("by", [[], ["kind"]])
def test_compaction_is_one_step(spark, store, by):
    for i in range(1, 7):
        tables.load(rows(spark, i, i + 10), store, "t", "seen", run=f"r{i}", by=by)
    before = tables.latest(spark, store)
    seen = ids(spark, store)
    after = tables.compact(spark, store, "t", "seen", by=by)
    assert ids(spark, store) == seen == ids(spark, store, version=before)
    assert len(after.of("t")) < len(before.of("t")) and tables.compact(spark, store, "t", "seen", by=by).number == after.number
    assert len({e.part for e in after.of("t")}) == len(after.of("t"))
    assert tables.vacuum(spark, store, keep=1) > 0 and ids(spark, store) == seen
    assert folders(spark, f"{store}/manifest") == [f"v={after.number}"]


def test_filters_reach_partitions_and_row_groups(spark, store):
    tables.load(rows(spark, *range(1, 30)), store, "t", "seen", by=["kind"])
    out = tables.read(spark, store, "t", partitions=True).where("date = date'2025-01-03' and kind = 'a' and seen > timestamp'2025-01-03 01:00:00'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(seen), GreaterThan(seen" in plan
    assert {r.id for r in out.collect()} == {i for i in range(2, 30, 2) if (T0 + timedelta(hours=9 * i)).strftime("%d%H") > "0301" and (T0 + timedelta(hours=9 * i)).day == 3}


def test_owned_files_go_with_their_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("airtrace.session.shared_folder", lambda session, purpose: f"{tmp_path}/{purpose}")
    with owned_files(spark):
        assert materialise(spark.range(5), "x").count() == 5 and folders(spark, str(tmp_path)) == ["x"]
    assert folders(spark, str(tmp_path)) == []
    with pytest.raises(ZeroDivisionError), owned_files(spark):
        materialise(spark.range(5), "x")
        1 / 0
    assert folders(spark, str(tmp_path)) == []
    materialise(spark.range(5), "kept")
    assert folders(spark, str(tmp_path)) == ["kept"]


# ---------------------------------------------------------------- runs

RADIO = "id bigint, callsign string, frequency bigint, position_lat double, position_lon double, entity_type string, timestamp timestamp"


def flights_store(spark, store):
    from tests.test_lifecycle import flights

    L.load_table(flights(spark), store, "flights")
    L.load_table(spark.createDataFrame([], RADIO), store, "transceivers")
    L.load_table(spark.createDataFrame([], "id bigint, callsign string, cid int, facility int, logon_time timestamp, last_updated timestamp"), store, "controllers")


def table(spark, store, name, *columns):
    return sorted(tuple(r) for r in tables.read(spark, store, name).select(*columns).collect())


def test_flights_run_aborted_repeated_and_later(spark, store):
    now = "2025-01-02 10:00:00"
    flights_store(spark, store)
    before = table(spark, store, "flights", "id")
    assert L.stage_flights_run(spark, store, now) is not None  # and never published
    assert table(spark, store, "flights", "id") == before and "flight_summaries" not in tables.latest(spark, store).schemas
    done = L.process_flights_written(spark, store, now)
    assert done == {"summaries_created": 5, "records_archived": 7, "records_deleted": 7}
    assert table(spark, store, "flights", "id") == [(5,), (8,)]
    assert table(spark, store, "flights_archive", "id") == [(i,) for i in (1, 2, 3, 4, 6, 7, 9)]
    version = tables.latest(spark, store).number
    nothing = dict.fromkeys(done, 0)
    assert L.process_flights_written(spark, store, now) == nothing and L.process_flights_written(spark, store, "2025-01-02 10:05:00") == nothing
    assert tables.latest(spark, store).number == version
    assert L.process_flights_written(spark, store, "2025-01-03 10:00:00")["summaries_created"] == 1
    assert table(spark, store, "flights", "id") == [(5,)]
    assert len(table(spark, store, "flight_summaries", "callsign")) == 6


def test_rows_that_arrive_meanwhile_stay(spark, store):
    now = "2025-01-02 10:00:00"
    flights_store(spark, store)
    run = L.stage_flights_run(spark, store, now)
    late = spark.createDataFrame([(20, "QFA1", "YSSY", "YMML", 1, "0100", "B738", T0, T0)], tables.read(spark, store, "flights").schema)
    tables.load(late, store, "flights", "last_updated", run="late")
    run.publish(spark)
    assert table(spark, store, "flights", "id") == [(5,), (8,), (20,)]
    tables.compact(spark, store, "flights", "last_updated")
    assert table(spark, store, "flights", "id") == [(5,), (8,), (20,)]


def test_controllers_run(spark, store):
    from tests.test_lifecycle import NOW, controllers, done

    radios = spark.createDataFrame([(1, "SY_TWR", 118_100_000, -33.9, 151.2, "atc", T0)], RADIO)
    L.load_table(controllers(spark), store, "controllers")
    L.load_table(radios, store, "transceivers")
    L.load_table(done(spark).withColumn("session_end_time", F.col("session_start_time")), store, "controller_summaries")
    assert L.process_controllers_written(spark, store, NOW) == {"summaries_created": 3, "records_archived": 5, "records_deleted": 5}
    assert table(spark, store, "controllers", "id") == [(6,), (7,), (8,)]
    assert table(spark, store, "controllers_archive", "id") == [(i,) for i in range(1, 6)]
    # the one without a cid gets no summary and stays, the second run has no work
    assert L.process_controllers_written(spark, store, "2025-01-02 10:01:00")["summaries_created"] == 0


# ---------------------------------------------------------------- ingest


def radio_rows(spark, store, **where):
    return sorted(map(str, ingest.ingested(spark, store, "transceivers", **where).collect()))


def test_ingest_repeats_compacts_and_prunes(spark, store, tmp_path):
    import json

    from tests.test_chain import poll

    (tmp_path / "landing").mkdir()
    for day in range(3):
        for minute in range(4):
            text = json.dumps(poll(minute)).replace("2025-01-01T10", f"2025-01-0{day + 1}T10")
            (tmp_path / "landing" / f"{day}{minute}.json").write_text(text + "\n")
    landing = str(tmp_path / "landing")
    ingest.start_ingest(spark, landing, store, str(tmp_path / "state"), ingest.Filters(), files_per_batch=2, availableNow=True).awaitTermination()
    rows = radio_rows(spark, store)
    version = tables.latest(spark, store)
    (kind, run), = version.marks.items()
    assert len(rows) == 24 and len(version.of("transceivers")) > 6
    # the last batch again: done already; an older one again: refused, as its files are in use
    polls = spark.read.schema(schemas.POLL).json(landing)
    stream, last = run.rsplit("-", 1)
    assert ingest.ingest_batch(polls, store, ingest.Filters(), stream, int(last)).number == version.number
    with pytest.raises(RuntimeError, match="checkpoint"):
        ingest.ingest_batch(polls, store, ingest.Filters(), stream, int(last) - 1)
    assert radio_rows(spark, store) == rows
    after = ingest.compact_ingested(spark, store)
    assert [e.part for e in after.of("transceivers")] == [f"date=2025-01-0{d}/entity_type={k}" for d in (1, 2, 3) for k in ("atc", "flight")]
    tables.vacuum(spark, store, keep=1)
    assert radio_rows(spark, store) == rows
    # only the folders of the date and the kind are read
    out = ingest.ingested(spark, store, "transceivers", partitions=True).where("date = date'2025-01-02' and entity_type = 'atc'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "entity_type" in plan.split("PartitionFilters")[1].split("]")[0]
    assert len(out.inputFiles()) <= 6 and out.count() == 4
    assert len(radio_rows(spark, store, since="2025-01-02", until="2025-01-02")) == 8


def test_a_batch_is_parsed_once(spark, store, tmp_path, monkeypatch):
    import json

    from tests.test_chain import poll

    (tmp_path / "p.json").write_text(json.dumps(poll(0)) + "\n")
    polls = spark.read.schema(schemas.POLL).json(str(tmp_path / "p.json"))
    plans = []
    stage = tables.stage
    monkeypatch.setattr(tables, "stage", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, *a, **k))
    ingest.ingest_batch(polls, store, ingest.Filters(), "s", 0)
    assert len(plans) == 3 and all("InMemoryTableScan" in p for p in plans)
    assert not polls.storageLevel.useMemory  # and let go afterwards


def test_tables_are_staged_and_cleaned_at_once(spark, store, tmp_path, monkeypatch):
    """One table after the other, small jobs leave most cores idle."""
    import json
    import threading

    from tests.test_chain import poll

    stage, clean, seen = tables.stage, tables.remove, set()
    met = threading.Barrier(3)

    def together(df, *args, **named):
        met.wait(120)  # broken unless all three tables come at the same time
        return stage(df, *args, **named)

    monkeypatch.setattr(tables, "stage", together)
    before = spark.conf.get("spark.sql.parquet.outputTimestampType")
    for n in range(2):
        text = "\n".join(json.dumps(poll(n)).replace("2025-01-01T10", f"2025-01-0{day}T10") for day in range(1, 7))
        (tmp_path / f"{n}.json").write_text(text + "\n")
        polls = spark.read.schema(schemas.POLL).json(str(tmp_path / f"{n}.json"))
        ingest.ingest_batch(polls, store, ingest.Filters(), "s", n)
    rows = radio_rows(spark, store)
    version = ingest.compact_ingested(spark, store)
    monkeypatch.setattr(tables, "remove", lambda spark, path: seen.add(threading.get_ident()) or clean(spark, path))
    assert len(rows) == 24 and len(version.of("transceivers")) == 12
    assert tables.vacuum(spark, store, keep=1) == 2 * (6 + 6 + 12) and len(seen) > 1
    assert radio_rows(spark, store) == rows and tables.vacuum(spark, store, keep=1) == 0
    assert spark.conf.get("spark.sql.parquet.outputTimestampType") == before


def test_calls_at_once_keep_order_and_raise(spark):
    from airtrace.session import at_once

    assert at_once(spark, [lambda n=n: spark.range(n).count() for n in (3, 0, 5)]) == [3, 0, 5]
    assert at_once(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        at_once(spark, [lambda: 1 // 0, lambda: 1])
