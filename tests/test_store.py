import datetime as dt

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from trunkwatch import schema as s
from trunkwatch.operators import alerts
from trunkwatch.sources import store

DAY = dt.date(2024, 5, 1)


@pytest.fixture
def on_day(monkeypatch):
    def at(n):
        monkeypatch.setattr(store, "_today", lambda: DAY + dt.timedelta(days=n))
    return at


def events(table, n, day):
    at = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day)
    rows = []
    for i in range(n):
        rows.append({"alert_id": f"a{i + 3 * day}", "action": "created", "event_at": at + dt.timedelta(minutes=i), "message": f"m{day}",
                     "type": "info", "metadata": {"object_id": str(i)}})
        rows.append({"alert_id": f"a{i}", "action": ["read", "deleted"][i % 5 == 0], "event_at": at + dt.timedelta(hours=1, minutes=i)})
    return table(s.ALERT_EVENTS, *rows, {"action": "read_all", "event_at": at + dt.timedelta(minutes=4)}, {"action": "read_all", "event_at": at})


def state(log):
    return (sorted(dicts(alerts.current_alerts(log)), key=str), sorted(dicts(alerts.read_all_marks(log)), key=str))


def test_alert_state_is_that_of_all_events(spark, table, on_day, tmp_path):
    """Whatever was folded, and when; a fold is not repeated, and what it read is gone."""
    path, whole = str(tmp_path / "log"), None
    for day in range(6):
        on_day(day)
        new = events(table, 8, day)
        whole = new if whole is None else whole.unionByName(new)
        store.append_events(new, path, s.ALERT_EVENTS)
        store.append_events(new, path, s.ALERT_EVENTS, "batch_id=3")
        if day in (2, 3, 5):
            store.fold_events(spark, path, s.ALERT_EVENTS)
            store.fold_events(spark, path, s.ALERT_EVENTS)
        assert state(store.read_events(spark, path, s.ALERT_EVENTS)) == state(whole)
    assert store._named(spark, path, "upto") == ["2024-05-05"] and store._named(spark, path, "day") == ["2024-05-05", "2024-05-06"]
    found = store.read_events(spark, path, s.ALERT_EVENTS)
    assert found.where("metadata is not null").count() > 0 and found.columns == s.ALERT_EVENTS.fieldNames()


def test_files_read_do_not_grow_with_the_runs(spark, on_day, tmp_path):
    root, files = str(tmp_path), []
    for day in range(5):
        on_day(day)
        for i in range(4):
            at = dt.datetime(2024, 5, 1, 8, i, tzinfo=dt.timezone.utc) + dt.timedelta(days=day)
            store.append_log(spark, root, {"run_id": f"r{day}{i}", "timestamp": at, "table_name": "objects", "status": "SUCCESS",
                                           "version": f"v{day}{i}", "errors": ["x"], "rows": i})
        store.fold_import_log(spark, root)
        log = store.import_log(spark, root)
        files.append(len(log.inputFiles()))
        assert [r["run_id"] for r in dicts(log)] == [f"r{d}{i}" for d in range(day + 1) for i in range(4)]
        assert store.current_version(spark, root, "objects") == f"v{day}3"
    assert files[0] == 4 and set(files[2:]) == {9}  # a snapshot, yesterday and today


@pytest.mark.parametrize("crash", ["before the snapshot is whole", "before the days are deleted"])
def test_crash_within_a_fold(spark, table, on_day, tmp_path, monkeypatch, crash):
    path = str(tmp_path / "log")
    on_day(0)
    store.append_events(events(table, 8, 0), path, s.ALERT_EVENTS)
    on_day(3)
    store.append_events(events(table, 8, 3), path, s.ALERT_EVENTS)
    before = state(store.read_events(spark, path, s.ALERT_EVENTS))
    with monkeypatch.context() as broken:
        broken.setattr(store, "tidy", lambda *_: None)
        store.fold_events(spark, path, s.ALERT_EVENTS)
    if crash == "before the snapshot is whole":
        store.removed(spark, f"{path}/upto=2024-05-03/_SUCCESS")
        for part in (tmp_path / "log" / "upto=2024-05-03").glob("*.parquet"):
            part.unlink()
    assert len(store._named(spark, path, "day")) == 2
    assert state(store.read_events(spark, path, s.ALERT_EVENTS)) == before
    store.fold_events(spark, path, s.ALERT_EVENTS)
    store.tidy(spark, path)
    assert state(store.read_events(spark, path, s.ALERT_EVENTS)) == before
    assert store._named(spark, path, "day") == ["2024-05-04"]


def test_log_without_entries(spark, tmp_path):
    assert store.read_events(spark, str(tmp_path / "none"), s.ALERT_EVENTS).count() == 0
    store.fold_events(spark, str(tmp_path / "none"), s.ALERT_EVENTS)
    assert store.current_version(spark, str(tmp_path), "objects") is None
    assert store.first_events(store.read_events(spark, str(tmp_path / "none"), s.ALERT_EVENTS)).agg(F.count("*")).first()[0] == 0
