import datetime as dt
import random

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from trunkwatch import schema as s
from trunkwatch.operators import alerts
from trunkwatch.sources import store

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def event(action, alert_id, minutes):
    return {"action": action, "alert_id": alert_id, "event_at": START + dt.timedelta(minutes=minutes),
            "message": f"m{alert_id}" if action == "created" else None,
            "type": "info" if action == "created" else None}


def replay(events):
    """The state as a list that is changed event by event, and what each read-all marked."""
    state, marked = {}, {}
    for e in sorted(events, key=lambda e: e["event_at"]):
        if e["action"] == "created":
            state[e["alert_id"]] = False
        elif e["action"] == "read" and e["alert_id"] in state:
            state[e["alert_id"]] = True
        elif e["action"] == "deleted":
            state.pop(e["alert_id"], None)
        elif e["action"] == "read_all":
            marked[e["event_at"].replace(tzinfo=None)] = sum(not read for read in state.values())
            state = dict.fromkeys(state, True)
    return state, marked


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_replay_in_any_order(table, seed):
    rnd = random.Random(seed)
    minutes = rnd.sample(range(60 * 24 * 9), 200)
    born = {f"a{i}": minutes.pop() for i in range(60)}
    events = [event("created", a, m) for a, m in born.items()]
    for a, m in born.items():
        for action, share in (("read", 0.4), ("deleted", 0.2)):
            if rnd.random() < share:
                later = [x for x in minutes if x > m]
                if later:
                    at = rnd.choice(later)
                    minutes.remove(at)
                    events.append(event(action, a, at))
    events += [event("read_all", None, minutes.pop()) for _ in range(12)]
    state, marked = replay(events)
    rnd.shuffle(events)
    log = table(s.ALERT_EVENTS, *events).repartition(5)
    now = alerts.current_alerts(log)
    assert {r["alert_id"]: r["is_read"] for r in dicts(now)} == state
    assert {r["event_at"]: r["marked_count"] for r in dicts(alerts.read_all_marks(log))} == marked
    assert alerts.unread_count(now).first()[0] == sum(not read for read in state.values())


def test_events_logged_twice_change_nothing(table):
    events = [event("created", "a", 0), event("created", "b", 9), event("read_all", None, 5)]
    once, twice = table(s.ALERT_EVENTS, *events), table(s.ALERT_EVENTS, *events, *events)
    assert sorted(dicts(alerts.current_alerts(once)), key=str) == sorted(dicts(alerts.current_alerts(twice)), key=str)
    assert dicts(alerts.read_all_marks(twice))[0]["marked_count"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_next_mark_over_many_partitions(spark, table, seed):
    """Marks many partitions away, several rows of one instant, and rows after the last mark."""
    rnd = random.Random(seed)
    rows = [(rnd.randrange(300), None) for _ in range(400)] + [(77, None)] * 200 + [(m, m) for m in rnd.sample(range(250), 4 + seed) + [77]]
    rows = list({(at, mark, i if mark is None else 0) for i, (at, mark) in enumerate(rows)})
    frame = spark.createDataFrame([(START + dt.timedelta(seconds=at), None if mark is None else START + dt.timedelta(seconds=mark), f"a{i}")
                                   for at, mark, i in rows], "at timestamp, mark timestamp, alert_id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = alerts.next_mark(frame).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    marks = sorted({r.mark for r in found if r.mark})
    assert len(found) == len(rows)
    assert all(r.next_mark == next((m for m in marks if m >= r.at), None) for r in found)


def test_read_alls_without_time_and_events_of_unknown_alerts_count_nothing(table):
    log = table(s.ALERT_EVENTS, event("created", "a", 3), {"action": "read_all"}, event("read_all", None, 3), event("read", "b", 1),
                event("created", None, 1), event("read_all", "c", 9))
    marked = {r["event_at"]: r["marked_count"] for r in dicts(alerts.read_all_marks(log))}
    assert marked == {(START + dt.timedelta(minutes=m)).replace(tzinfo=None): n for m, n in ((3, 1), (9, 0))}


def test_log_without_read_all(table):
    log = table(s.ALERT_EVENTS, event("created", "a", 0), event("read", "x", 1))
    assert [r["is_read"] for r in dicts(alerts.current_alerts(log))] == [False]
    assert alerts.read_all_marks(log).count() == 0


def test_listing(table):
    log = table(s.ALERT_EVENTS, *[event("created", f"a{i}", i) for i in range(5)], event("read", "a4", 9))
    now = alerts.current_alerts(log)
    assert [r["alert_id"] for r in dicts(alerts.list_alerts(now, limit=2))] == ["a4", "a3"]
    assert [r["alert_id"] for r in dicts(alerts.list_alerts(now, unread_only=True, limit=2))] == ["a3", "a2"]
    assert alerts.list_alerts(now).count() == alerts.list_alerts(now, limit=0).count() == 5


def test_defect_alerts(diagnostics, objects):
    found = diagnostics({"object_id": 1, "defect_found": True, "ml_label": "high"},
                        {"object_id": 1, "defect_found": True, "ml_label": "medium"},
                        {"object_id": 9, "defect_found": True}, {"object_id": 1})
    rows = {r["alert_id"]: r for r in dicts(alerts.defect_alerts(found, objects({"object_id": 1}, {"object_id": 1})))}
    assert {k: r["type"] for k, r in rows.items()} == {
        "defect_detection-1": "error", "defect_detection-2": "warning", "defect_detection-3": "info"}
    assert rows["defect_detection-1"]["message"] == (
        "Обнаружен дефект на трубопроводе MT-01, объект 1 (КРИТИЧЕСКИЙ УРОВЕНЬ РИСКА)")
    assert rows["defect_detection-3"]["message"] == "Обнаружен дефект на трубопроводе -, объект 9"


def test_log_round_trip(spark, diagnostics, objects, tmp_path):
    found = alerts.defect_alerts(diagnostics({"object_id": 1, "defect_found": True}), objects({"object_id": 1}))
    events = alerts.created_events(found, F.lit(START), "pipeline_id", "object_id")
    path = str(tmp_path / "log")
    store.append_events(events, path, s.ALERT_EVENTS)
    store.append_events(events, path, s.ALERT_EVENTS)
    log = store.read_events(spark, path, s.ALERT_EVENTS)
    assert log.count() == 2 and alerts.current_alerts(log).count() == 1
    assert log.first()["metadata"] == {"pipeline_id": "MT-01", "object_id": "1"}


def test_run_alerts(table):
    log = table(s.IMPORT_LOG,
                {"run_id": "1", "table_name": "objects", "file": "o.csv", "status": "SUCCESS", "rows": 3},
                {"run_id": "2", "table_name": "diagnostics", "file": "d.csv", "status": "SUCCESS", "rows": 4},
                {"run_id": "3", "table_name": "diagnostics", "file": "d.csv", "status": "FAILED", "errors": ["x", "y", "z"]})
    assert [(r["message"], r["type"]) for r in dicts(alerts.run_alerts(log).orderBy("alert_id"))] == [
        ("Импортировано 3 объектов из o.csv", "success"),
        ("Импортировано 4 диагностик из d.csv. ML модель переобучена.", "success"),
        ("Ошибка импорта d.csv: x; y", "error")]


def test_other_alerts(spark):
    fits = spark.createDataFrame([("f", 0.98765, 15)], "fit_id string, accuracy double, features_count int")
    assert alerts.training_alerts(fits).first()["message"] == "ML модель обучена. Точность: 98.77%, признаков: 15"
    reports = spark.createDataFrame([("r", "PDF", None)], "report_id string, report_type string, pipeline_id string")
    assert alerts.report_alerts(reports).first()["message"] == "Отчет (PDF) для трубопровода - успешно создан"
