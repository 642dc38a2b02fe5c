import re
import time

from helpers import dicts

from trunkwatch.operators.alerts import current_alerts, defect_alerts
from trunkwatch.streaming import alerts as alert_streams, imports as import_streams


def sample(diagnostics, first, n=12):
    return diagnostics(*[
        {"diag_id": first + i, "object_id": (first + i) % 5, "date": "2024-01-01" if i % 4 else "2024-99-01",
         "defect_found": i % 2 == 0, "ml_label": ["high", "medium", "normal"][i % 3]} for i in range(n)])


def run_import(spark, objects, folder, files_per_batch=1):
    stream = import_streams.watch(spark, f"{folder}/drop", files_per_batch=files_per_batch)
    import_streams.stream_import(stream, objects, f"{folder}/arrived", f"{folder}/state").awaitTermination()


def outcome(spark, folder):
    good = sorted(r["diag_id"] for r in dicts(import_streams.accepted(spark, f"{folder}/arrived")))
    bad = sorted(((r["diag_id"], r["reasons"]) for r in dicts(import_streams.quarantined(spark, f"{folder}/arrived"))), key=str)
    return good, bad


def test_outcome_does_not_depend_on_the_batches(spark, diagnostics, objects, tmp_path):
    known = objects(*[{"object_id": i} for i in range(4)])
    found = []
    for files_per_batch in (1, 1000):
        folder = tmp_path / str(files_per_batch)
        for first in (100, 200, 300):
            sample(diagnostics, first).coalesce(1).write.mode("append").parquet(f"{folder}/drop")
        run_import(spark, known, folder, files_per_batch)
        sample(diagnostics, 306).coalesce(1).write.mode("append").parquet(f"{folder}/drop")  # six keys again
        run_import(spark, known, folder, files_per_batch)  # goes on from its checkpoint
        found.append(outcome(spark, folder))
    good, bad = found[0]
    assert found[0] == found[1] and len(good) + len(bad) == 48
    assert (100, ["invalid_date"]) in bad and (104, ["invalid_date", "orphan_object_id"]) in bad
    assert [r for r in bad if r[0] == 307] == [(307, ["duplicate_diag_id"])] * 2 and 307 not in good and 302 in good
    assert [r for r in bad if r[0] == 309] == [(309, ["duplicate_diag_id", "orphan_object_id"])] * 2


def test_a_batch_counts_its_own_keys_only(spark, diagnostics, objects, tmp_path):
    """What the second run tells of keys is about its own; the outcome aggregates no rows that arrived."""
    known = objects(*[{"object_id": i} for i in range(5)])
    sample(diagnostics, 100).coalesce(1).write.mode("append").parquet(f"{tmp_path}/drop")
    sample(diagnostics, 106).coalesce(1).write.mode("append").parquet(f"{tmp_path}/drop")  # six keys again
    run_import(spark, known, tmp_path, 1000)
    told = lambda: {(r["diag_id"], r["times"]) for r in dicts(import_streams.repeated_keys(spark, f"{tmp_path}/arrived"))}
    assert told() == {(i, 2) for i in range(106, 112)}
    sample(diagnostics, 110, 3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/drop")  # 110, 111 once more, 112 again
    run_import(spark, known, tmp_path, 1000)
    assert told() == {(i, 2) for i in range(106, 113)} | {(110, 3), (111, 3)}
    outcome_ = import_streams.judged_arrivals(spark, f"{tmp_path}/arrived")
    counted = {r["diag_id"] for r in dicts(import_streams.outcome(import_streams.arrivals(spark, f"{tmp_path}/arrived"))) if "duplicate_diag_id" in r["reasons"]}
    assert {r["diag_id"] for r in dicts(outcome_) if "duplicate_diag_id" in r["reasons"]} == counted == set(range(106, 113))
    text = import_streams.judged_arrivals(spark, f"{tmp_path}/arrived")._jdf.queryExecution().executedPlan().toString()
    rows = re.findall(r"FileScan parquet \[diag_id[^\]]*reasons", text)
    assert len(rows) == 1 and not re.search(r"partial_count", text)


def test_a_diagnostic_delivered_again(spark, diagnostics, objects, tmp_path):
    """While it is remembered no event is added, afterwards an event and no alert."""
    known, first = objects(*[{"object_id": i} for i in range(5)]), sample(diagnostics, 100)
    defects = first.where("defect_found").count()

    def deliver(folder, remembered, rows=first):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/drop")
        stream = import_streams.watch(spark, f"{folder}/drop", files_per_batch=1)
        alert_streams.stream_alerts(stream, known, f"{folder}/log", f"{folder}/state", remembered).awaitTermination()
        events = alert_streams.alert_events(spark, f"{folder}/log")
        return events.count(), current_alerts(events).count()

    assert [deliver(tmp_path / "long", "7 days") for _ in range(3)] == [(defects, defects)] * 3
    deliver(tmp_path / "short", "1 second")
    time.sleep(3)
    deliver(tmp_path / "short", "1 second", sample(diagnostics, 500, 1))  # moves the watermark on
    n_events, n_alerts = deliver(tmp_path / "short", "1 second")
    assert n_alerts == defects + 1 and n_events > n_alerts


def test_repeated_batch_replaces_itself(spark, diagnostics, objects, tmp_path):
    known, batch = objects({"object_id": 1}), diagnostics({"object_id": 1, "date": "2024-01-01", "defect_found": True})
    for _ in range(2):
        import_streams.keep(batch, 7, known, f"{tmp_path}/arrived")
        alert_streams.log_alerts(batch, 7, known, f"{tmp_path}/log")
    assert import_streams.accepted(spark, f"{tmp_path}/arrived").count() == 1
    assert alert_streams.alert_events(spark, f"{tmp_path}/log").count() == 1


def test_rows_of_a_repeated_key_are_set_aside(diagnostics, objects):
    known = objects({"object_id": 1}, {"object_id": 1})
    rows = diagnostics({"diag_id": 1, "object_id": 1, "date": "2024-01-01"}, {"diag_id": 1, "object_id": 1, "date": "2024-01-02"},
                       {"diag_id": None, "object_id": 1, "date": "2024-01-01"}, {"diag_id": 3, "object_id": 1, "date": "2024-01-01"})
    found = [(r["diag_id"], r["reasons"]) for r in dicts(import_streams.outcome(import_streams.judged(rows, known)))]
    assert sorted(found, key=str) == sorted([(1, ["duplicate_diag_id"]), (1, ["duplicate_diag_id"]),
                                             (None, ["null_diag_id"]), (3, [])], key=str)


def test_csv_drop_folder(spark, diagnostics, objects, tmp_path):
    sample(diagnostics, 1).coalesce(1).write.option("header", True).csv(f"{tmp_path}/drop")
    stream = import_streams.watch(spark, f"{tmp_path}/drop", fmt="csv")
    known = objects(*[{"object_id": i} for i in range(5)])
    import_streams.stream_import(stream, known, f"{tmp_path}/arrived", f"{tmp_path}/state").awaitTermination()
    assert import_streams.accepted(spark, f"{tmp_path}/arrived").count() == 9


def test_alerts_come_once_for_good_and_reach_the_log(spark, diagnostics, objects, tmp_path):
    known = objects(*[{"object_id": i, "pipeline_id": f"MT-0{i}"} for i in range(4)])
    first, second = sample(diagnostics, 100), sample(diagnostics, 106)  # six rows twice
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/drop")
        stream = import_streams.watch(spark, f"{tmp_path}/drop", files_per_batch=1)
        alert_streams.stream_alerts(stream, known, f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    events = alert_streams.alert_events(spark, f"{tmp_path}/log")
    sent = sorted(map(tuple, alert_streams.defect_alerts_of(events).collect()), key=str)
    assert sent == sorted(map(tuple, defect_alerts(first.unionByName(second), known).distinct().collect()), key=str)
    assert {r["alert_id"] for r in dicts(current_alerts(events))} == {r[0] for r in sent}
