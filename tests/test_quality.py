import pytest
from helpers import dicts

from trunkwatch import schema as s
from trunkwatch.operators import quality


def by_rule(df):
    return {r["rule"]: r["n_bad"] for r in dicts(df)}


def test_objects(objects):
    bad = objects({"object_id": 1}, {"object_id": 1}, {"object_id": 1, "lat": 91.0}, {"object_id": 2, "lat": None},
                  {"object_id": 3, "object_type": None, "lon": -180.5}, {"object_id": None, "lat": float("nan")})
    found = quality.validate_objects(bad)
    counts = by_rule(found)
    assert counts["duplicate_object_id"] == 2
    assert (counts["latitude_out_of_range"], counts["longitude_out_of_range"]) == (1, 1)
    assert (counts["unknown_object_type"], counts["null_object_type"]) == (1, 1)
    assert (counts["null_lat"], counts["null_object_id"], counts["null_lon"]) == (2, 1, 0)
    assert not any(r["is_valid"] for r in dicts(found))


def test_warnings_do_not_invalidate(objects, diagnostics):
    odd = diagnostics({"object_id": 1, "method": None, "date": "soon", "quality_grade": "?", "ml_label": "?",
                       "defect_found": True})
    found = quality.validate_diagnostics(odd, objects({"object_id": 1}))
    assert all(r["is_valid"] for r in dicts(found))
    assert by_rule(found) == {
        "unknown_method": 1, "null_date": 0, "invalid_date": 1, "unknown_quality_grade": 1,
        "unknown_ml_label": 1, "missing_param1": 1, "duplicate_diag_id": 0, "orphan_object_id": 0}


def test_orphans(objects, diagnostics):
    found = diagnostics(*[{"object_id": i} for i in (1, 7, 7, 5, None)])
    known = objects({"object_id": 1})
    assert by_rule(quality.validate_diagnostics(found, known))["orphan_object_id"] == 4
    assert "orphan_object_id" not in by_rule(quality.validate_diagnostics(found))
    assert {(r["object_id"], r["n_rows"]) for r in dicts(quality.orphan_ids(found, known))} == {
        (7, 2), (5, 1), (None, 1)}
    assert quality.first_orphans(found, known).first()["examples"] == "null, 5, 7"


def test_optional_columns(diagnostics):
    plain = diagnostics({"object_id": 1}).drop("quality_grade", "ml_label", "param1")
    assert set(by_rule(quality.validate_diagnostics(plain))) == {
        "unknown_method", "null_date", "invalid_date", "duplicate_diag_id"}


def test_examples_repeat_like_the_key_does(diagnostics):
    rows = diagnostics(*[{"object_id": 1, "diag_id": i} for i in (5, 5, 5, 3, 3, 9, 8, 8, 8, 8, 8, 8)])
    assert quality.first_repeats(rows, "diag_id").first()["examples"] == "3, 5, 5, 8, 8"
    assert quality.count_repeats(rows, "diag_id").first()[0] == 8
    assert quality.first_repeats(diagnostics({"object_id": 1}), "diag_id").first()["examples"] == ""


def test_startup_is_stricter(objects, diagnostics):
    rows = diagnostics({"object_id": 1, "method": "AE", "date": "2024-01-01"},
                       {"object_id": 1, "date": "2024-13-01"}, {"object_id": 1, "date": None})
    found = dicts(quality.validate_at_startup(objects({"object_id": 1}), rows))
    counts = {(r["table_name"], r["rule"]): r["n_bad"] for r in found}
    assert counts[("diagnostics", "unknown_method")] == 1 and counts[("diagnostics", "invalid_date")] == 1
    assert {r["table_name"]: r["is_valid"] for r in found} == {"objects": True, "diagnostics": False}
    empty = {(r["table_name"], r["rule"]): r["n_bad"] for r in dicts(
        quality.validate_at_startup(objects(), diagnostics()))}
    assert empty[("objects", "empty_table")] == empty[("diagnostics", "empty_table")] == 1


def test_counts_add_up_to_the_listed_values(diagnostics):
    rows = diagnostics(*[{"object_id": 1, "method": m} for m in ("XX", "XX", "YY", None, "UZK", "AE")])
    listed = quality.offending_values(rows, "method", s.METHODS_AT_IMPORT)
    assert {r["value"]: r["n_rows"] for r in dicts(listed)} == {"XX": 2, "YY": 1, None: 1}
    assert by_rule(quality.validate_diagnostics(rows))["unknown_method"] == 4


@pytest.mark.parametrize("columns, table, startup, missing", [
    (["diag_id", "object_id", "method", "date"], "diagnostics", False, ["defect_found"]),
    (["diag_id", "object_id", "method", "date"], "diagnostics", True, []),
    (["Object_ID", "object_name", "pipeline_id", "lat", "lon"], "objects", True, ["object_id"]),
])
def test_missing_columns(columns, table, startup, missing):
    assert quality.missing_columns(columns, table, startup) == missing
