import pytest
from helpers import dicts

from trunkwatch.operators import latest, listing, stats
from trunkwatch.plans import report


def ids(df):
    return [r["diag_id"] for r in df.select("diag_id").collect()]


@pytest.fixture(scope="module")
def sample(diagnostics):
    return diagnostics(
        {"object_id": 1, "date": "2024-01-01", "defect_found": True, "param1": 10.0, "ml_label": "high"},
        {"object_id": 1, "date": "2024-01-01", "defect_found": True, "param1": None, "method": "VIK"},
        {"object_id": 2, "date": "2024-03-01", "defect_found": False},
        {"object_id": 9, "date": "2024-02-01", "defect_found": True, "param1": float("inf"), "ml_label": "high"},
        {"object_id": 0, "date": None, "defect_found": None, "ml_label": None},
        {"object_id": None, "date": "2023-12-31T10:00", "defect_found": True, "ml_label": "medium"})


@pytest.fixture(scope="module")
def places(objects):
    return objects({"object_id": 0}, {"object_id": 1}, {"object_id": 1, "object_name": "copy"},
                   {"object_id": 2, "pipeline_id": "MT-02", "lat": float("nan")})


def test_listing_is_newest_first_and_cut_before_the_join(sample, places):
    assert ids(listing.list_diagnostics(sample, places, limit=2)) == [3, 4]
    rows = dicts(listing.list_diagnostics(sample, places, limit=4))
    assert [r["diag_id"] for r in rows] == [3, 4, 1, 1, 2, 2]  # both copies of object 1
    assert rows[1]["param1"] is None and rows[1]["object_name"] is None
    assert rows[0]["lat"] is None
    assert ids(listing.list_diagnostics(sample, places))[-1] == 5  # no date: last


@pytest.mark.parametrize("k", [101, 150, 290, 300, 301, 500])
def test_long_lists_equal_short_ones(diagnostics, k):
    """Past the length from which dates are counted first."""
    rows = diagnostics(*[{"object_id": 1, "date": None if i % 30 == 7 else f"2024-01-{1 + i * 7 % 28:02d}"}
                         for i in range(300)]).repartition(7)
    plain = rows.orderBy(*listing.newest_first()).limit(k)
    assert ids(listing.newest(rows, k).orderBy(*listing.newest_first())) == ids(plain.orderBy(*listing.newest_first()))


@pytest.mark.parametrize("filters, expected", [
    ({"object_id": 0}, {5}),
    ({"object_id": 1}, {1, 2}),
    ({"method": "VIK"}, {2}),
    ({"ml_label": "high"}, {1, 4}),
    ({"defect_only": True}, {1, 2, 4, 6}),
    ({"pipeline_id": "MT-02"}, {3}),
    ({"pipeline_id": "MT-01", "defect_only": True}, {1, 2}),
    ({"date_from": "2024-01-01", "date_to": "2024-02-01"}, {1, 2, 4}),
    ({"date_to": "2023-12-31"}, set()),  # a time of day sorts behind the bare date
    ({"object_id": 77}, set()),
])
def test_filters(sample, places, filters, expected):
    assert set(ids(listing.filter_diagnostics(sample, places, **filters))) == expected


def test_objects(places):
    assert listing.list_objects(places).count() == 4
    assert listing.list_objects(places, pipeline_id="MT-02", object_type="crane").count() == 1
    assert listing.list_objects(places, object_type="valve").count() == 0
    assert dicts(listing.object_profile(places, 2))[0]["lat"] is None
    assert listing.object_profile(places, 0).count() == 1
    assert listing.object_profile(places, 5).count() == 0


@pytest.mark.parametrize("by, descending, expected", [
    ("date", True, [1, 2]), ("date", False, [1, 2]), ("depth", True, [1, 2]), ("depth", False, [2, 1])])
def test_sorting(sample, by, descending, expected):
    assert ids(listing.sorted_diagnostics(sample, 1, by, descending)) == expected


def test_sorting_rejects_other_keys(sample):
    with pytest.raises(ValueError):
        listing.sorted_diagnostics(sample, 1, "name")


def test_joins(sample, places):
    assert set(ids(listing.orphans(sample, places))) == {4, 6}
    assert ids(listing.with_object(sample, places, "object_name")).count(1) == 2
    assert set(ids(listing.with_object(sample, places, "object_name", how="inner"))) == {1, 2, 3, 5}
    assert sorted(ids(listing.on_line(sample, places, "MT-01"))) == [1, 2, 5]


def test_summaries(sample, places):
    assert stats.dashboard_summary(places, sample).first().asDict() == {
        "total_objects": 4, "total_inspections": 6, "total_defects": 4, "defect_rate": 66.67}
    assert stats.report_summary(sample, places, "MT-02").first().asDict() == {
        "total_inspections": 1, "total_defects": 0, "risk_normal": 1, "risk_medium": 0, "risk_high": 0,
        "defect_rate": 0.0}


def test_empty_tables(diagnostics, objects, pipelines):
    nothing, nowhere = diagnostics(), objects()
    assert stats.dashboard_summary(nowhere, nothing).first()["defect_rate"] == 0.0
    assert stats.report_summary(nothing).first()["defect_rate"] == 0.0
    assert dicts(stats.trunkline_stats(pipelines("MT-01"), nowhere, nothing))[0]["objects_count"] == 0
    assert stats.yearly_trend(nothing).count() == 0
    assert latest.map_points(nothing, nowhere).count() == 0
    assert [r["position"] for r in dicts(report.recommendations(nothing))] == [0, 1]


def test_counts_leave_out_nulls(sample):
    assert [tuple(r) for r in stats.risk_distribution(sample).collect()] == [
        ("high", 2), ("normal", 2), ("medium", 1)]


def test_orphans_shorten_a_top_list(sample, places):
    rows = dicts(stats.top_risk_objects(sample, places))
    assert {r["object_id"] for r in rows} == {1} and len(rows) == 2
    assert stats.top_objects(sample, places, 1, "object_name").count() == 2  # object 1, twice stored


def test_lines(sample, places, pipelines):
    rows = {r["pipeline_id"]: r for r in dicts(stats.trunkline_stats(
        pipelines("MT-01", "MT-02", "MT-03"), places, sample))}
    assert rows["MT-01"] == {"pipeline_id": "MT-01", "name": "line MT-01", "objects_count": 3,
                             "inspections_count": 3, "defects_count": 2, "high_risk_count": 1,
                             "needs_attention": True}
    assert rows["MT-03"]["inspections_count"] == 0 and not rows["MT-03"]["needs_attention"]
    shares = {r["pipeline_id"]: r["defect_share"] for r in dicts(stats.defect_object_share(places, sample))}
    assert shares == {"MT-01": pytest.approx(1 / 3), "MT-02": 0.0}


def test_history_and_totals(sample, places):
    assert [tuple(r) for r in stats.object_history(sample, 1).collect()] == [(1, 2024, 2, 2, 1)]
    totals = {r["object_id"]: (r["total_inspections"], r["defects_count"])
              for r in dicts(stats.object_totals(places, sample))}
    assert totals == {0: (1, 0), 1: (2, 2), 2: (1, 0)}
    assert dicts(stats.object_totals(places, sample, 2))[0]["total_inspections"] == 1


def test_latest_and_map(sample, places):
    newest = {r["object_id"]: r["diag_id"] for r in dicts(latest.latest_per_object(sample))}
    assert newest == {0: 5, 1: 2, 2: 3, 9: 4}
    points = {r["object_id"]: r for r in dicts(latest.map_points(sample, places))}
    assert set(points) == {1, 9} and points[1]["object_name"] == "copy"
    assert points[9]["lat"] == 0.0 and points[9]["object_name"] is None
    everything = latest.map_points(sample, places, defect_only=False)
    assert {r["object_id"]: r["lat"] for r in dicts(everything)}[2] == 0.0
    assert {r["object_id"] for r in dicts(latest.map_points(sample, places, pipeline_id="MT-01"))} == {1}
    assert latest.map_points(sample, places, date_from="2024-02-02").count() == 0


def test_latest_of_odd_rows(diagnostics):
    """No date, a text that is none, no id, and rows that differ in nothing that orders them."""
    rows = diagnostics(
        {"diag_id": 1, "object_id": 1, "date": None}, {"diag_id": 2, "object_id": 1, "date": "2024-13-45"},
        {"diag_id": 9, "object_id": 2, "date": None}, {"diag_id": None, "object_id": 2, "date": "1999-01-01"},
        {"diag_id": -(1 << 63), "object_id": 3, "date": "2024-01-02"}, {"diag_id": (1 << 63) - 1, "object_id": 3, "date": "2024-01-01"},
        {"diag_id": 5, "object_id": 4, "date": "2024-01-01", "method": "UZK"}, {"diag_id": 5, "object_id": 4, "date": "2024-01-01", "method": "VIK"},
        *[{"diag_id": 6, "object_id": 5, "date": "2024-01-01"}] * 3, {"diag_id": 7, "object_id": None, "date": "2024-01-01"})
    found = dicts(latest.latest_per_object(rows))
    assert {r["object_id"]: r["diag_id"] for r in found} == {1: 2, 2: None, 3: -(1 << 63), 4: 5, 5: 6} and len(found) == 5
    assert next(r["method"] for r in found if r["object_id"] == 4) == "VIK"


def test_polylines(places, pipelines):
    rows = [tuple(r)[:3] for r in latest.trunkline_polylines(pipelines("MT-01", "MT-02", "MT-03"), places).collect()]
    assert [(p, o) for p, _, o in rows] == [("MT-01", 0), ("MT-01", 1), ("MT-01", 1), ("MT-02", 2)]


def test_report_tables(sample, places):
    rows = dicts(report.high_risk_top(sample, places, k=2))
    assert [r["diag_id"] for r in rows] == [4, 1]
    assert dicts(report.top_objects(sample, places, k=1))[0]["defect_count"] == 2
    lines = [r["line"] for r in dicts(report.recommendations(sample))]
    assert "2 объектам" in lines[0] and "(66.67%)" in lines[1] and len(lines) == 4
