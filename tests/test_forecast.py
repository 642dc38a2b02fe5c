import datetime as dt
import random

import pytest
from helpers import dicts
from pyspark.sql import functions as F

from trunkwatch import schema as s
from trunkwatch.operators import forecast


def history(object_id, *rows):
    """Rows of (date, depth); a depth of None is a clean inspection."""
    return [{"object_id": object_id, "date": day, "defect_found": depth is not None, "param1": depth}
            for day, depth in rows]


def forecast_one(objects, diagnostics, rows, object_id=1):
    df = forecast.object_forecast(objects({"object_id": object_id}), diagnostics(*rows))
    return df.first().asDict()


def test_same_day_defects_have_no_slope(objects, diagnostics):
    got = forecast_one(objects, diagnostics, history(
        1, ("2024-01-01", None), ("2024-02-01", 10.0), ("2024-02-01", 20.0)))
    assert (got["slope"], got["predicted_depth"], got["trend"]) == (0.0, 15.0, "stable")
    assert got["current_depth"] == 20.0  # the larger diag_id of the day
    assert (got["risk_probability"], got["next_inspection_date"]) == (0.25, "2025-01-31")


def test_too_few_inspections(objects, diagnostics):
    got = forecast_one(objects, diagnostics, history(1, ("2024-01-01", 50.0), ("2024-02-01", 60.0)))
    assert got["status"] == "insufficient_data" and got["risk_probability"] == 0.0
    assert got["message"] == s.MSG_INSUFFICIENT
    assert all(got[n] is None for n in ("next_inspection_date", "recommended_method", "trend", "slope"))


def test_never_inspected(objects, diagnostics):
    got = forecast_one(objects, diagnostics, history(2, ("2024-01-01", 50.0)))
    assert got["status"] == "insufficient_data"


def test_no_defect(objects, diagnostics):
    got = forecast_one(objects, diagnostics, history(
        1, ("2023-01-01", None), ("2023-06-01", None), ("2024-01-01", None)))
    assert (got["risk_probability"], got["next_inspection_date"], got["recommended_method"], got["trend"]) == (
        0.05, "2024-12-31", "VIK", "stable")
    assert got["current_depth"] is None and got["last_inspection"] is None


def test_one_defect(objects, diagnostics):
    got = forecast_one(objects, diagnostics, history(
        1, ("2023-01-01", None), ("2023-06-01", 45.0), ("2024-01-01", None)))
    assert (got["risk_probability"], got["next_inspection_date"], got["recommended_method"], got["trend"]) == (
        0.3, "2024-06-29", "UZK", "unknown")


def test_null_depth_counts_as_zero(objects, diagnostics):
    rows = history(1, ("2024-01-01", 10.0), ("2024-01-11", 10.0), ("2024-01-21", 10.0))
    rows[2]["param1"] = None
    got = forecast_one(objects, diagnostics, rows)
    assert got["current_depth"] == 0.0 and got["trend"] == "decreasing" and got["predicted_depth"] == 0.0


@pytest.mark.parametrize("depth, risk", [(25.0, 0.25), (25.01, 0.65), (30.0, 0.65), (40.0, 0.65), (40.01, 0.85)])
def test_tier_edges_are_strict(objects, diagnostics, depth, risk):
    got = forecast_one(objects, diagnostics, history(
        1, ("2024-01-01", depth), ("2024-02-01", depth), ("2024-03-01", depth)))
    assert got["risk_probability"] == risk and got["predicted_depth"] == depth


def test_tier_of_unrounded_values(spark):
    df = spark.createDataFrame([(50.0, 0.0), (50.000001, 0.0), (30.0, 25.0), (30.000001, 0.0)], "p double, c double")
    tier = forecast.risk_tier(F.col("p"), F.col("c"))
    assert [r["r"] for r in dicts(df.select(tier["risk_probability"].alias("r")))] == [0.65, 0.85, 0.25, 0.65]


def test_line_matches_least_squares(objects, diagnostics):
    random.seed(5)
    days = sorted(random.sample(range(3000), 40))
    points = [(dt.date(2015, 1, 1) + dt.timedelta(days=d), round(random.uniform(0, 60), 2)) for d in days]
    got = forecast_one(objects, diagnostics, history(1, *[(d.isoformat(), y) for d, y in points]))
    xs, ys = [d - days[0] for d in days], [y for _, y in points]
    mx, my = sum(xs) / 40, sum(ys) / 40
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / sum((x - mx) ** 2 for x in xs)
    predicted = max(0, my - slope * mx + slope * (xs[-1] + 365))
    assert got["slope"] == pytest.approx(slope, abs=6e-5)
    assert got["predicted_depth"] == pytest.approx(predicted, abs=6e-3)
    assert got["current_depth"] == ys[-1] and got["defect_count"] == 40


def test_slope_does_not_depend_on_the_origin(objects, diagnostics):
    base = [("2020-01-01", 12.0), ("2020-07-19", 19.5), ("2021-03-02", 18.25), ("2022-11-30", 27.0)]
    seen = set()
    for shift in (-20000, 0, 365, 9999):
        rows = [((dt.date.fromisoformat(d) + dt.timedelta(days=shift)).isoformat(), y) for d, y in base]
        got = forecast_one(objects, diagnostics, history(1, *rows))
        seen.add((got["slope"], got["predicted_depth"], got["risk_probability"]))
    assert len(seen) == 1


def test_growth_drops_fractions(spark):
    df = spark.createDataFrame([(10,), (19,), (20,), (0,)], "n long")
    assert [r["g"] for r in dicts(df.select(forecast.grown(F.col("n")).alias("g")))] == [11, 20, 22, 0]


def risky(object_id, n=3):
    return history(object_id, *[(f"2024-0{m}-01", 45.0) for m in range(1, n + 1)])


def test_top_risks_take_an_object_once(objects, diagnostics):
    twice = objects({"object_id": 1, "object_name": "b"}, {"object_id": 1, "object_name": "a"}, {"object_id": 2})
    rows = dicts(forecast.top_risks(twice, diagnostics(*risky(2), *risky(1), *risky(9)), 5))
    assert [(r["object_id"], r["object_name"]) for r in rows] == [(1, "a"), (2, "object 2")]
    with pytest.raises(ValueError):
        forecast.top_risks(twice, diagnostics(), 101)


def test_cut_comes_before_the_line_filter(objects, diagnostics):
    two = objects({"object_id": 1}, {"object_id": 2, "pipeline_id": "MT-02"})
    found = diagnostics(*risky(1), *risky(2))
    assert forecast.top_risks_on_trunkline(two, found, "MT-02", limit=1).count() == 0
    assert forecast.top_risks_on_trunkline(two, found, "MT-02", limit=2).count() == 1


def test_forecast_of_ids_the_table_does_not_know(objects, diagnostics):
    known = objects({"object_id": 1})
    orphan = forecast.forecast_of(known, diagnostics(*risky(7)), 7).first()
    assert orphan["status"] == "success" and orphan["object_name"] is None
    assert forecast.forecast_of(known, diagnostics(*risky(7)), 8).first()["status"] == "insufficient_data"
    zero = forecast.forecast_of(objects({"object_id": 0}), diagnostics(*risky(0)), 0).first()
    assert (zero["status"], zero["object_name"]) == ("success", "object 0")


def test_lines(pipelines, objects, diagnostics):
    two = objects({"object_id": 1}, {"object_id": 2}, {"object_id": 2}, {"object_id": 3, "pipeline_id": "MT-02"})
    rows = {r["pipeline_id"]: r for r in dicts(forecast.trunkline_forecast(
        pipelines("MT-01", "MT-02", "MT-03"), two, diagnostics(*risky(2), *risky(99)), "2024-03-01"))}
    first = rows["MT-01"]
    assert (first["status"], first["total_objects"], first["defect_rate"]) == ("success", 3, 0.33)
    assert first["critical_objects_count"] == 2  # both rows of object 2
    assert (first["defects_last_year"], first["predicted_defects_next_year"]) == (3, 3)
    assert first["recommendation"] == s.ADVICE_ATTENTION
    assert (rows["MT-02"]["status"], rows["MT-02"]["message"]) == ("error", s.MSG_NO_DIAGNOSTICS)
    assert (rows["MT-03"]["status"], rows["MT-03"]["message"]) == ("error", s.MSG_NO_OBJECTS)
    shown = forecast.forecast_dashboard_trunklines(pipelines("MT-01", "MT-03"), two, diagnostics(*risky(2)), "2024-03-01")
    assert [r["pipeline_id"] for r in dicts(shown)] == ["MT-01"]


def test_last_year_excludes_its_first_day(objects, diagnostics):
    found = diagnostics(*history(1, ("2023-03-02", 1.0), ("2023-03-03", 1.0), ("2024-03-01", 1.0)))
    row = forecast.defects_last_year(objects({"object_id": 1}), found, "2024-03-01").first()
    assert row["defects_last_year"] == 2


@pytest.mark.parametrize("share, critical, advice", [
    (0.5, 10, s.ADVICE_ATTENTION), (0.51, 0, s.ADVICE_REPAIR), (0.0, 11, s.ADVICE_REPAIR),
    (0.3, 5, s.ADVICE_REGULAR), (0.0, 6, s.ADVICE_ATTENTION), (0.15, 0, s.ADVICE_GOOD)])
def test_recommendation(spark, share, critical, advice):
    df = spark.createDataFrame([(share, critical)], "s double, c long")
    assert df.select(forecast.recommendation(F.col("s"), F.col("c"))).first()[0] == advice


def test_summary_of_empty_tables(objects, diagnostics):
    row = forecast.forecast_dashboard_summary(objects(), diagnostics()).first()
    assert tuple(row) == (0, 0, 0)


def test_days_and_last_depth(diagnostics):
    found = diagnostics(*history(1, ("2024-01-01", None), ("2024-01-10", 5.0), ("2024-02-09", 7.0)))
    assert {r["diag_id"]: r["days_since_first"] for r in dicts(forecast.days_since_first_defect(found))} == {2: 0, 3: 30}
    assert dicts(forecast.last_defect_depth(found)) == [{"object_id": 1, "current_depth": 7.0}]


def test_undated_defects_count_but_do_not_bend_the_line(objects, diagnostics):
    dated = history(1, ("2024-01-01", 10.0), ("2024-07-01", 12.0), ("2025-01-01", 14.0))
    alone = dicts(forecast.depth_trend(diagnostics(*dated)))
    for date in (None, "2024-13-45"):
        rows = diagnostics(*dated, {"object_id": 1, "date": date, "defect_found": True, "param1": 58.0})
        assert dicts(forecast.depth_trend(rows)) == [{**alone[0], "defect_count": 4}]
    two = diagnostics(*history(2, ("2024-01-01", None), ("2024-02-01", 9.0)), {"object_id": 2, "date": None, "defect_found": True, "param1": 50.0})
    assert forecast.depth_trend(two).count() == 0
    row = dicts(forecast.object_forecast(objects({"object_id": 2}), two))[0]
    assert (row["trend"], row["risk_probability"]) == ("unknown", 0.3)
