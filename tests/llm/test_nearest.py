import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trunkwatch.llm.nearest import Cells, Unit, chi_square, kd_leaves, nearest, op13_nearest, stop_ratio

KINDS = "vec_id long, embedding array<double>, label int, `id` string, `vector` int, `a``b` string, `bound` string"
#: So sure that nothing is missed.
SURE = 1 - 1e-13


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, 1, "x", 2, "x", "x") for r in rows], KINDS).repartition(parts)


def clusters(n, length=8, seed=3, start=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, length))
    return [(start + i, (centres[rng.integers(9)] + rng.normal(0, .3, length)).tolist()) for i in range(n)]


def odd_rows():
    rows = clusters(300)
    rows += [rows[20]] * 60 + [rows[7]] * 5                               # repeated rows, one of them a query
    rows += [(1000 + i, rows[40][1]) for i in range(90)]                    # copies of a query, queries among them
    rows += [(60, rows[61][1]), (3, rows[80][1])]                           # ids with two vectors
    rows += [(2000 + i, [1e6 * x for x in rows[i][1]]) for i in range(12)]  # norms far apart
    rows += [(2100 + i, [1e-6 * x for x in rows[i][1]]) for i in range(12)]
    rows += [(None, rows[1][1]), (None, None), (400, None), (420, []), (440, [None] * 8), (460, [0.0] * 8),
             (480, [math.nan] * 8), (500, [1.0] * 7 + [math.inf]), (520, [1.0] * 4), (540, [-0.0] * 7 + [1.0])]
    return rows


def plain(rows, k=20, every=20):
    """All pairs, in double precision."""
    kept = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8
                   and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    matrix, ids = np.array([v for _, v in kept]), np.array([i for i, _ in kept])
    found = []
    for at in np.flatnonzero(ids % every == 0):
        scores = (matrix[at] * matrix).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)).tolist() if j != at][:k]
        found += [(int(ids[at]), rank, int(ids[j]), float(scores[j])) for rank, j in enumerate(order, 1)]
    return sorted(found)


@pytest.mark.parametrize("sizes", [{}, {"unit_rows": 40, "leaf": 8, "query_rows": 5}, {"unit_rows": 25, "leaf": 3, "most": 2},
                                   {"unit_rows": 30, "dims": 2}])
def test_surely_the_same_as_brute_force(spark, sizes):
    rows = odd_rows()
    found = nearest(frame(spark, rows), F.col("id") % 20 == 0, confidence=SURE, **sizes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got, exact = sorted(map(tuple, found.collect())), plain(rows)
    assert [r[:3] for r in got] == [r[:3] for r in exact]
    assert np.allclose([r[3] for r in got], [r[3] for r in exact], rtol=1e-13)


def test_recall(spark):
    """Far fewer than all vectors are verified, and few neighbours are lost."""
    rows = clusters(6000, length=8, seed=8)
    got = nearest(frame(spark, rows, 8), F.col("id") % 20 == 0, unit_rows=800, leaf=32).collect()
    exact = {(q, v) for q, _, v, _ in plain(rows)}
    assert len(got) == len(exact) and len({(r.query_id, r.vec_id) for r in got} & exact) / len(exact) >= 0.93


def test_the_test_stops_early():
    rows = clusters(5000, length=8, seed=2)
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = Cells(8, 6, {0: 1.0}, largest=np.array([1.0]))
    for confidence in (0.5, 0.93):
        unit = Unit(cells, 0, ids, vectors, 20, stop_ratio(confidence, 6), leaf=16)
        row, vec_id, _ = unit.answers(ids[:100], vectors[:100], np.full(100, -np.inf))
        scores = vectors[:100] @ vectors.T
        scores[np.arange(100), np.arange(100)] = -np.inf
        exact = {(q, v) for q in range(100) for v in np.argsort(-scores[q])[:20].tolist()}
        recall = len(exact & set(zip(row.tolist(), vec_id.tolist()))) / len(exact)
        assert recall >= confidence and unit.verified < 0.6 * 100 * len(ids)


def test_few_candidates_and_no_rows(spark):
    rows = [(0, [1.0] * 8), (20, [2.0] * 8), (1, [-1.0] * 8)]
    found = [tuple(r)[:3] for r in nearest(frame(spark, rows), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    for none in ([], [(1, [1.0] * 8), (2, [0.5] * 8)], [(0, [0.0] * 8), (20, None)], [(None, [1.0] * 8)], [(0, [1.0] * 8)]):
        empty = nearest(frame(spark, none), F.col("id") % 20 == 0)
        assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op13_nearest(spark, sf_dir).collect()
    matrix, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = matrix @ matrix[at]
        scores[at] = -np.inf
        exact = set(ids[np.argsort(-scores)[:20]].tolist())
        hits += len(exact & {r.vec_id for r in got if r.query_id == ids[at]})
    assert len(got) == 20 * int((ids % 20 == 0).sum()) and hits >= 0.9 * len(got)


def test_chi_square():
    assert chi_square(3.0, 2) == pytest.approx(1 - math.exp(-1.5))
    assert chi_square(9.487729, 4) == pytest.approx(0.95, abs=1e-6)
    assert chi_square(12.591587, 6) == pytest.approx(0.95, abs=1e-6)
    assert stop_ratio(0.95, 6) == pytest.approx(12.591587, abs=1e-5)


def test_projected_distances_follow_the_law():
    rng = np.random.default_rng(1)
    cells = Cells(30, 6, {0: 2.0})
    ratios = []
    for seed in range(200):
        cells.normal = np.random.default_rng(seed).standard_normal((31, 6))
        x, q = rng.normal(0, .2, (5, 30)), rng.normal(0, 1, (5, 30))
        norm = np.linalg.norm(x, axis=1)
        apart = cells.project(x, norm, np.full(5, 2.0)) - cells.project_queries(q, np.linalg.norm(q, axis=1))
        true = 2 - 2 * (x * q).sum(axis=1) / np.linalg.norm(q, axis=1) / 2.0
        ratios += ((apart ** 2).sum(axis=1) / true).tolist()
    assert np.mean(ratios) == pytest.approx(6, rel=0.06)
    assert np.mean(np.array(ratios) <= stop_ratio(0.9, 6)) == pytest.approx(0.9, abs=0.03)


def test_leaves_hold_every_row_once():
    points = np.random.default_rng(0).normal(0, 1, (1000, 3))
    points[:600] = 1.0  # equal points split all the same
    leaves = kd_leaves(points, 17)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 17
