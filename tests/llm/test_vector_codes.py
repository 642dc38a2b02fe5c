import hashlib
import random

import duckdb
import numpy as np
import pytest

from trunkwatch.llm.vector_codes import (
    CellCache, Codebooks, compress, decoded, encoded, first_codebooks, quantised, refined, sql, train)

KINDS = "vec_id long, embedding array<float>, label int, `q` string, `codes` string, `a``b` string, `vector` int"


def vectors(n, length=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, .2, (7, length))
    return [(i, (centres[rng.integers(7)] + rng.normal(0, .05, length)).astype(np.float32).tolist(), i % 3 or None)
            for i in range(n)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], KINDS).repartition(parts)


def plain(rows, parts=8, entries=16, rounds=6):
    """The contract row by row, in Python's integers."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    sizes = [len(r[1]) for r in rows if r[1]]
    usual = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    kept = [(i, [int(np.floor(4096 * np.float64(x))) for x in v], label) for i, v, label in kept if len(v) == usual]
    first = {}
    for i, q, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, q), q)
    cuts = np.cumsum([0] + [len(p) for p in np.array_split(np.arange(usual), parts)]).tolist()
    books = [[first[i][a:b] for i in sorted(first)[:entries]] for a, b in zip(cuts, cuts[1:])]

    def nearest(book, v):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), at) for at, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, q, _ in kept:
                v = q[cuts[p]:cuts[p + 1]]
                own[nearest(book, v)[1]].append(v)
            books[p] = [[sum(x) // len(m) for x in zip(*m)] if m else e for e, m in zip(book, own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found, by_label = [], {}
    for i, q, label in kept:
        best = [nearest(book, q[a:b]) for book, a, b in zip(books, cuts, cuts[1:])]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        by_label[label] = by_label.get(label, 0) + found[-1][2]
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in found), key=str)


def odd_rows():
    rows = vectors(150)
    rows += [rows[3]] * 40 + [rows[20]] * 3                        # repeated rows
    rows += [(1000 + i, rows[7][1], 2) for i in range(30)]           # copies with ids of their own
    rows += [(5, rows[60][1], 1), (2, rows[9][1], None)]             # an id with two vectors
    rows += [(None, rows[1][1], None), (None, None, 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [None] * 16, 1), (303, [float("nan")] * 16, 1),
             (304, [0.1] * 15 + [float("inf")], 1), (305, [0.5] * 8, 1), (306, [0.0] * 16, None), (-4, [-1.5] * 16, 0)]
    return rows


@pytest.mark.parametrize("cell,cached", [(256, 1 << 16), (64, 5), (100_000, 1)])
def test_same_as_brute_force(spark, cell, cached):
    rows = odd_rows()
    found = compress(frame(spark, rows), cell=cell, cached=cached)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_same_as_sql(spark):
    rows = odd_rows()
    db = duckdb.connect()
    db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    db.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(db.execute(sql()).fetchall(), key=str) == plain(rows)


def test_uneven_parts_few_ids_and_other_parameters(spark):
    rows = vectors(11, length=13)
    found = compress(frame(spark, rows), parts=5, entries=20, rounds=2)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, 5, 20, 2)
    assert {len(r.code) for r in found.collect()} == {10}


def test_nothing_to_encode(spark):
    for rows in ([], [(1, None, 1), (2, [], 2), (3, [float("nan")], 3)], [(None, [0.5] * 8, 1)]):
        found = compress(frame(spark, rows))
        assert found.columns[:2] == ["vec_id", "code"] and found.count() == 0


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        compress(frame(spark, [(1, [1e9] * 8, 1)])).collect()


def test_cells_of_one_hash(monkeypatch):
    """Cells are told apart by their place, whatever the hash."""
    monkeypatch.setattr(CellCache, "_hash", lambda self, keys: keys[:, 0] % 2)
    rng = np.random.default_rng(2)
    points, book = rng.integers(-3000, 3000, (3000, 4)), rng.integers(-3000, 3000, (16, 4))
    cache = CellCache(book, 700, 3)
    for block in np.split(points, 6):
        entry, least = cache.assign(block)
        all_ = ((block[:, None] - book[None]) ** 2).sum(-1)
        assert (entry == all_.argmin(1)).all() and (least == all_.min(1)).all()


def test_ties_go_to_the_lower_entry():
    book = np.array([[10, 0], [0, 0], [0, 0], [0, 10]])
    entry, least = CellCache(book, 3).assign(np.array([[5, 0], [5, 5], [0, 5], [0, 0], [-1, -1]]))
    assert entry.tolist() == [0, 0, 1, 1, 1] and least.tolist() == [25, 50, 25, 0, 2]


def test_a_cell_is_looked_up_once_and_prunes():
    rng = np.random.default_rng(4)
    book = rng.integers(-2000, 2000, (16, 8))
    points = np.repeat(rng.integers(-2000, 2000, (50, 8)), 40, axis=0)
    cache, calls = CellCache(book, 64), []
    first = cache._not_dominated
    cache._not_dominated = lambda keys: calls.append(len(keys)) or first(keys)
    for block in np.array_split(points, 9):
        cache.assign(block)
    assert sum(calls) <= 50 and cache.evaluated < 8 * cache.asked


def test_rounds_do_not_depend_on_partitions_and_bring_errors_down(spark):
    rows = vectors(400)
    a, b = (quantised(frame(spark, random.Random(n).sample(rows, len(rows)), n)) for n in (1, 7))
    books = first_codebooks(a)
    errors = []
    for _ in range(4):
        errors.append(encoded(a, books).agg({"error": "sum"}).first()[0])
        books = refined(a, books)
    assert errors[-1] < errors[0] and books.sha256() == train(b, rounds=4).sha256()


def test_decoded_vectors_are_near(spark):
    rows = vectors(120)
    points = quantised(frame(spark, rows))
    books = train(points)
    assert isinstance(books, Codebooks) and books.length == 16
    back = {r.vec_id: np.array(r.vector) for r in decoded(encoded(points, books), books).collect()}
    exact = {i: np.array(v) for i, v, _ in rows}
    errors = {r.vec_id: r.error for r in encoded(points, books).collect()}
    for i, v in exact.items():
        assert ((back[i] - v) ** 2).sum() <= (np.sqrt(errors[i]) / 4096 + 4 / 4096) ** 2
