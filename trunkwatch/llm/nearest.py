"""Nearest neighbours by inner product: stable projections, a kd-tree and a chi-square stopping test.

A vector of a band of norms is scaled by the band's largest norm and given one
more component, which makes it a unit vector; so is a query, with zero there. The
inner product is then largest where the distance is least. All are projected to a
few dimensions by independent normal numbers. As the normal law is 2-stable, the
squared projected distance of a pair at distance d is d^2 times a chi-square
variable with as many degrees of freedom as there are dimensions.

A kd-tree over the projections gives a query's neighbours there, the next leaf at
a time, and these are verified by their true inner products. Let d be the distance
of the k-th best so far and r the projected distance of all that is not yet seen.
A better one among these has a projection shorter than r with a probability of
at least the chi-square law at (r / d)^2; once this reaches ``CONFIDENCE``, the
search stops. A true neighbour is missed with a probability of at most the rest.

The tree's top, fitted on a sample, cuts the rows into cells; tasks build the
tree below over a cell, or over a share of one that is too large. A query first
goes to one unit, whose k-th best then rules out all cells the test excludes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trunkwatch.llm.common import stored, table, tidied
from trunkwatch.llm.vectors import matrix, of_length, usual_length, vector_column
from trunkwatch.sources.tables import named

NEIGHBOURS = 20
#: Dimensions of the projection; even, for the closed form of the chi-square law.
DIMS = 6
#: Least probability with which each true neighbour is found.
CONFIDENCE = 0.93
#: Rows that a task indexes at once, rows of a leaf, queries that share a search.
UNIT_ROWS, LEAF, QUERIES = 16_384, 128, 2048
#: Queries of one unit that one task searches; more go to copies of the unit.
QUERY_ROWS = 1 << 16
#: Cells at most, and rows of the sample for each of them.
MOST_CELLS, SAMPLED = 16_384, 16
_SEED = 20


def chi_square(x: float, dims: int) -> float:
    """The chi-square law with an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio(confidence: float, dims: int) -> float:
    """The squared ratio (r / d)^2 at which the chi-square law reaches ``confidence``."""
    low, high = 0.0, 1.0
    while chi_square(high, dims) < confidence:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < confidence else (low, middle)
    return high


def norms(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, initial=0)
    scale = np.where(largest > 0, largest, 1)
    return np.sqrt(((vectors / scale[:, None]) ** 2).sum(axis=1)) * scale


def band_of(norm: np.ndarray) -> np.ndarray:
    """Bands reach from half an octave below a power of two to half an octave above."""
    return np.floor(np.log2(norm) + 0.5).astype(np.int64)


def _box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    found = np.zeros((len(points), len(low)))
    for at in range(points.shape[1]):
        p = points[:, at, None]
        apart = np.maximum(np.maximum(low[None, :, at] - p, p - high[None, :, at]), 0)
        found += apart * apart
    return found


def kd_leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves, split at the median of the widest dimension."""
    leaves, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= most:
            leaves.append(rows)
            continue
        own = points[rows]
        values = own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))]
        order = np.argpartition(values, len(rows) // 2)
        stack += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return leaves


@dataclass
class Cells:
    """The projection and the tops of the trees, one tree for each band."""
    length: int
    dims: int
    bands: dict[int, float]  # largest norm
    splits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)  # by level: dimension, value
    first: dict[int, int] = field(default_factory=dict)  # number of a band's first cell
    largest: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by cell, as all below
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __post_init__(self):
        self.normal = np.random.default_rng(_SEED).standard_normal((self.length + 1, self.dims))

    def project(self, vectors: np.ndarray, norm: np.ndarray, largest: np.ndarray) -> np.ndarray:
        added = np.sqrt(np.maximum(1 - (norm / largest) ** 2, 0))
        return (vectors / largest[:, None]) @ self.normal[:-1] + added[:, None] * self.normal[-1]

    def project_queries(self, vectors: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (vectors / norm[:, None]) @ self.normal[:-1]

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the projection of every vector."""
        norm = norms(vectors)
        band = band_of(norm)
        points = self.project(vectors, norm, np.array([self.bands[b] for b in band.tolist()]))
        cell = np.zeros(len(vectors), np.int64)
        for b in np.unique(band).tolist():
            own = np.flatnonzero(band == b)
            node = np.zeros(len(own), np.int64)
            for dimension, value in self.splits[b]:
                node = 2 * node + (points[own, dimension[node]] > value[node])
            cell[own] = self.first[b] + node
        return cell, points

    def fit(self, sample: dict[int, np.ndarray], rows: dict[int, int], unit_rows: int, most: int) -> None:
        """Splits at medians of the sample, as deep as its rows and the numbers of rows ask for."""
        total, first = sum(rows.values()), 0
        for b in sorted(self.bands):
            points = sample.get(b, np.zeros((0, self.dims)))
            wanted = min(rows[b] / unit_rows, len(points) / 8, most * rows[b] / total)
            groups, levels = [points], []
            while len(groups) < wanted:
                dimension = np.array([int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0 for g in groups])
                value = np.array([np.median(g[:, d]) if len(g) else 0.0 for g, d in zip(groups, dimension)])
                levels.append((dimension, value))
                groups = [g[side] for g, d, v in zip(groups, dimension, value) for side in (g[:, d] <= v, g[:, d] > v)]
            self.splits[b], self.first[b] = levels, first
            first += len(groups)
        self.largest = np.concatenate([np.full(1 << len(self.splits[b]), self.bands[b]) for b in sorted(self.bands)])


class Unit:
    """A kd-tree over the projections of one unit's distinct vectors."""

    def __init__(self, cells: Cells, cell: int, ids: np.ndarray, vectors: np.ndarray, k: int, ratio: float, leaf: int = LEAF):
        self._k, self._ratio, self._largest, self._cells = k, ratio, cells.largest[cell], cells
        whole = np.ascontiguousarray(vectors)
        _, first, of = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(),
                                 return_index=True, return_inverse=True)
        self.vectors = whole[first]
        # of copies the smallest ids can be among the nearest, one more than asked for as one may be the query
        order = np.lexsort((ids, of))
        of, ids = of[order], ids[order]
        fresh = (np.diff(of, prepend=-1) != 0) | (np.diff(ids, prepend=0) != 0)
        of, ids = of[fresh], ids[fresh]
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        rank = np.arange(len(of)) - np.repeat(starts, np.diff(starts, append=len(of)))
        self.ids, counts = ids[rank <= k], np.bincount(of[rank <= k], minlength=len(first))
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self._least_id = self.ids[self.starts[:-1]]
        norm = norms(self.vectors)
        points = cells.project(self.vectors, norm, np.full(len(norm), self._largest))
        self._leaves = kd_leaves(points, leaf)
        self._low = np.array([points[rows].min(axis=0) for rows in self._leaves])
        self._high = np.array([points[rows].max(axis=0) for rows in self._leaves])
        self._in_leaf = [(rows, self.vectors[rows]) for rows in self._leaves]
        self.verified = 0

    def search(self, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and vector numbers (-1: none) of the ``k + 1`` best, for queries whose k-th best
        elsewhere has the inner product ``bound`` with the unit vector."""
        n, width = len(queries), self._k + 1
        norm = norms(queries)
        unit = queries / norm[:, None]
        away = _box_distances(self._cells.project_queries(queries, norm), self._low, self._high)
        order = np.argsort(away, axis=1)
        away = np.take_along_axis(away, order, axis=1)
        best, found = np.full((n, width), -np.inf), np.full((n, width), -1)
        bound, active = bound.copy(), np.arange(n)
        margin = 1e-12 * len(queries[0]) * self._largest
        for step in range(order.shape[1]):
            # the test: what is not yet seen is at least this far in the projection
            nearest = np.maximum(2 - 2 * bound[active] / self._largest, 0)
            active = active[away[active, step] < self._ratio * nearest]
            if not len(active):
                break
            leaf = order[active, step]
            by_leaf = np.argsort(leaf, kind="stable")
            for own in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                rows, vectors = self._in_leaf[order[own[0], step]]
                self.verified += len(own) * len(rows)
                near = unit[own] @ vectors.T >= (bound[own] - margin)[:, None]
                hit = np.flatnonzero(near.any(axis=1))
                if not len(hit):
                    continue
                of, at = np.nonzero(near[hit])
                score = np.full((len(hit), len(rows)), -np.inf)
                # in a fixed order of terms, so that equal vectors score equally in all units
                score[of, at] = (queries[own[hit][of]] * vectors[at]).sum(axis=1)
                q = own[hit]
                scores = np.concatenate([best[q], score], axis=1)
                numbers = np.concatenate([found[q], np.broadcast_to(rows, score.shape)], axis=1)
                ids = np.where(numbers >= 0, self._least_id[numbers], np.iinfo(np.int64).max)
                top = np.lexsort((ids, -scores), axis=1)[:, :width]
                best[q], found[q] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(numbers, top, axis=1)
                # the last but one, as the query itself may be among them
                bound[q] = np.maximum(bound[q], best[q, -1] / norm[q])
        found[best == -np.inf] = -1
        return best, found

    def answers(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, vec_id, score) of the k best for each row, without the query's own row."""
        whole = np.ascontiguousarray(queries)
        _, first, of = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(),
                                 return_index=True, return_inverse=True)
        least = np.full(len(first), np.inf)
        np.minimum.at(least, of, bound)
        best, found = self.search(whole[first], least)
        # from distinct queries to rows, from distinct vectors to their ids
        row, slot = np.nonzero(found[of] >= 0)
        number, score = found[of[row], slot], best[of[row], slot]
        copies = self.starts[number + 1] - self.starts[number]
        ends = np.cumsum(copies)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - copies, copies) + np.repeat(self.starts[number], copies)
        row, score, number, vec_id = np.repeat(row, copies), np.repeat(score, copies), np.repeat(number, copies), self.ids[at]
        own = np.flatnonzero(vec_id == ids[row])
        own = own[(self.vectors[number[own]] == whole[row[own]]).all(axis=1)]
        keep = np.ones(len(row), bool)
        keep[own] = False
        row, score, vec_id = row[keep], score[keep], vec_id[keep]
        order = np.lexsort((vec_id, -score, row))
        row, score, vec_id = row[order], score[order], vec_id[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        top = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row))) < self._k
        return row[top], vec_id[top], score[top]


def _vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return vectors.where(named(vec_id).isNotNull()).select(named(vec_id).cast("long").alias("id"), vector_column(vector))


def _nonzero(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    rows, found = of_length(batch.column(1), length)
    some = (found != 0).any(axis=1)
    return rows[some], found[some]


def _lists(rows: np.ndarray) -> pa.Array:
    bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(bounds, pa.array(rows.ravel()))


def fitted(rows: DataFrame, length: int, dims: int = DIMS, unit_rows: int = UNIT_ROWS, most: int = MOST_CELLS,
           sampled: int = SAMPLED) -> Cells:
    """The cells of ``id, vector`` rows, with the number of rows and the box of each."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = norms(_nonzero(batch, length)[1])
            yield pa.RecordBatch.from_arrays([pa.array(band_of(norm)), pa.array(norm)], names=["band", "norm"])

    bands = (rows.mapInArrow(measured, "band long, norm double").groupBy("band")
             .agg(F.max("norm").alias("largest"), F.count("*").alias("n")).collect())  # a row per octave
    cells = Cells(length, dims, {r["band"]: r["largest"] for r in bands})
    if not bands:
        return cells
    counts = {r["band"]: r["n"] for r in bands}
    total = sum(counts.values())
    wanted = sampled * min(most, sum(-(-n // unit_rows) * 2 for n in counts.values()))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found = _nonzero(batch, length)
            norm = norms(found)
            band = band_of(norm)
            points = cells.project(found, norm, np.array([cells.bands[b] for b in band.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(band), _lists(points)], names=["band", "p"])

    some = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(total)) < wanted
    sample: dict[int, list] = {}
    for r in rows.where(some).mapInArrow(projected, "band long, p array<double>").collect():  # about ``wanted`` rows
        sample.setdefault(r["band"], []).append(r["p"])
    cells.fit({b: np.array(sorted(p)) for b, p in sample.items()}, counts, unit_rows, most)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(cells.largest), np.int64)
        low, high = np.full((len(n), dims), np.inf), np.full((len(n), dims), -np.inf)
        for batch in batches:
            cell, points = cells.place(_nonzero(batch, length)[1])
            n += np.bincount(cell, minlength=len(n))
            np.minimum.at(low, cell, points)
            np.maximum.at(high, cell, points)
        cell, at = np.nonzero(np.broadcast_to(n[:, None] > 0, low.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, at, n[cell], low[cell, at], high[cell, at])],
                                         names=["cell", "at", "n", "low", "high"])

    sides = (rows.mapInArrow(boxes, "cell long, at long, n long, low double, high double").groupBy("cell", "at")
             .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))
    cells.rows = np.zeros(len(cells.largest), np.int64)
    cells.low, cells.high = (np.full((len(cells.largest), dims), v) for v in (np.inf, -np.inf))
    for r in sides.collect():  # ``dims`` rows per cell
        cells.rows[r["cell"]], cells.low[r["cell"], r["at"]], cells.high[r["cell"], r["at"]] = r["n"], r["low"], r["high"]
    return cells


_WORK = "cell long, share long, copy long, kind long, id long, bound double, vector array<double>"


def _work(cell, share, copy, kind, ids, bound, vectors) -> pa.RecordBatch:
    n = len(ids)
    columns = [np.broadcast_to(np.asarray(x, np.int64), n) for x in (cell, share, copy, kind)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids), pa.array(np.broadcast_to(np.asarray(bound, float), n)),
                                       _lists(vectors)], names=["cell", "share", "copy", "kind", "id", "bound", "vector"])


def _routed(queries: DataFrame, cells: Cells, shares: np.ndarray, ratio: float, everywhere: bool) -> DataFrame:
    """``queries`` as work for the units they go to: one each, or all that the test leaves."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.flatnonzero(cells.rows)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids, vectors = part.column(0).to_numpy(), matrix(part.column(1))
                bound = part.column(2).to_numpy(zero_copy_only=False)
                away = _box_distances(cells.project_queries(vectors, norms(vectors)), cells.low[there], cells.high[there])
                if everywhere:
                    nearest = np.maximum(2 - 2 * bound[:, None] / cells.largest[there], 0)
                    row, at = np.nonzero(away < ratio * nearest)
                    copies = shares[there[at]]
                    row, at = np.repeat(row, copies), np.repeat(at, copies)
                    share = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                else:
                    # the cell that promises the largest inner product
                    row, share = np.arange(len(ids)), 0
                    at = np.argmax(cells.largest[there] * (1 - away / (2 * cells.dims)), axis=1)
                for b in range(0, len(row), 4096):
                    s = slice(b, b + 4096)
                    yield _work(there[at[s]], share if np.isscalar(share) else share[s], 0, 1, ids[row[s]], bound[row[s]], vectors[row[s]])

    return queries.select("id", "vector", "bound").mapInArrow(tidied(route), _WORK)


def _dealt(rows: DataFrame, cells: Cells, length: int, shares: np.ndarray) -> DataFrame:
    """All rows as work: their cell, and by turns one of its shares."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # goes by the place of a row in its task's input, which is the same when the task is run again
        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            kept, found = _nonzero(batch, length)
            cell = cells.place(found)[0]
            share = (turn + np.arange(len(kept))) % shares[cell]
            turn += len(kept)
            yield _work(cell, share, 0, 0, batch.column(0).to_numpy()[kept], 0.0, found)

    return rows.mapInArrow(tidied(deal), _WORK)


def _answered(index: DataFrame, work: DataFrame, cells: Cells, k: int, ratio: float, leaf: int, query_rows: int) -> DataFrame:
    """``query_id, of, vec_id, score``: the best of every unit for each query sent to it."""
    # many queries of one unit go to copies of it
    asked = work.groupBy("cell", "share").agg(F.ceil(F.count("*") / query_rows).cast("long").alias("copies"))
    asked = stored(asked, "asked-units")
    sent = work.join(asked, ["cell", "share"]).withColumn("copy", F.pmod(F.xxhash64("id", "vector"), F.col("copies")))
    held = index.join(asked, ["cell", "share"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    names = ["cell", "share", "copy", "kind", "id", "bound", "vector"]
    unit = names[:3]
    together = held.select(names).unionByName(sent.select(names)).repartition(*unit).sortWithinPartitions(*names[:4])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, built = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]).any(axis=1)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if tuple(parts[a, :3]) != key:
                    key, ids, vectors, built = tuple(parts[a, :3]), [], [], None
                run = batch.slice(a, b - a)
                own, found = run.column(4).to_numpy(), matrix(run.column(6))
                if parts[a, 3] == 0:
                    ids.append(own)
                    vectors.append(found)
                    continue
                if built is None and ids:
                    built = Unit(cells, int(key[0]), np.concatenate(ids), np.concatenate(vectors), k, ratio, leaf)
                    ids, vectors = [], []
                bound = run.column(5).to_numpy(zero_copy_only=False)
                for s in range(0, len(own) if built else 0, QUERIES):
                    row, vec_id, score = built.answers(own[s:s + QUERIES], found[s:s + QUERIES], bound[s:s + QUERIES])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[s:s + QUERIES][row]), run.column(6).slice(s, QUERIES).take(pa.array(row)), pa.array(vec_id),
                         pa.array(score)], names=["query_id", "vector", "vec_id", "score"])

    found = together.mapInArrow(tidied(search), "query_id long, vector array<double>, vec_id long, score double")
    return found.select("query_id", F.xxhash64("vector").alias("of"), "vec_id", "score")


def _best(answers: DataFrame, k: int) -> DataFrame:
    """The k best of each query, nearest first, ties to smaller ids; a row found twice counts once."""
    order = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return (answers.repartition("query_id", "of").dropDuplicates(["query_id", "of", "vec_id", "score"])
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def nearest(vectors: DataFrame, asked, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
            dims: int = DIMS, confidence: float = CONFIDENCE, unit_rows: int = UNIT_ROWS, leaf: int = LEAF,
            query_rows: int = QUERY_ROWS, most: int = MOST_CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row with the condition ``asked``.

    ``asked`` is a condition on the column ``id``. Rows without an id take no
    part, nor vectors that are null, empty or zero, hold null or non-finite
    components, or have not the number of components that most have. Scores are
    inner products in double precision; ties go to smaller ids. Rows that repeat id
    and vector count once, as query and as candidate; rows that share an id only are
    different rows, and a query of such an id is answered for each. With fewer than
    ``k`` candidates all are returned. Tables without queries give no rows.
    """
    spark, length = vectors.sparkSession, usual_length(vectors, vector)
    rows, ratio = _vectors(vectors, vec_id, vector), stop_ratio(confidence, dims)
    cells = fitted(rows, length, dims, unit_rows, most)
    if not cells.bands:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shares = np.maximum(-(-cells.rows // unit_rows), 1)
    index = stored(_dealt(rows, cells, length, shares), "vector-index")
    # one row per id and vector, wherever its copies lie
    queries = stored(index.where(asked).select("id", "vector").distinct()
                     .withColumn("bound", F.lit(float("-inf"))), "vector-queries")

    def round_(work: DataFrame, name: str, units: DataFrame) -> DataFrame:
        return stored(_answered(units, stored(work, name), cells, k, ratio, leaf, query_rows), f"{name}-answers")

    first = round_(_routed(queries, cells, shares, ratio, False), "home-queries", index.where("share = 0"))
    kth = _best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), "of", "score")
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    bounded = (queries.drop("bound").withColumn("of", F.xxhash64("vector")).join(kth, ["id", "of"], "left")
               .select("id", "vector", F.coalesce(F.col("score") / size, F.lit(float("-inf"))).alias("bound")))
    second = round_(_routed(bounded, cells, shares, ratio, True), "other-queries", index)
    return _best(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every 20th id in ``embeddings``; see :func:`nearest` for odd inputs."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
