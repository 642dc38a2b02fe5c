"""Vector code compression: nearest codebook entries through memoised grid cells.

Vectors become integers and are cut into parts, each with a codebook of its own.
To assign a part, its coarse grid cell is looked up in a cache by hash. The first
time a cell is met, each entry's least and greatest distance to the cell's box are
taken; an entry whose least distance exceeds another one's greatest is dominated
for every point of the box. The cell remembers the others, and only these are
evaluated, exactly, for the points in it.

All arithmetic is on integers, so results do not depend on the order of rows.
Codebooks are refined from sums and counts that tasks add up and Spark merges: a
round brings one number per component of the codebooks to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trunkwatch.llm.common import stored, table, tidied
from trunkwatch.llm.vectors import matrix, of_length, usual_length, vector_column
from trunkwatch.operators.listing import group_apart
from trunkwatch.sources.tables import named

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components beyond this would leave the range of exact sums; an error says so.
LARGEST = 1 << 16
#: Side of a cell. Any value gives the same result.
CELL = 256
#: Cells that the cache of a part holds before it starts anew. Decides no result.
CACHED = 1 << 16
#: Rows that are assigned at once.
_AT_ONCE = 4096


def _distances(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of every entry to every box."""
    least = np.zeros((len(low), len(book)), np.int64)
    greatest = np.zeros((len(low), len(book)), np.int64)
    for at in range(book.shape[1]):
        below, above = low[:, at, None] - book[None, :, at], book[None, :, at] - high[:, at, None]
        outside = np.maximum(np.maximum(below, above), 0)
        least += outside * outside
        far = np.maximum(np.abs(below), np.abs(above))
        greatest += far * far
    return least, greatest


class CellCache:
    """The entries of one codebook that can be nearest to some point of a cell, by cell."""

    def __init__(self, book: np.ndarray, cell: int = CELL, cached: int = CACHED):
        self.book, self._cell, self._cached = book, cell, cached
        rng = np.random.default_rng(book.shape[1])
        self._mix = rng.integers(1, 1 << 62, book.shape[1], dtype=np.int64) * 2 + 1
        self.evaluated = self.asked = 0
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.int64)
        self._keys = np.zeros((0, self.book.shape[1]), np.int64)
        self._near = np.zeros((0, len(self.book)), bool)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (keys * self._mix).sum(axis=1)
            return mixed ^ (mixed >> 29) * self._mix[0]

    def _not_dominated(self, keys: np.ndarray) -> np.ndarray:
        low = keys * self._cell
        least, greatest = _distances(low, low + self._cell - 1, self.book)
        return least <= greatest.min(axis=1, keepdims=True)

    def _candidates(self, points: np.ndarray) -> np.ndarray:
        """For every point the entries that its cell keeps."""
        keys = np.floor_divide(points, self._cell)
        hashes, first, of = np.unique(self._hash(keys), return_index=True, return_inverse=True)
        cells = keys[first]
        odd = np.flatnonzero((keys != cells[of]).any(axis=1))  # another cell of the same hash
        near = np.zeros((len(cells), len(self.book)), bool)
        at = np.searchsorted(self._hashes, hashes)
        known = at < len(self._hashes)
        known[known] = self._hashes[at[known]] == hashes[known]
        taken = known.copy()
        known[known] = (self._keys[at[known]] == cells[known]).all(axis=1)
        near[known] = self._near[at[known]]
        new = ~known
        if new.any():
            near[new] = self._not_dominated(cells[new])
            if len(self._hashes) + int(new.sum()) > self._cached:
                self._forget()
                at, taken = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
                new[:] = True
            add = new & ~taken
            self._hashes = np.insert(self._hashes, at[add], hashes[add])
            self._keys = np.insert(self._keys, at[add], cells[add], axis=0)
            self._near = np.insert(self._near, at[add], near[add], axis=0)
        found = near[of]
        if len(odd):
            found[odd] = self._not_dominated(keys[odd])
        return found

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lower of equally near ones, and its squared distance."""
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, entry = np.nonzero(self._candidates(points))
        apart = points[row] - self.book[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == least[row])
        nearest = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]
        self.evaluated += len(row)
        self.asked += len(points)
        return entry[nearest], least


@dataclass
class Codebooks:
    """One matrix of integer entries per part."""
    parts: list[np.ndarray]

    @property
    def length(self) -> int:
        return sum(book.shape[1] for book in self.parts)

    def slices(self) -> list[slice]:
        ends = np.cumsum([book.shape[1] for book in self.parts]).tolist()
        return [slice(a, b) for a, b in zip([0, *ends], ends)]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.parts for x in book.ravel().tolist())
                              .encode()).hexdigest()

    def decode(self, codes: np.ndarray, scale: int = SCALE) -> np.ndarray:
        """The vectors that rows of indices stand for: the middle of each component's step."""
        whole = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.parts)], axis=1)
        return (whole + 0.5) / scale


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
              scale: int = SCALE) -> DataFrame:
    """``vec_id, label, q``: the usable vectors as integers ``floor(scale * x)``, see :func:`compress`."""
    length = usual_length(vectors, vector)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = of_length(batch.column(2), length)
            if len(found) and np.abs(found).max() > LARGEST:
                raise ValueError(f"a vector has a component beyond {LARGEST}")
            whole = pa.array(np.floor(found * scale).astype(np.int32).ravel())
            bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * length)
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.ListArray.from_arrays(bounds, whole)],
                names=["vec_id", "label", "q"])

    thin = vectors.select(named(vec_id).cast("long").alias("vec_id"), named(label).alias("label"),
                          vector_column(vector))
    kinds = T.StructType([thin.schema["vec_id"], thin.schema["label"], T.StructField("q", T.ArrayType(T.IntegerType()))])
    return thin.mapInArrow(tidied(floors), kinds)


def first_codebooks(points: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; ``None`` without any. See :func:`compress`."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            bound = max(best) if len(best) >= entries else None
            kept = np.unique(ids)[:entries]
            for at in np.flatnonzero(np.isin(ids, kept)).tolist():
                if bound is None or ids[at] <= bound:
                    own = batch.column(1)[at].as_py()
                    best[int(ids[at])] = min(best.get(int(ids[at]), own), own)
            best = dict(sorted(best.items())[:entries])
        yield pa.RecordBatch.from_arrays([pa.array(best.keys(), pa.int64()), pa.array(best.values(), pa.list_(pa.int32()))],
                                         names=["vec_id", "q"])

    # every task sends its own smallest, one row per id
    offered = points.select("vec_id", "q").where("vec_id is not null").mapInArrow(smallest, "vec_id long, q array<int>")
    rows = offered.groupBy("vec_id").agg(F.min("q").alias("q")).orderBy("vec_id").limit(entries).collect()
    if not rows:
        return None
    start = np.array([r["q"] for r in rows], np.int64)
    return Codebooks([np.ascontiguousarray(p) for p in np.array_split(start, parts, axis=1)])


def _assigned(batch: pa.RecordBatch, at: int, books: Codebooks, caches: list[CellCache]):
    """Blocks of rows as (first row, points, indices by part, distances by part)."""
    points = matrix(batch.column(at)).astype(np.int64)
    for a in range(0, len(points), _AT_ONCE):
        block = points[a:a + _AT_ONCE]
        found = [cache.assign(np.ascontiguousarray(block[:, s])) for cache, s in zip(caches, books.slices())]
        yield a, block, [f[0] for f in found], [f[1] for f in found]


def refined(points: DataFrame, books: Codebooks, cell: int = CELL, cached: int = CACHED) -> Codebooks:
    """The codebooks after one round: each entry becomes the floor of the mean of its parts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = [CellCache(b, cell, cached) for b in books.parts]
        count = [np.zeros(len(b), np.int64) for b in books.parts]
        total = [np.zeros(b.shape, np.int64) for b in books.parts]
        for batch in batches:
            for _, block, codes, _ in _assigned(batch, 0, books, caches):
                for p, s in enumerate(books.slices()):
                    np.add.at(total[p], codes[p], block[:, s])
                    count[p] += np.bincount(codes[p], minlength=len(count[p]))
        part, entry, place, n, sum_ = [], [], [], [], []
        for p, t in enumerate(total):
            e, i = np.indices(t.shape).reshape(2, -1)
            part.append(np.full(e.shape, p))
            entry.append(e)
            place.append(i)
            n.append(count[p][e])
            sum_.append(t.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (part, entry, place, n, sum_)],
                                         names=["part", "entry", "place", "n", "total"])

    merged = (points.select("q").mapInArrow(tidied(sums), "part long, entry long, place long, n long, total long")
              .groupBy("part", "entry", "place")
              .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")))
    new = [b.copy() for b in books.parts]
    for part, entry, place, n, total in merged.collect():  # one row per component of the codebooks
        if n:
            new[part][entry, place] = int(total) // n
    return Codebooks(new)


def train(points: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, cell: int = CELL,
          cached: int = CACHED) -> Codebooks | None:
    books = first_codebooks(points, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(points, books, cell, cached)
    return books


def encoded(points: DataFrame, books: Codebooks, cell: int = CELL, cached: int = CACHED) -> DataFrame:
    """``vec_id, label, codes, error``: an index per part, one byte each, and the squared distance."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = [CellCache(b, cell, cached) for b in books.parts]
        for batch in batches:
            for a, block, codes, distances in _assigned(batch, 2, books, caches):
                raw = np.stack(codes, axis=1).astype(np.uint8).tobytes()
                n = len(books.parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(block)), batch.column(1).slice(a, len(block)),
                     pa.array([raw[i:i + n] for i in range(0, len(raw), n)], pa.binary()),
                     pa.array(np.sum(distances, axis=0, dtype=np.int64))], names=["vec_id", "label", "codes", "error"])

    kinds = T.StructType([points.schema["vec_id"], points.schema["label"], T.StructField("codes", T.BinaryType()),
                          T.StructField("error", T.LongType())])
    return points.mapInArrow(tidied(assign), kinds)


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector``: the vectors that the ``codes`` of :func:`encoded` stand for."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            found = books.decode(raw, scale) if len(raw) else np.zeros((0, books.length))
            bounds = pa.array(np.arange(len(found) + 1, dtype=np.int32) * books.length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(found.ravel()))],
                                             names=["vec_id", "vector"])

    return codes.select("vec_id", "codes").mapInArrow(vectors, "vec_id long, vector array<double>")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, cell: int = CELL,
             cached: int = CACHED) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable vector.

    Vectors that are null or empty or hold null or non-finite components are
    dropped, and so are those that have not the number of components that most
    have. A length that the parts do not divide makes the first parts one longer.
    A component beyond 65,536 raises an error. Codebooks start from the smallest
    ids: of rows with the same id from the smallest vector, and never from rows
    without an id; with fewer ids they have fewer entries. Rows that repeat are
    encoded each and count each. Without any vector, or any id, there are no rows.
    """
    points = stored(quantised(vectors, vec_id, vector, label, scale), "vector-parts")
    books = train(points, parts, entries, rounds, cell, cached)
    if books is None:
        return points.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = stored(encoded(points, books, cell, cached), "vector-codes")
    # errors are summed map-side; a label with very many rows can be split in the join
    sums = group_apart(rows, "label").agg(F.sum("error").alias("label_error")).drop("shard").withColumnRenamed("label", "of")
    joined = rows.join(sums, rows["label"].eqNullSafe(sums["of"]))
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                         F.lit(books.sha256()).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors of ``embeddings`` in eight indices; see :func:`compress` for odd inputs."""
    return compress(table(spark, sf_dir, "embeddings"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB SQL, comparing every part with every entry."""
    assigned = """SELECT rid, part, v, min({'d': d, 'e': entry}) AS best FROM (
        SELECT pieces.rid, pieces.part, v, entry, CAST(list_sum(list_transform(range(1, len(v) + 1),
            lambda i: (v[i] - book[i]) * (v[i] - book[i]))) AS BIGINT) AS d
        FROM pieces JOIN books%d USING (part)) GROUP BY rid, part, v"""
    books = """, means%d AS MATERIALIZED (
        SELECT part, entry, list((total - ((total %% n + n) %% n)) // n ORDER BY place) AS book FROM (
            SELECT part, best.e AS entry, place, sum(v[place]) AS total, count(*) AS n
            FROM (""" + assigned + """), unnest(range(1, len(v) + 1)) AS u(place) GROUP BY ALL)
        GROUP BY part, entry),
    books%d AS MATERIALIZED (
        SELECT part, entry, CAST(coalesce(new.book, old.book) AS BIGINT[]) AS book
        FROM books%d old LEFT JOIN means%d new USING (part, entry))"""
    steps = "".join(books % (r, r, r + 1, r, r) for r in range(rounds))
    return f"""WITH usual AS (
        SELECT len(embedding) AS n FROM embeddings WHERE len(embedding) > 0 GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1),
    points AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, label,
            list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
        FROM embeddings JOIN usual ON len(embedding) = n
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pieces AS MATERIALIZED (
        SELECT rid, part, q[part * w + least(part, more) + 1 : (part + 1) * w + least(part + 1, more)] AS v
        FROM (SELECT rid, q, len(q) // {parts} AS w, len(q) % {parts} AS more FROM points),
            unnest(range({parts})) AS u(part)),
    starts AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, rid FROM (
            SELECT vec_id, arg_min(rid, q) AS rid FROM points WHERE vec_id IS NOT NULL
            GROUP BY vec_id ORDER BY vec_id LIMIT {entries})),
    books0 AS MATERIALIZED (SELECT part, entry, v AS book FROM starts JOIN pieces USING (rid)){steps},
    found AS MATERIALIZED (
        SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code,
            CAST(sum(best.d) AS BIGINT) AS error
        FROM ({assigned % rounds}) GROUP BY rid)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(book, ','), ',' ORDER BY part, entry)) FROM books{rounds})
            AS codebooks_sha256
    FROM points JOIN found USING (rid)"""


OP11_SQL = sql()
