"""SimHash near-dedup with covering locality-sensitive hashing.

Every bit position gets a non-zero vector of ``radius + 1`` bits, and every such
vector v a mask of the positions whose vector has an odd product with v. The
vectors of any ``radius`` positions span a proper subspace, so some v is
orthogonal to all of them: its mask holds none of these positions. Hence two
fingerprints that differ in at most ``radius`` bits agree under at least one of
the ``2 ** (radius + 1) - 1`` masks, whatever the bits are.

Only distinct fingerprints are compared. A bucket yields the components of its
links, not its pairs; buckets beyond a size are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trunkwatch.llm.common import stored, table, tidied
from trunkwatch.llm.components import components
from trunkwatch.operators.listing import group_apart
from trunkwatch.sources.tables import named

SHINGLE_WORDS = 4
RADIUS = 4
BITS = 64
#: Fingerprints of a bucket that one task compares; larger buckets go block by block.
BLOCK = 16_384


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash over the XXH64 (seed 42) of word shingles, repeats included; 0 without words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[words - 1:].tolist())),
                         np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks as signed longs; vectors are dealt evenly over the positions."""
    vectors = 2 ** (radius + 1) - 1
    of = [1 + i % vectors for i in range(BITS)]
    found = []
    for v in range(1, vectors + 1):
        mask = sum(1 << i for i in range(BITS) if (of[i] & v).bit_count() % 2)
        found.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return found


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` for every row; the fingerprint as a signed long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    thin = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).cast("string").alias("t"))
    return thin.mapInArrow(tidied(add), "doc_id long, fp long")


def _links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Components of the links among distinct ``fps``: each node but a root, with its root.

    Walks from node to node over those not yet reached, so a cluster costs its
    size times the few steps it takes to reach all of it.
    """
    left, nodes, roots = np.sort(fps), [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left ^ front[0]) <= radius
            front = np.concatenate([front[1:], left[near]])
            nodes.append(left[near])
            roots.append(np.full(int(near.sum()), root))
            left = left[~near]
    empty = np.zeros(0, fps.dtype)
    return np.concatenate([empty, *nodes]), np.concatenate([empty, *roots])


def _bucket_edges(radius: int):
    """Rows (bucket, fp), sorted by bucket, to edges within each bucket."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(bucket: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero(np.any(bucket[1:] != bucket[:-1], axis=1)) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(fps)]])
            sizes, a, b = ends - starts, [], []
            pairs = starts[sizes == 2]
            x, y = fps[pairs], fps[pairs + 1]
            near = np.bitwise_count(x ^ y) <= radius
            a.append(x[near])
            b.append(y[near])
            for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
                node, root = _links(fps[s:e], radius)
                a.append(node)
                b.append(root)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)),
                                               pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

        held_b, held_f = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held_b = np.concatenate([held_b, np.stack(rows[:3], axis=1)])
            held_f = np.concatenate([held_f, rows[3].view(np.uint64)])
            same = np.all(held_b == held_b[-1], axis=1)
            whole = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if whole:
                yield found(held_b[:whole], held_f[:whole])
                held_b, held_f = held_b[whole:], held_f[whole:]
        if len(held_f):
            yield found(held_b, held_f)

    return edges


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                       for i, m in enumerate(masks(radius))])
    return fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` that connect exactly the distinct ``fp`` within ``radius`` bits of one another."""
    keyed = _keyed(fps, radius)
    sizes = keyed.groupBy("t", "k").count().where(F.col("count") > block)
    large = stored(sizes.select("t", "k", F.ceil(F.col("count") / block).cast("long").alias("blocks")), "buckets")
    one_task = keyed.join(large, ["t", "k"], "left_anti").select("t", "k", F.lit(0).cast("long").alias("p"), "fp")
    # each pair of blocks meets once; a fingerprint goes to as many pairs as there are blocks
    own: Column = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                       lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
    by_block = (keyed.join(large, ["t", "k"]).select("t", "k", "fp", F.explode(pair).alias("p"))
                .select("t", "k", "p", "fp"))
    dealt = one_task.unionByName(by_block).repartition("t", "k", "p").sortWithinPartitions("t", "k", "p")
    return dealt.mapInArrow(_bucket_edges(radius), "a long, b long").where("a <> b").distinct()


def _classes(marked: DataFrame, radius: int, block: int) -> DataFrame:
    """``fp, component_id, rep`` for every distinct fingerprint of ``doc_id, fp``."""
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(fps.select("fp"), radius, block))
    # written first, and its aggregate grouped apart, so that the join can split a very large component
    rooted = stored(fps.join(found, fps["fp"] == found["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp"))
    roots = group_apart(rooted, "root").agg(least.alias("m")).select(
        "root", F.col("m.first").alias("component_id"), F.col("m.fp").alias("rep"))
    return rooted.join(roots, "root").select("fp", "component_id", "rep")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
                           words: int = SHINGLE_WORDS, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    the component is the least id reachable (null where none there has an id).
    Texts without words, empty or null, have fingerprint zero. Rows that repeat
    count each; an empty table gives no rows; other columns are not read.
    """
    marked = stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    classes = _classes(marked, radius, block).select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
                         words: int = SHINGLE_WORDS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that represent their class, with all their columns.

    The document with the least id of a class stays; where no document of a
    class has an id, those of the least fingerprint. Rows that share an id (or
    have none) stay if one of them represents a class.
    """
    marked = stored(fingerprints(docs, doc_id, text, words), "fingerprints")
    kept = (marked.join(_classes(marked, radius, block), "fp")
            .where((F.col("fp") == F.col("rep")) & F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("_kept")).distinct())
    return docs.join(kept, named(doc_id).cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all ``documents``; see :func:`near_duplicate_classes` for odd inputs."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
