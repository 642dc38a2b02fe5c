"""Removal of long repeated byte strings by prefix doubling on sampled positions.

Which strings of ``LENGTH`` bytes start at more than one place? Doubling over all
positions would sort a row per byte and round. So positions are first sampled by
content: each window of LENGTH bytes takes the position in it whose GRAM bytes
have the least hash (the leftmost of equals) as its anchor. Equal windows have
their anchors at equal offsets, so only windows of equal anchors need comparing.
Names of 8, 16, 32, .. bytes come from pairs of names at growing offsets.

1. Consecutive windows of one anchor form a run. Runs are ranked by their
   anchors' GRAM bytes; those with a unique anchor are out.
2. They are ranked by all bytes of the run. Runs equal to another one are
   repeated as a whole; one of them stays as a witness.
3. The others and the witnesses go, with their bytes, to the task of their
   anchor, where windows are named up to LENGTH bytes and counted. Anchors with
   very many different runs are counted window by window in Spark instead, which
   splits them by name.

Names that decide a removal have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from trunkwatch.llm.common import stored, table, text_of
from trunkwatch.sources.tables import named

LENGTH = 200
GRAM = 32
#: Windows that are looked at together; longer texts go in pieces.
_PIECE = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
#: Different runs of an anchor that one task compares; more are counted by Spark.
GROUP = 2048
#: Windows whose names one task sorts at once, beside the last group.
_CHUNK = 1 << 21

_ODD = [(np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)),
        (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB))]


def _pair(x: np.ndarray, y: np.ndarray, lane: int) -> np.ndarray:
    """Names of pairs of names."""
    a, b = _ODD[lane]
    z = x ^ (x >> np.uint64(31))
    z *= a
    z ^= z >> np.uint64(29)
    z += y
    z *= b
    z ^= z >> np.uint64(32)
    z *= a
    z ^= z >> np.uint64(28)
    return z


def names(data: bytes, length: int, lane: int) -> np.ndarray:
    """A name for the ``length`` (8 at least) bytes from each position, by doubling."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    now, size = np.ndarray(len(data) - 7, "<u8", data, 0, (1,)), 8
    now = _pair(now, np.full(1, size, np.uint64), lane)
    while size < length:
        step = min(size, length - size)
        now = _pair(now[:-step], now[step:], lane)
        size += step
    return now


def runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor) of the runs of a text."""
    found = [[], [], []]
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        piece = data[at:at + _PIECE + length - 1]
        key = names(piece, gram, 0)
        key = (key & ~_LOW) | np.arange(len(key), dtype=np.uint64)
        n, span, size = len(piece) - length + 1, length - gram + 1, 1
        while 2 * size <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        least = np.minimum(key[:n], key[span - size:span - size + n])
        anchor = (least & _LOW).astype(np.int64)
        new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        first = np.concatenate([[0], new])
        found[0].append(at + first)
        found[1].append(at + np.concatenate([new, [n]]) - 1)
        found[2].append(at + anchor[first])
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *part]) for part in found)


_RUN = "gram long, u1 long, u2 long, doc_id long, mark long, first long, more int"


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _runs(length: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                first, last, anchor = runs(data, length, gram)
                for at in range(0, len(first), 1 << 16):
                    s, e, a = first[at:at + (1 << 16)], last[at:at + (1 << 16)], anchor[at:at + (1 << 16)]
                    view = memoryview(data)
                    grams = [xxhash.xxh3_64_intdigest(view[x:x + gram]) for x in a.tolist()]
                    whole = [xxhash.xxh3_128_intdigest(view[x:y + length]) for x, y in zip(s.tolist(), e.tolist())]
                    n = len(s)
                    yield pa.RecordBatch.from_arrays(
                        [_signed(grams), _signed([w >> 64 for w in whole]), _signed([w & (1 << 64) - 1 for w in whole]),
                         pa.array([batch.column(0)[i].as_py()] * n, pa.int64()),
                         pa.array([batch.column(1)[i].as_py()] * n, pa.int64()),
                         pa.array(s), pa.array((e - s).astype(np.int32))],
                        names=["gram", "u1", "u2", "doc_id", "mark", "first", "more"])

    return find


def _cut(length: int):
    """Documents with the runs wanted of them to one row per run, with its bytes; of rows that repeat, a task cuts one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            for i in range(batch.num_rows):
                if repeats := batch.column(4)[i].as_py():
                    key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    if key in done:
                        continue
                    done.add(key)
                data = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                wanted = pa.RecordBatch.from_struct_array(batch.column(3).slice(i, 1).flatten())
                first, more = wanted.column("first"), wanted.column("more")
                parts = [data[f:f + m + length] for f, m in zip(first.to_pylist(), more.to_pylist())]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [wanted.column("gram"), wanted.column("known"), wanted.column("many"),
                     pa.array([batch.column(0)[i].as_py()] * n, pa.int64()),
                     pa.array([batch.column(1)[i].as_py()] * n, pa.int64()), first, pa.array(parts, pa.binary()),
                     pa.array([repeats] * n, pa.bool_())],
                    names=["gram", "known", "many", "doc_id", "mark", "first", "part", "repeats"])

    return cut


_PART = "gram long, known boolean, many boolean, doc_id long, mark long, first long, part binary, repeats boolean"


def _windows(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in it, name, second name) of every window of the parts."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    count = sizes - length + 1
    row = np.repeat(np.arange(len(parts)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at, data = offset + (np.cumsum(sizes) - sizes)[row], b"".join(parts)
    return row, offset, names(data, length, 0)[at], names(data, length, 1)[at]


def _spans(repeated: np.ndarray, row: np.ndarray, offset: np.ndarray, first: np.ndarray, length: int):
    """(row, start, end) of the bytes of neighbouring repeated windows."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row[at]) > 0)])
    start = at[new]
    end = np.concatenate([at[np.flatnonzero(new)[1:] - 1], at[-1:]])
    return row[start], first[row[start]] + offset[start], first[row[end]] + offset[end] + length


def _compare(length: int):
    """Parts sorted by anchor to the repeated spans of those not known yet."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(rows: pa.Table) -> pa.RecordBatch:
            parts = rows.column("part").to_pylist()
            known = rows.column("known").to_numpy()
            row, offset, x, y = _windows(parts, length)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            weight = np.add.reduceat(1 + known[row[order]].astype(np.int64), np.flatnonzero(new)) if len(x) else x
            repeated = np.empty(len(order), bool)
            repeated[order] = (weight > 1)[np.cumsum(new) - 1]
            of, s, e = _spans(repeated & ~known[row], row, offset, rows.column("first").to_numpy(), length)
            picked = rows.select(["doc_id", "mark"]).take(pa.array(of)).combine_chunks()
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(picked.column(0).chunks) if len(of) else pa.array([], pa.int64()),
                 pa.concat_arrays(picked.column(1).chunks) if len(of) else pa.array([], pa.int64()),
                 pa.array(s), pa.array(e)], names=["doc_id", "mark", "s", "e"])

        held, windows = [], 0
        for batch in batches:
            gram = batch.column(0).to_numpy()
            cuts = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            if held and gram[0] != held[-1].column(0)[-1].as_py():
                cuts = np.concatenate([[0], cuts])
            sizes = np.cumsum([len(p) - length + 1 for p in batch.column(6).to_pylist()])
            at = 0
            for c in cuts:
                if windows + sizes[c - 1] - (sizes[at - 1] if at else 0) >= _CHUNK if c else windows >= _CHUNK:
                    if c > at:
                        held.append(batch.slice(at, c - at))
                    yield spans(pa.Table.from_batches(held))
                    held, windows, at = [], 0, int(c)
            if at < batch.num_rows:
                held.append(batch.slice(at))
                windows += int(sizes[-1] - (sizes[at - 1] if at else 0))
        if held:
            yield spans(pa.Table.from_batches(held))

    return compare


def _named(length: int):
    """Parts to one row per window with its names."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(5).to_numpy()
            for at in range(0, batch.num_rows, 512):
                row, offset, x, y = _windows(batch.column(6).slice(at, 512).to_pylist(), length)
                row = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), batch.column(1).take(row),
                     batch.column(3).take(row), batch.column(4).take(row), pa.array(first[row.to_numpy()] + offset)],
                    names=["x", "y", "known", "doc_id", "mark", "s"])

    return name


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, mark, text``; the mark tells texts apart that share an id."""
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _on_document(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["mark"] == right["mark"])


def _parts(marked: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted runs with their bytes, each once, however many rows repeat."""
    by_doc = wanted.groupBy("doc_id", "mark").agg(F.collect_list("run").alias("runs"))
    again = marked.groupBy("doc_id", "mark").agg(F.count("*").alias("rows")).where("rows > 1")
    # written first: a row that repeats very often can then be split in the join
    by_doc = stored(by_doc.join(again, _on_document(by_doc, again), "left").select(
        by_doc["doc_id"], by_doc["mark"], "runs", F.col("rows").isNotNull().alias("repeats")), "repeat-wanted")
    joined = marked.join(by_doc, _on_document(marked, by_doc)).select(
        marked["doc_id"], marked["mark"], "text", "runs", "repeats")
    cut = stored(joined.mapInArrow(_cut(length), _PART), "repeat-cuts")
    once = cut.where("repeats").dropDuplicates(["gram", "doc_id", "mark", "first"])
    return cut.where("not repeats").unionByName(once).drop("repeats")


def repeated_spans(marked: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, mark, s, e``: byte spans covered by strings of ``length`` bytes that occur twice.

    Spans of a document may overlap, and come once for each of its rows; together
    they cover what is to be removed.
    """
    found = marked.mapInArrow(_runs(length, gram), _RUN)
    # written first: joined as they lie, aggregates by anchor would keep a hot one from being split
    anchors = stored(found.groupBy("gram").count().where("count > 1").select("gram"), "repeat-anchors")
    live = stored(found.join(anchors, "gram", "left_semi"), "repeat-runs")
    whole = live.groupBy("gram", "u1", "u2").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "first", "more")).alias("at"))
    whole = stored(whole, "repeat-blocks")
    equal = live.join(whole.where("n > 1").select("gram", "u1", "u2"), ["gram", "u1", "u2"], "left_semi").select(
        "doc_id", "mark", F.col("first").alias("s"), (F.col("first") + F.col("more") + length).alias("e"))
    # an anchor with different runs, of which one is not known to be repeated
    mixed = stored(whole.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where(
        "kinds > 1 and least = 1"), "repeat-mixed")
    wanted = whole.join(mixed, "gram").select(
        "at.doc_id", "at.mark", F.struct("gram", (F.col("n") > 1).alias("known"), (F.col("kinds") > group).alias("many"),
                                         "at.first", "at.more").alias("run"))
    parts = _parts(marked, wanted, length)
    few = parts.where("not many").repartition("gram").sortWithinPartitions("gram")
    compared = few.mapInArrow(_compare(length), "doc_id long, mark long, s long, e long")
    window = parts.where("many").mapInArrow(
        _named(length), "x long, y long, known boolean, doc_id long, mark long, s long")
    again = stored(window.groupBy("x", "y").agg(F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("n"))
                   .where("n > 1"), "repeat-windows")
    counted = window.where("not known").join(again, ["x", "y"], "left_semi").select(
        "doc_id", "mark", "s", (F.col("s") + length).alias("e"))
    return equal.unionByName(compared).unionByName(counted)


def spans_by_document(marked: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, mark, spans``: those of :func:`repeated_spans`, equal ones once."""
    return repeated_spans(marked, length, gram, group).groupBy("doc_id", "mark").agg(
        F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the spans cover."""
    found: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if found and s <= found[-1][1]:
            found[-1] = found[-1][0], max(e, found[-1][1])
        else:
            found.append((s, e))
    return found


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            data = batch.column(1)[i].as_py().encode("utf-8", "surrogatepass")
            spans = merged([(x["s"], x["e"]) for x in batch.column(2)[i].as_py() or ()])
            ends = [0, *[e for _, e in spans]]
            kept = b"".join(data[a:b] for a, b in zip(ends, [*[s for s, _ in spans], len(data)]))
            rows.append((len(data), spans, kept))
            if len(rows) == 512 or i + 1 == batch.num_rows:
                n, cut, rest = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i + 1 - len(rows), len(rows)), pa.array(n, pa.int64()),
                     pa.array([[{"s": s, "e": e} for s, e in c] for c in cut],
                              pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                     pa.array(rest, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
                rows = []


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row: what is removed, and the bytes that are left.

    Removed is each byte of the UTF-8 text that a string of ``length`` bytes
    covers which also starts anywhere else, in the same document too; matches do
    not cross documents and are judged on the input. A null text is empty; rows
    that repeat are copies of one another; a text shorter than ``length`` is left
    whole; an empty table gives no rows. Other columns are not read.
    """
    marked = _marked(docs, doc_id, text)
    spans = stored(spans_by_document(marked, length, gram, group), "repeat-spans")
    joined = marked.join(spans, _on_document(marked, spans), "left").select(marked["doc_id"], "text", "spans")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
