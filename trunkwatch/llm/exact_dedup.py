"""Exact dedup: Grace hash deduplication with tables that compare complete content.

1. Every task folds its rows into open-addressing tables of bounded size, so one
   row per content and task goes on, however many copies there are.
2. Those rows are partitioned by a hash of their content. Each bucket streams
   through an open-addressing table. A content that finds no room is passed on
   as a spilled record, with all of its later copies.
3. Spilled records are written to the shared folder and partitioned again by
   another hash, until none is left.

Tables compare whole contents; the hash only says where to look.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trunkwatch.llm.common import partitions, stored, table, tidied
from trunkwatch.sources.tables import named

#: Bytes of content that a table holds. Any value gives the same result.
TABLE_BYTES = 16 << 20
#: What an entry counts beside its content.
_ENTRY_BYTES = 400

_RUNS = re.compile(rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")


def normalised(text: str | None) -> bytes:
    """The text with each run of ASCII white space as one space, in UTF-8; null is empty."""
    return _RUNS.sub(b" ", (text or "").encode("utf-8", "surrogatepass"))


class ContentTable:
    """Open addressing with linear probing; the slots hold entry numbers."""

    def __init__(self, limit: int):
        self._limit = limit
        self.contents: list[bytes] = []
        self._hashes: list[int] = []
        self._slots = np.full(1024, -1, np.int64)
        self._used = 0

    def _probe(self, hashed: int) -> Iterator[int]:
        mask = len(self._slots) - 1
        at = hashed & mask
        while True:
            yield at
            at = (at + 1) & mask

    def find(self, hashed: int, content: bytes) -> int:
        """The entry with this content, or -1."""
        for at in self._probe(hashed):
            entry = self._slots[at]
            if entry < 0 or (self._hashes[entry] == hashed and self.contents[entry] == content):
                return int(entry)

    def full(self, content: bytes) -> bool:
        """Whether ``content`` finds no room; an empty table has room for any."""
        return bool(self.contents) and self._used + len(content) + _ENTRY_BYTES > self._limit

    def insert(self, hashed: int, content: bytes) -> int:
        if 2 * (len(self.contents) + 1) > len(self._slots):
            self._slots = np.full(2 * len(self._slots), -1, np.int64)
            for entry, known in enumerate(self._hashes):
                self._place(known, entry)
        entry = len(self.contents)
        self.contents.append(content)
        self._hashes.append(hashed)
        self._place(hashed, entry)
        self._used += len(content) + _ENTRY_BYTES
        return entry

    def _place(self, hashed: int, entry: int) -> None:
        for at in self._probe(hashed):
            if self._slots[at] < 0:
                self._slots[at] = entry
                return


def _digest(content: bytes) -> tuple[bytes, int]:
    digest = hashlib.sha256(content).digest()
    return digest, int.from_bytes(digest[:8], "little")


def _before(a: int | None, b: int | None) -> bool:
    """Whether id ``a`` comes before ``b``; a missing id comes last."""
    return a is not None and (b is None or a < b)


class _Groups:
    """A content table with, for each entry, the row that stays and the number of rows."""

    def __init__(self, limit: int):
        self.table = ContentTable(limit)
        self.digests: list[bytes] = []
        self.ids: list[int | None] = []
        self.homes: list[int] = []
        self.counts: list[int] = []
        self.rows: list[tuple] = []

    def add(self, entry: int, content: bytes, digest: bytes, hashed: int, doc_id: int | None, home: int,
            count: int, row: tuple) -> int:
        if entry < 0:
            entry = self.table.insert(hashed, content)
            self.digests.append(digest)
            self.ids.append(doc_id)
            self.homes.append(home)
            self.counts.append(count)
            self.rows.append(row)
            return entry
        self.counts[entry] += count
        if _before(doc_id, self.ids[entry]):
            self.ids[entry], self.homes[entry], self.rows[entry] = doc_id, home, row
        return entry


def _schema(rest: T.DataType | None) -> T.StructType:
    """``home`` numbers a group of rows that one task found equal. ``kind``: 0 a row, 1 a group.

    ``lead`` of a row: no earlier row of its home had its id or a smaller one;
    of a resolved group: its home has the row that stays. ``same``: the content is
    the text, which is then not held twice.
    """
    fields = [T.StructField("kind", T.IntegerType()), T.StructField("doc_id", T.LongType()),
              T.StructField("home", T.LongType()), T.StructField("to_home", T.LongType()),
              T.StructField("lead", T.BooleanType()), T.StructField("n", T.LongType()),
              T.StructField("digest", T.BinaryType()), T.StructField("content", T.BinaryType()),
              T.StructField("text", T.StringType()), T.StructField("same", T.BooleanType())]
    return T.StructType(fields + ([T.StructField("rest", rest)] if rest else []))


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _fold(whole_rows: bool, schema: T.StructType, limit: int):
    """Rows (id, text[, rest]) to member rows and group rows, in bounded tables."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _arrow(schema)
        rest_of = (lambda batch, i: (batch.column(2)[i].as_py(),)) if whole_rows else (lambda batch, i: ())
        base, groups = TaskContext.get().partitionId() << 36, _Groups(limit)

        def flush() -> Iterator[pa.RecordBatch]:
            at = 0
            while at < len(groups.counts):
                out, held = [], 0
                while at < len(groups.counts) and held < 4 << 20:
                    content, row = groups.table.contents[at], groups.rows[at]
                    out.append((1, groups.ids[at], groups.homes[at], None, None, groups.counts[at],
                                groups.digests[at], content, *row))
                    held += len(content)
                    at += 1
                yield _batch(out, kind)

        for batch in batches:
            members, leads = [], {}
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                raw = (text or "").encode("utf-8", "surrogatepass")
                content = _RUNS.sub(b" ", raw)
                digest, hashed = _digest(content)
                entry = groups.table.find(hashed, content)
                if entry < 0 and groups.table.full(content):
                    yield from flush()
                    base += len(groups.counts)
                    groups = _Groups(limit)
                new = entry < 0 or _before(doc_id, groups.ids[entry])
                same = whole_rows and text is not None and content == raw
                row = (text if whole_rows and not same else None, same, *rest_of(batch, i)) if new else ()
                entry = groups.add(entry, content, digest, hashed, doc_id, 0, 1, row)
                groups.homes[entry] = base + entry
                if not whole_rows:
                    members.append((0, doc_id, base + entry, None, new, None, None, None, None, None))
            if members:
                yield _batch(members, kind)
        yield from flush()

    return fold


def _merge(whole_rows: bool, schema: T.StructType, limit: int):
    """Group rows of one bucket to resolved groups (kind 0), and spilled rows (kind 1)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _arrow(schema)
        groups, seen, entries = _Groups(limit), [], []
        for batch in batches:
            names = batch.schema.names
            spilled = []
            column = {n: batch.column(n).to_pylist() for n in ("doc_id", "home", "n", "digest", "content", "text", "same")}
            rest = batch.column(names.index("rest")) if whole_rows else None
            for i, content in enumerate(column["content"]):
                digest = column["digest"][i]
                hashed = int.from_bytes(digest[:8], "little")
                entry = groups.table.find(hashed, content)
                if entry < 0 and groups.table.full(content):
                    spilled.append(i)
                    continue
                doc_id, home = column["doc_id"][i], column["home"][i]
                new = entry < 0 or _before(doc_id, groups.ids[entry])
                row = (column["text"][i], column["same"][i], *((rest[i].as_py(),) if whole_rows else ())) if new else ()
                entry = groups.add(entry, content, digest, hashed, doc_id, home, column["n"][i], row)
                if not whole_rows:
                    seen.append(home)
                    entries.append(entry)
            if spilled:
                yield batch.take(pa.array(spilled)).select(kind.names).cast(kind)
        if whole_rows:
            def text_of(e: int) -> str | None:
                text, same = groups.rows[e][:2]
                return groups.table.contents[e].decode("utf-8", "surrogatepass") if same else text

            for at in range(0, len(groups.ids), 512):
                yield _batch([(0, groups.ids[e], groups.homes[e], groups.homes[e], True, groups.counts[e],
                               groups.digests[e], None, text_of(e), False, *groups.rows[e][2:])
                              for e in range(at, min(at + 512, len(groups.ids)))], kind)
        else:
            for at in range(0, len(seen), 8192):
                yield _batch([(0, groups.ids[e], home, groups.homes[e], home == groups.homes[e],
                               groups.counts[e], groups.digests[e], None, None, None)
                              for home, e in zip(seen[at:at + 8192], entries[at:at + 8192])], kind)

    return merge


def _resolve(folded: DataFrame, whole_rows: bool, limit: int, n_bytes: int | None = None) -> DataFrame:
    """Resolved groups from the group rows of all tasks, level by level.

    ``n_bytes`` is what they hold at most; without it they are read for their size first.
    """
    spark, schema = folded.sparkSession, folded.schema
    pending, done, level = folded.where("kind = 1"), None, 0
    while True:
        if level or n_bytes is None:
            n_bytes = pending.agg(F.coalesce(F.sum(F.length("content") + F.lit(_ENTRY_BYTES)), F.lit(0))).first()[0]
        if level and not n_bytes:
            return done
        buckets = partitions(spark, n_bytes, max(1, limit // 2))
        dealt = pending.repartition(buckets, F.xxhash64("digest", F.lit(level)))
        merged = stored(dealt.mapInArrow(tidied(_merge(whole_rows, schema, limit)), schema), "exact-level")
        resolved = merged.where("kind = 0")
        done = resolved if done is None else done.unionByName(resolved)
        pending, level = merged.where("kind = 1"), level + 1


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Rows are equal when their texts are, runs of ASCII white space taken as one
    space; a null text is empty. The row with the smallest id stays; missing ids
    come last. Of rows that repeat an id and a text one stays. An empty table
    gives no rows. Other columns are not read.
    """
    schema = _schema(None)
    rows = docs.select(named(doc_id).cast("long").alias("i"), named(text).cast("string").alias("t"))
    folded = stored(rows.mapInArrow(tidied(_fold(False, schema, table_bytes)), schema), "exact-folded")
    groups = _resolve(folded, False, table_bytes).select(
        "home", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("lead"),
        F.lower(F.hex("digest")).alias("text_sha256"))
    members = folded.where("kind = 0").select("doc_id", "home", F.col("lead").alias("first"))
    joined = members.join(groups, "home")
    stays = F.col("first") & F.col("lead") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                          table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they were.

    The rule is that of :func:`exact_groups`; columns may have any names.
    """
    packed = docs.select(named(doc_id).cast("long").alias("i"), named(text).cast("string").alias("t"),
                         F.struct(*[named(c) for c in docs.columns if c != text]).alias("rest"))
    schema = _schema(packed.schema["rest"].dataType)
    # the folded rows go straight into the first shuffle, so that the texts are not written once more
    n_bytes = packed.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.lit(_ENTRY_BYTES)), F.lit(0))).first()[0]
    kept = _resolve(packed.mapInArrow(tidied(_fold(True, schema, table_bytes)), schema), True, table_bytes, n_bytes)
    return kept.select(*[(F.col("text").cast(docs.schema[c].dataType) if c == text
                          else F.col("rest").getField(c)).alias(c) for c in docs.columns])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all ``documents``; see :func:`exact_groups` for odd inputs."""
    return exact_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH normal AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, sha256(n.t) AS text_sha256,
    row_number() OVER (PARTITION BY n.t ORDER BY n.doc_id NULLS LAST) = 1 AS kept
FROM normal n JOIN grouped g ON n.t = g.t
"""
