"""Token-id output: a wavelet matrix per shard, shards in the order of the ids.

Each shard is one self-contained image (see ``wavelet``). Images are the rows of
a Parquet table, so that Spark commits them, whatever store the folder is in,
and a task that is run again leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trunkwatch.llm.common import table, text_of
from trunkwatch.llm.tokens import encoder, vocabulary_path
from trunkwatch.llm.wavelet import Shard, encode_shard
from trunkwatch.session import work_folder
from trunkwatch.sources.tables import named

#: The id after each document.
END = 0
#: Tokens of a shard; a longer document makes a longer shard.
SHARD_TOKENS = 1 << 20

def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
                 vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS, end: int = END) -> None:
    """Encodes whole texts, each followed by ``end``, and writes the shards to ``path``.

    Documents are in ascending order of the id, those without an id first, and
    those that share one by a hash of the text. A null or empty text is its end
    alone. An empty table writes no shard. Other columns are not read.
    """
    file = vocabulary or vocabulary_path()

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(file, "library"), TaskContext.get().partitionId() << 32
        ids, lengths, tokens, held = [], [], [], 0

        def image() -> pa.RecordBatch:
            packed = encode_shard(ids, np.array(lengths), np.concatenate(tokens))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([held], pa.int64()),
                                               pa.array([packed], pa.binary())], names=["shard", "n_tokens", "image"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, offsets, found in own.encode(batch.column(1)):
                found = np.insert(found, offsets[1:], end)  # an end after each document
                ends = offsets + np.arange(len(offsets))
                row = 0
                while row < len(offsets) - 1:
                    upto = int(np.searchsorted(ends, ends[row] + shard_tokens - held, side="right")) - 1
                    if upto <= row and not held:
                        upto = row + 1
                    if upto > row:
                        ids += names[first + row:first + upto]
                        lengths += np.diff(ends[row:upto + 1]).tolist()
                        tokens.append(found[ends[row]:ends[upto]])
                        held += int(ends[upto] - ends[row])
                        row = upto
                    if row < len(offsets) - 1:
                        yield image()
                        shard, ids, lengths, tokens, held = shard + 1, [], [], [], 0
        if ids:
            yield image()

    # rows that share id and text differ in their place, so that the range sort can split them
    rows = docs.select(named(doc_id).cast("long").alias("i"), text_of(text).alias("t"),
                       F.monotonically_increasing_id().alias("row"))
    place = ["i", F.xxhash64("t"), "row"]
    (rows.repartitionByRange(*place).sortWithinPartitions(*place).select("i", "t")
     .mapInArrow(images, "shard long, n_tokens long, image binary").write.parquet(path))


_SHARD = "shard long, n_tokens long, image binary"


def read_shards(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, shard, place, n_tokens, ids`` of every document, read from the shards.

    ``ids`` are little-endian unsigned 32-bit integers; ``place`` counts the ids
    before them in the shard. With ``digest`` their CRC-32 stands for them, as ``ids_crc32``.
    """

    last = "ids_crc32" if digest else "ids"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, image in zip(batch.column(0), batch.column(1)):
                shard = Shard(image.as_py())
                raw = memoryview(shard.tokens().astype("<u4").tobytes())
                ends = np.cumsum(shard.lengths)
                for a in range(0, len(ends), 2048):
                    e, n = ends[a:a + 2048], shard.lengths[a:a + 2048]
                    own = [raw[4 * (y - x):4 * y] for x, y in zip(n.tolist(), e.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard.doc_ids[a:a + 2048], pa.int64()),
                         pa.array([number.as_py()] * len(e), pa.int64()), pa.array(e - n), pa.array(n),
                         pa.array([crc32(i) for i in own], pa.int64()) if digest else pa.array(own, pa.binary())],
                        names=["doc_id", "shard", "place", "n_tokens", last])

    shards = spark.read.schema(_SHARD).parquet(path).select("shard", "image")
    return shards.mapInArrow(unpack, f"doc_id long, shard long, place long, n_tokens long, {last} {'long' if digest else 'binary'}")


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` of :func:`read_shards` with ``start``, the ids of all documents before.

    Leave out ``ids`` where they are not needed, as rows move to their shard's start.
    """
    shards = rows.sparkSession.read.schema(_SHARD).parquet(path).select("shard", "n_tokens")
    # one row per shard: a million tokens each
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, "shard").withColumn("start", F.col("before") + F.col("place")).drop("before")


def occurrences(spark: SparkSession, path: str, token: int, limit: int | None = None) -> DataFrame:
    """``shard, n, places`` of a token, looked up in the bit planes without decoding the shards."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, image in zip(batch.column(0), batch.column(1)):
                shard = Shard(image.as_py())
                n = shard.count(token)
                places = shard.select(token, np.arange(n if limit is None else min(n, limit)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()], pa.int64()), pa.array([n], pa.int64()),
                     pa.array([places.tolist()], pa.list_(pa.int64()))], names=["shard", "n", "places"])

    shards = spark.read.schema(_SHARD).parquet(path)
    return shards.select("shard", "image").mapInArrow(look, "shard long, n long, places array<long>")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all ``documents``, read back from their shards; see :func:`write_shards` for odd inputs."""
    path = work_folder(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return with_starts(read_shards(spark, path, digest=True), path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "place")
