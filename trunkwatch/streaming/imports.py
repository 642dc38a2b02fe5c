"""Drop folder of diagnostics files: good rows appended, bad rows set aside.

Unlike an import of a whole table nothing is replaced and one bad row does not
hold up the others. Rows are kept as they arrive; which of them count is read off
the whole of them. How often each key has come is the state of a stream of its
own, which tells of a batch's keys alone; what it finds repeated is kept beside
the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from trunkwatch.functions.cleaning import inspected_on
from trunkwatch.operators.listing import group_apart
from trunkwatch.schema import DIAGNOSTICS
from trunkwatch.sources.store import exists

REASONS = "reasons"
_ARRIVED = T.StructType([*DIAGNOSTICS.fields, T.StructField(REASONS, T.ArrayType(T.StringType()))])


def watch(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    reader = (spark.readStream.schema(DIAGNOSTICS).format(fmt)
              .option("maxFilesPerTrigger", files_per_batch))
    if fmt == "csv":
        # the header must name the declared columns in their order
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.load(folder)


def _row_reasons() -> Column:
    """The rules that a row breaks on its own; what an import only warns of is let
    through, but a row without a usable key or date is not."""
    def broken(name: str, bad: Column) -> Column:
        return F.when(bad, F.lit(name))

    return F.array_compact(F.array(
        broken("null_diag_id", F.col("diag_id").isNull()),
        broken("invalid_date", inspected_on().isNull()),
        broken("orphan_object_id", F.col("known").isNull())))


def judged(batch: DataFrame, objects: DataFrame) -> DataFrame:
    """Rows with the rules that each breaks whatever else has arrived."""
    known = group_apart(objects, "object_id").agg(F.lit(True).alias("known")).drop("shard")
    return batch.join(known, "object_id", "left").select(*batch.columns, _row_reasons().alias(REASONS))


def keep(batch: DataFrame, batch_id: int, objects: DataFrame, arrived: str) -> None:
    """Writes one judged batch into a folder of its own, so a repeated batch replaces itself."""
    judged(batch, objects).write.mode("overwrite").parquet(f"{arrived}/batch_id={batch_id}")


def outcome(arrived: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """All rows that arrived, with all the rules they break.

    All rows of a repeated key are bad, since nothing tells the right one. Keys are
    counted over everything that arrived, so the outcome does not depend on how
    files were dealt to batches; a late copy takes back what was good until then.
    ``repeated`` names the keys known to come more than once (see
    :func:`repeated_keys`); without it the keys are counted here.
    """
    if repeated is None:
        times = (group_apart(arrived.where(F.col("diag_id").isNotNull()), "diag_id")
                 .agg(F.count("*").alias("times")).drop("shard"))
    else:
        times = group_apart(repeated, "diag_id").agg(F.max("times").alias("times")).drop("shard")
    is_repeated = F.when(F.col("times") > 1, F.array(F.lit("duplicate_diag_id"))).otherwise(F.array())
    own = F.col(REASONS)
    before = F.filter(own, lambda r: r != "orphan_object_id")
    after = F.filter(own, lambda r: r == "orphan_object_id")
    return (arrived.join(times, "diag_id", "left")
            .select(*[c for c in arrived.columns if c != REASONS], F.concat(before, is_repeated, after).alias(REASONS)))


def arrivals(spark: SparkSession, arrived: str) -> DataFrame:
    """What the stream has kept so far, of all batches."""
    return spark.read.schema(_ARRIVED).parquet(arrived)


def _keys_folder(arrived: str) -> str:
    return f"{arrived.rstrip('/')}-repeated"


def repeated_keys(spark: SparkSession, arrived: str) -> DataFrame | None:
    """``diag_id, times`` of keys that have come more than once, as often as that was told; ``None`` before a count."""
    folder = _keys_folder(arrived)
    return spark.read.schema("diag_id long, times long").parquet(folder) if exists(spark, folder) else None


def judged_arrivals(spark: SparkSession, arrived: str) -> DataFrame:
    """The :func:`outcome` of all that has arrived. It counts no keys anew."""
    return outcome(arrivals(spark, arrived), repeated_keys(spark, arrived))


def accepted(spark: SparkSession, arrived: str) -> DataFrame:
    return judged_arrivals(spark, arrived).where(F.size(REASONS) == 0).drop(REASONS)


def quarantined(spark: SparkSession, arrived: str) -> DataFrame:
    return judged_arrivals(spark, arrived).where(F.size(REASONS) > 0)


def key_counts(stream: DataFrame) -> DataFrame:
    """``diag_id, times`` of a stream: how often each key has come. The counts are the state, updated by batch."""
    return stream.where(F.col("diag_id").isNotNull()).groupBy("diag_id").agg(F.count("*").alias("times"))


def keep_repeated(counts: DataFrame, batch_id: int, arrived: str) -> None:
    """Of the keys that a batch touched those that have now come more than once, in a folder of the batch."""
    counts.where("times > 1").write.mode("overwrite").parquet(f"{_keys_folder(arrived)}/batch_id={batch_id}")


class StreamImport:
    """Two queries over one stream, one after the other: rows, and then the keys' counts.

    The counts may be of files whose rows come with the next run, never the other way.
    """

    def __init__(self, rows: StreamingQuery, count: Callable[[], StreamingQuery]):
        self.rows, self._count = rows, count

    def awaitTermination(self) -> None:
        self.rows.awaitTermination()
        self._count().awaitTermination()


def stream_import(stream: DataFrame, objects: DataFrame, arrived: str, checkpoint: str) -> StreamImport:
    """Keeps all rows of a stream, judged one by one; :func:`accepted` and
    :func:`quarantined` tell them apart by the rules for the whole table.

    A later run goes on from the checkpoint: it reads new files only, and of the
    counts only the new files' keys.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        keep(batch, batch_id, objects, arrived)

    def count() -> StreamingQuery:
        return (key_counts(stream.select("diag_id")).writeStream.outputMode("update")
                .foreachBatch(lambda batch, batch_id: keep_repeated(batch, batch_id, arrived))
                .option("checkpointLocation", f"{checkpoint}/keys").trigger(availableNow=True).start())

    rows = (stream.writeStream.foreachBatch(one)
            .option("checkpointLocation", f"{checkpoint}/rows")
            .trigger(availableNow=True).start())
    return StreamImport(rows, count)
