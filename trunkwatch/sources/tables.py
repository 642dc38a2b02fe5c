"""Readers for inspection tables: CSV in any of the usual charsets, and Parquet."""

from __future__ import annotations

import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trunkwatch.schema import DIAGNOSTICS, OBJECTS, PIPELINES
from trunkwatch.session import written

UNREADABLE = "_unreadable"
UTF8, CP1251, LATIN1 = "utf-8", "cp1251", "latin1"

# --- fixed values: texts that stand for a missing value -------------------------
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
           "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Bytes 128..255 read as Latin-1, next to what they mean in cp1251. Byte 0x98
# means nothing there, so it maps to itself.
_HIGH_BYTES = bytes(range(0x80, 0x100))
AS_LATIN1 = _HIGH_BYTES.decode("latin1")
AS_CP1251 = "".join(bytes([b]).decode("cp1251", errors="ignore") or chr(b) for b in _HIGH_BYTES)


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def clean_header(name: str) -> str:
    return name.replace("\ufeff", "").replace("\u200b", "").strip()


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names without outer blanks, byte-order marks and zero-width spaces."""
    return df.toDF(*[clean_header(name) for name in df.columns])


def detect_charsets(spark: SparkSession, path: str) -> DataFrame:
    """``(file, charset, multi_line, header)``: UTF-8 if every line is valid, else cp1251
    unless a byte has no meaning there, else Latin-1; whether some quoted text
    goes over a line's end, which leaves lines with an odd number of quotes; and the
    first line that is not empty, decoded.

    Line breaks never fall inside a UTF-8 character, so lines can be checked on
    their own: files are split over tasks and need not fit in memory.
    """
    # rows of one split are numbered as they come, and a file's first split has its first line
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.when((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""), F.monotonically_increasing_id()).alias("place"))
    undefined = F.contains(F.col("value").cast("binary"), F.unhex(F.lit("98")))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    charset = F.when(F.col("is_utf8"), UTF8).when(~F.col("undefined"), CP1251).otherwise(LATIN1)
    return (lines.groupBy("file")
            .agg(F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"),
                 F.bool_or(undefined).alias("undefined"),
                 F.bool_or(quotes % 2 == 1).alias("multi_line"),
                 F.min_by(F.col("value").cast("binary"), "place").alias("first"))
            .select("file", charset.alias("charset"), "multi_line",
                    _decoded(F.decode("first", "ISO-8859-1"), charset).alias("header")))


def _decoded(latin1: Column, charset: Column) -> Column:
    """Text that was read as Latin-1, which keeps each byte, in the charset that it is in."""
    return (F.when(charset == UTF8, F.decode(F.encode(latin1, "ISO-8859-1"), "UTF-8"))
            .when(charset == CP1251, F.translate(latin1, AS_LATIN1, AS_CP1251)).otherwise(latin1))


def _from_cp1251(text: str) -> str:
    return text.translate(str.maketrans(AS_LATIN1, AS_CP1251))


def _as_path(file: str) -> str:
    """A file's path with what a glob would take for a pattern escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(file))


def _read_csv_as_text(spark: SparkSession, paths: list[str], charset: str,
                      multi_line: bool) -> DataFrame:
    """CSV files of one charset with all columns as text, headers cleaned.

    Files in cp1251 are read as Latin-1, which keeps each byte, and mapped
    letter by letter; Spark has no such charset of its own. Headers of all files
    are checked against the first one's. Only files that need it are read with
    quoted line ends, as that takes each of them to one task.
    """
    encoding = "UTF-8" if charset == UTF8 else "ISO-8859-1"
    reader = (spark.read.option("header", True).option("encoding", encoding)
              .option("escape", '"').option("multiLine", multi_line))
    header = reader.csv(paths).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    df = reader.schema(schema).option("enforceSchema", False).csv(paths)
    if charset == CP1251:
        df = df.select([F.translate(named(name), AS_LATIN1, AS_CP1251)
                        .alias(_from_cp1251(name)) for name in header])
    return clean_headers(df)


def _read_mixed(spark: SparkSession, path: str, files: DataFrame, header: str) -> DataFrame:
    """The files with this header and without quoted line ends, each row in its file's charset.

    The whole folder is read as Latin-1: commas, quotes and line ends are the same
    bytes in all charsets. The charset comes to the rows by a join on their file.
    """
    names = [clean_header(name) for name in next(csv.reader([header]))]
    places = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    rows = (spark.read.schema(places).option("header", True).option("encoding", "ISO-8859-1").option("escape", '"')
            .csv(path).select("*", F.col("_metadata.file_path").alias("_file")))
    own = files.where((F.col("header") == header) & ~F.col("multi_line")).select(F.col("file").alias("_file"), "charset")
    return rows.join(own, "_file").select([
        _decoded(F.col(f"_c{i}"), F.col("charset")).alias(name) for i, name in enumerate(names)])


def read_csv_any_charset(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder as text columns, each file in its own charset.

    Files that are all of one kind, as they mostly are, are read as the folder they
    are in. Where charsets mix, rows are decoded by the charset of their file. Files
    of one charset must agree in their header. Only files with quoted line ends in a
    folder of others are read by name; each of them takes a task of its own anyway.
    """
    files = detect_charsets(spark, path)
    kinds = [(r["charset"], r["multi_line"]) for r in files.select("charset", "multi_line").distinct().collect()]
    if not kinds:
        raise ValueError(f"no CSV rows below {path}")
    if len(kinds) == 1:
        return _read_csv_as_text(spark, [path], *kinds[0])
    plain = F.trim(F.regexp_replace("header", "[\ufeff\u200b]", ""))
    files = written(files.withColumn("header", plain).where(F.col("header").isNotNull()), "charsets")
    by_kind = files.where(~F.col("multi_line")).groupBy("charset").agg(
        F.min("header").alias("header"), F.max("header").alias("other")).collect()  # a row per charset
    odd = [r["charset"] for r in by_kind if r["header"] != r["other"]]
    if odd:
        raise ValueError(f"headers of files in {odd[0]} differ below {path}")
    frames = [_read_mixed(spark, path, files, header) for header in sorted({r["header"] for r in by_kind})]
    paths: dict[str, list[str]] = {}
    for row in files.where("multi_line").toLocalIterator():
        paths.setdefault(row["charset"], []).append(_as_path(row["file"]))
    frames += [_read_csv_as_text(spark, sorted(own), charset, True) for charset, own in sorted(paths.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _missing(name: str) -> Column:
    texts = ", ".join(f"'{text}'" for text in MISSING)
    quoted = name.replace("`", "``")
    return F.expr(f"`{quoted}` IN ({texts})")


def _typed(name: str, wanted: T.DataType) -> Column:
    text = F.trim(named(name))
    if isinstance(wanted, T.StringType):
        return named(name)
    if isinstance(wanted, (T.LongType, T.IntegerType)):
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast(wanted))
        return F.coalesce(text.try_cast(wanted), whole)  # 2020.0 is a year, too
    return text.try_cast(wanted)


def conform(df: DataFrame, schema: T.StructType, mark: bool = False) -> DataFrame:
    """Text columns cast to their declared types; missing and unreadable values
    become null, undeclared columns stay text. ``mark`` adds the names of the
    columns whose value got lost in a row."""
    df = df.select([F.when(~_missing(c), named(c)).alias(c) for c in df.columns])
    wanted = {f.name: f.dataType for f in schema.fields}
    typed = {c: _typed(c, wanted[c]) for c in df.columns if c in wanted}
    columns = [typed[c].alias(c) if c in typed else named(c) for c in df.columns]
    if mark:
        lost = [F.when((F.trim(named(c)) != "") & value.isNull(), c)
                for c, value in typed.items() if not isinstance(wanted[c], T.StringType)]
        columns.append(F.array_compact(F.array(*lost)).cast("array<string>").alias(UNREADABLE))
    return df.select(columns)


def complete(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the declared columns, nulls where the table has none."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    if fmt == "csv":
        return complete(conform(read_csv_any_charset(spark, path), schema), schema)
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unsupported format: {fmt}")


def read_pipelines(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, PIPELINES, fmt)


def read_objects(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, OBJECTS, fmt)


def read_diagnostics(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, DIAGNOSTICS, fmt)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows, next to the size and the columns of the whole."""
    size = df.select(F.count("*").alias("row_count"))
    return df.limit(n).select(
        F.lit(", ".join(df.columns)).alias("columns"), size.scalar().alias("row_count"), "*")
