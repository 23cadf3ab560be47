"""Reading corpora: plain text and JSON lines, also compressed, as documents with their address.

Files of a folder are read by Spark in parallel; the address (file_id, line_id) restores the order of a sequential reader.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexiloom.sources.files import files_in

COMPRESSED = ".zst"


def field_of(value: Column | str, name: str) -> Column:
    """A string field of JSON objects; null where an object lacks it. Text that is no JSON object fails the query."""
    return F.from_json(value, T.StructType([T.StructField(name, T.StringType())]), {"mode": "FAILFAST"})[name]


def source_files(spark: SparkSession, path: str, plain_first: bool = False) -> list[str]:
    """Addresses of the regular files of a source: the file itself, or those right inside of a folder, sorted by name.

    With ``plain_first`` compressed files come after all others. Raises FileNotFoundError if there is none.
    """
    files = files_in(spark, path)
    if not files:
        raise FileNotFoundError(f"no file in {path}")
    if plain_first:
        files = sorted(files, key=lambda f: f.endswith(COMPRESSED))
    return files


def raw_lines(spark: SparkSession, path: str, plain_first: bool = False) -> DataFrame:
    """(file_id, line_id, value): every line with its address, line_id from 0 inside of its file.

    Line ids come from the file's byte order, which a split scan keeps inside of partitions: partitions of a file are
    numbered by their first byte and only their line counts are gathered.
    """
    files = source_files(spark, path, plain_first)
    same = lambda p: re.sub("^file:/+", "file:/", p)
    ids = spark.createDataFrame([(same(f), k) for k, f in enumerate(files)], "path string, file_id int")
    lines = spark.read.text(files).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("order"))
    sizes = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = lines.join(starts, ["path", "block"]).join(F.broadcast(ids), "path")
    return numbered.select("file_id", (F.col("before") + F.col("order") - F.col("first")).alias("line_id"), "value")


def documents(spark: SparkSession, path: str, text_field: str | None = None, max_docs: int = -1) -> DataFrame:
    """(file_id, line_id, text): a document for each line that isn't blank; with ``text_field`` lines are JSON objects.

    ``max_docs`` > 0 keeps the first ones in order; lines without the field are left out, lines that are no JSON fail.
    """
    lines = raw_lines(spark, path, plain_first=True)
    docs = lines.where(F.trim(F.regexp_replace("value", r"[\t-\r]", " ")) != "")
    if text_field is None:
        out = docs.select("file_id", "line_id", F.col("value").alias("text"))
    else:
        out = docs.select("file_id", "line_id", field_of("value", text_field).alias("text")).where("text is not null")
    return out.orderBy("file_id", "line_id").limit(max_docs) if max_docs > 0 else out


def pretraining_documents(spark: SparkSession, path: str, text_field: str = "text") -> DataFrame:
    """(file_id, line_id, text) of mixed sources: files named .txt or .txt.zst are plain, all others JSON lines."""
    lines = raw_lines(spark, path)
    files = source_files(spark, path)
    plain = [k for k, f in enumerate(files) if f.removesuffix(COMPRESSED).endswith(".txt")]
    is_plain = F.col("file_id").isin(plain) if plain else F.lit(False)
    parsed = field_of(F.when(~is_plain, F.col("value")), text_field)
    return lines.where(F.trim("value") != "").select("file_id", "line_id", F.when(is_plain, F.col("value")).otherwise(parsed).alias("text")).where("text is not null")


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """(piece): non-blank lines without surrounding blanks."""
    return spark.read.text(path).select(F.trim("value").alias("piece")).where("piece != ''")
