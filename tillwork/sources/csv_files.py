"""CSV files with differing headers, read in one scan, each record with its own cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.functions.text import extension, nullify_missing
from tillwork.staging import attach, stage, stage_measured

FILE_PATH = "_metadata.file_path"


def folder_name(path: Column) -> Column:
    """Default owner of a file: the name of the folder it lies in."""
    return F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)


def list_files(spark: SparkSession, paths: list[str], client_of: Callable[[Column], Column] = folder_name) -> DataFrame:
    """Every non-empty file with its client, format and time of upload; file contents are not read.

    Spark's file index leaves out zero-byte files, so an upload list is needed to report those.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    path = F.col("source_id")
    return files.select(F.col(FILE_PATH).alias("source_id"), F.col("_metadata.file_modification_time").alias("uploaded_at")).select(
        "source_id", client_of(path).alias("client_id"), extension(path).alias("format"), "uploaded_at"
    )


def split_line(line: Column) -> Column:
    """Cells of one CSV record; quoted cells may hold commas, doubled quotes and line breaks.

    A cell whose quotes do not close before the next comma is taken as it stands.
    """
    quoted = r'"[^"]*+(?:""[^"]*+)*+"(?=,|$)'
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f"(?s),({quoted}|[^,]*+)"), F.lit(1))
    plain = F.transform(
        cells,
        lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c),
    )
    return F.when(line.contains('"'), plain).otherwise(F.split(line, ",", -1))


def _records(spark: SparkSession, paths: list[str], multiline: bool) -> DataFrame:
    """(source_id, start, line) of all non-blank records; ``start`` is where in the file the task began to read."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cC][sS][vV]")
    lines = reader.text(paths, wholetext=multiline).select(F.col(FILE_PATH).alias("source_id"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    if multiline:
        record = r'[^"\r\n]*+(?:"[^"]*+"[^"\r\n]*+)*+'
        lines = lines.withColumn("line", F.explode(F.regexp_extract_all("line", F.lit(record), F.lit(0))))
    return lines.filter(F.length(F.trim("line")) > 0)


def read_csv_sources(
    spark: SparkSession,
    paths: list[str],
    client_of: Callable[[Column], Column] = folder_name,
    multiline: bool = False,
    uploads: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All CSV files under ``paths`` as (sources, raw cells).

    The text is read once, in one scan of all files: each record becomes an array of its own cells, which is
    stored, so that differing headers can neither shift values nor need one read per header, and a
    file with very many columns does not widen the rows of the others. A file's header is the first
    record of its first block. ``multiline`` keeps quoted line breaks together, at the price of not
    splitting large files. ``uploads`` (``source_id``, ``client_id``) is the list of expected files, with which
    missing and zero-byte files show up too.
    """
    line = F.replace("line", F.lit("\ufeff"), F.lit(""))
    records = _records(spark, paths, multiline).withColumns({"row_ix": F.monotonically_increasing_id(), "cells": split_line(line)}).drop("line")
    records = stage(records, "records")
    first = records.filter("start = 0").groupBy("source_id").agg(F.min("row_ix").alias("row_ix"))
    first, size = stage_measured(first, "first")
    headers = attach(records.filter("start = 0"), first, ["source_id", "row_ix"], "left_semi", size=size)
    headers = headers.select("source_id", F.transform("cells", lambda c: F.nullif(F.ltrim(c), F.lit(""))).alias("header"))
    listed = list_files(spark, paths, client_of)
    if uploads is not None:
        expected = uploads.select("source_id", "client_id", extension(F.col("source_id")).alias("format"))
        times = listed.select("source_id", "uploaded_at")
        listed = expected.join(times, "source_id", "left").unionByName(listed.join(expected, "source_id", "left_anti"))
    sources = listed.join(headers, "source_id", "left")
    rows = attach(records, first, ["source_id", "row_ix"], "left_anti", size=size)
    return sources, rows.select("source_id", "row_ix", F.transform("cells", nullify_missing).alias("cells"))
