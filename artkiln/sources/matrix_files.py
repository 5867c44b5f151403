"""Matrix files: bytes or text to ordered records of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import infer_separator, parse_matrix_cells
from ..schemas import MATRIX_CELLS
from ..session import staged


# The characters of bytes 80 to 9F in the Western Windows set; the missing five are not defined.
WINDOWS_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
WINDOWS_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WINDOWS_UNDEFINED = r"[\x81\x8d\x8f\x90\x9d]"


def decoded(content: Column) -> Column:
    """UTF-16 by its mark, else UTF-8, else the Western Windows set; null when that leaves bytes undefined."""
    western = F.decode(content, "ISO-8859-1")
    head = F.hex(F.substring(content, 1, 2))
    text = (
        F.when(head.isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
        .when(~F.rlike(western, F.lit(WINDOWS_UNDEFINED)), F.translate(western, WINDOWS_BYTES, WINDOWS_CHARS)))
    return F.regexp_replace(text, "^﻿", "")


def source_kind(path: Column) -> Column:
    """``csv``, ``workbook`` or null for a file that is no matrix."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "xlsx", "workbook").when(ext.isin("", "csv", "tsv", "txt"), "csv")


def first_lines(text: Column, n: int = 6) -> Column:
    return F.slice(F.split(text, r"\r\n|\r|\n"), 1, n)


def split_records(texts: DataFrame) -> DataFrame:
    """``(matrix_id, text)`` -> quoted records as cells.

    Record splitting honours quotes, so it runs as a batched map with the
    standard library's reader, one file after the other; the caller's
    partitioning spreads the files. A file that the reader refuses (a field
    beyond its limit, a stray NUL) gives one record numbered 0 with the reason
    and harms no other. All later work is column expressions.
    """
    separated = texts.withColumn("separator", infer_separator(first_lines(F.col("text")))).where(F.col("separator").isNotNull())

    def records(batches):
        import csv
        import io

        import pandas as pd

        for batch in batches:
            for mid, text, sep in zip(batch["matrix_id"], batch["text"], batch["separator"]):
                done, rows = 0, []

                def part():
                    return pd.DataFrame({"matrix_id": [mid] * len(rows), "record_no": range(done + 1, done + len(rows) + 1), "cells": rows})

                try:
                    for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield part()
                            done, rows = done + len(rows), []
                except csv.Error as e:
                    yield pd.DataFrame({"matrix_id": [mid], "record_no": [0], "cells": [[str(e)]]})
                if rows:
                    yield part()

    return separated.select("matrix_id", "text", "separator").mapInPandas(records, MATRIX_CELLS)


def read_matrices(spark: SparkSession, path: str, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every CSV/TSV matrix under a folder -> rows and errors.

    Files above the upload limit, if one is given, files of undefined bytes and
    files that cannot be split into records are errors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("kind", source_kind(F.col("path")))
    large = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    every = files.where((F.col("kind") == "csv") & ~large).select(F.col("path").alias("matrix_id"), decoded(F.col("content")).alias("text"))
    texts = every.where(F.trim("text") != "")
    records = staged(split_records(texts), "matrix-records")
    broken = records.where(F.col("record_no") == 0).select("matrix_id")
    rows, errors = parse_matrix_cells(records.join(broken, "matrix_id", "left_anti"))

    def error(df, rule):
        return df.select(F.col("path").alias("matrix_id"), F.lit(None).cast("int").alias("row_number"), F.lit(rule).alias("rule"))

    no_header = texts.where(infer_separator(first_lines(F.col("text"))).isNull()).select(
        "matrix_id", F.lit(1).alias("row_number"), F.lit("no_known_header").alias("rule"))
    def whole(df, rule):
        return error(df.withColumnRenamed("matrix_id", "path"), rule)

    return rows, errors.unionByName(error(files.where(F.col("kind").isNull()), "unknown_extension")).unionByName(
        error(files.where((F.col("kind") == "csv") & large), "too_large")).unionByName(no_header).unionByName(
        whole(every.where(F.col("text").isNull()), "unknown_encoding")).unionByName(whole(broken, "unreadable_records"))


def read_separated(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Wide files of one known separator through Spark's own reader (no record numbers)."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"')

