"""Reading the input tables and staging intermediate ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged").rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table written once to the shared folder and read back.

    Later steps start from the files, so a lost executor costs no more than
    its running tasks, and rows made by tasks that depend on where they ran
    (task numbers, running counters) stay as they were written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone; a null text counts as empty. Other columns, whatever their names, stay out."""
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
