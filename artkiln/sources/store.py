"""A record store by tenant: JSON records under ``client_id=/campaign_id=`` folders, replaced by commit.

A write puts all records beside the old ones and then adds one small commit
file that names them. Readers follow the newest commit, so they see the old or
the new records, and a write that fails leaves the old ones as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.skew import bucketed_rank
from .files import read_partitioned

TENANT = ["client_id", "campaign_id"]
_COMMIT = "number BIGINT, folder STRING"


def _newest(spark: SparkSession, path: str):
    try:
        return spark.read.schema(_COMMIT).json(f"{path}/commits").orderBy(F.col("number").desc(), F.col("folder").desc()).first()
    except AnalysisException:  # no commit yet
        return None


def replace_records(records: DataFrame, path: str) -> None:
    """All records of the store anew. ``records`` carry ``client_id`` and ``campaign_id``; ``doc_client`` is the tenant that the record names."""
    spark, last = records.sparkSession, _newest(records.sparkSession, path)
    number = last.number + 1 if last else 0
    folder = f"rows/{number:09d}-{uuid.uuid4().hex}"
    records.write.partitionBy(*TENANT).json(f"{path}/{folder}")
    spark.range(1).select(F.lit(number).alias("number"), F.lit(folder).alias("folder")).coalesce(1).write.mode("append").json(f"{path}/commits")


def read_store(spark: SparkSession, path: str, schema: str, states: list[str] | None = None) -> DataFrame:
    """The committed records of all tenants; a filter on client or campaign reads their folders only."""
    last = _newest(spark, path)
    if last is None:
        return spark.createDataFrame([], f"{schema}, doc_client STRING, client_id STRING, campaign_id STRING")
    return read_partitioned(spark, f"{path}/{last.folder}", schema, states)


def by_name(records: DataFrame, keys: list[str], name: str, tie: str) -> DataFrame:
    """``place`` of each record in its library, names in order whatever their case."""
    small = F.lower(F.col(name))
    return bucketed_rank(records, keys, F.substring(small, 1, 2), [small, F.col(tie)], "place")


def newest_first(records: DataFrame, keys: list[str], created: str, tie: str) -> DataFrame:
    """``place`` of each record in its library, the newest first."""
    return bucketed_rank(records, keys, -F.unix_date(F.to_date(created)), [F.col(created).desc(), F.col(tie)], "place")
