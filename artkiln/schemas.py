"""Table schemas and the catalogue frames built from fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import constants as K

SAFE = "STRUCT<left: DOUBLE, top: DOUBLE, right: DOUBLE, bottom: DOUBLE>"
BOX = "STRUCT<x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>"
SLOT = (
    "STRUCT<key: STRING, category: STRING, kind: STRING, required: BOOLEAN, repeatable: BOOLEAN, "
    "generate_if_missing: BOOLEAN>"
)
MATRIX_CELLS = "matrix_id STRING, record_no INT, cells ARRAY<STRING>"
MATRIX_ROWS = (
    "matrix_id STRING, row_number INT, producto STRING, imagen STRING, titular STRING, subtitulo STRING, "
    "precio_anterior STRING, precio_actual STRING, cuota STRING, descuento STRING, cta STRING, legal STRING, "
    "vigencia STRING, formatos ARRAY<STRING>, cantidad_propuestas INT, plantilla STRING, notas STRING, "
    "suppressed_fields ARRAY<STRING>, ai_fields ARRAY<STRING>, modo STRING, fila_origen INT"
)
TEMPLATES = (
    "client_id STRING, campaign_id STRING, candidate_id STRING, ord INT, name STRING, category STRING, "
    f"approved BOOLEAN, range_min INT, range_max INT, slots ARRAY<{SLOT}>"
)
POST = (
    "STRUCT<IdIg: STRING, Date: STRING, Text: STRING, Likes: BIGINT, Comments: BIGINT, Link: STRING, "
    "Url_media: STRING, Thumbnail: STRING, type: STRING>"
)
FEED_ACCOUNT = f"STRUCT<Id: BIGINT, Name: STRING, Dates: ARRAY<STRUCT<Date: STRING, Posts: ARRAY<{POST}>>>>"
# Keys differ only by case between producers, so entries are read as maps.
CATALOGUE_ENTRY = "MAP<STRING, STRING>"
DETECTION = "image_id STRING, ord INT, x INT, y INT, width INT, height INT, score DOUBLE, label STRING, kind STRING"
TEXT_REGION = (
    "image_id STRING, ord INT, text STRING, x INT, y INT, width INT, height INT, confidence DOUBLE, angle DOUBLE, color STRING"
)


def format_rows() -> list[tuple]:
    """Every known size: presets first, then the older names (37 rows, fixed)."""
    rows = [(i, *p[:7], p[7], p[8]) for i, p in enumerate(K.FORMAT_PRESETS)]
    base = len(rows)
    return rows + [
        (base + i, name, "Personalizado", "Formato heredado", name, w, h, f"{w}:{h}", K.DEFAULT_SAFE, False)
        for i, (name, w, h) in enumerate(K.LEGACY_SIZES)
    ]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        format_rows(),
        "ord INT, id STRING, platform STRING, family STRING, placement STRING, width INT, height INT, ratio STRING, "
        f"safe {SAFE}, recommended BOOLEAN",
    )


def format_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(K.FORMAT_ALIASES.items()), "alias STRING, id STRING")


def header_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(K.ALIAS_TO_COLUMN.items()), "slug STRING, canonical STRING")
