"""One spelling for records of different producers, read from JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip_ws

PLAN_STATES = ("ready", "needs_approval", "incompatible")


def _first(doc: Column, *names: str) -> Column:
    """First of several keys that holds a non-empty value."""
    return F.coalesce(*[F.nullif(F.get_json_object(doc, f"$.{n}"), F.lit("")) for n in names])


def _whole(c: Column) -> Column:
    """Number text cut toward zero; null when it is no number."""
    return c.try_cast("double").cast("bigint")


def client(doc: Column) -> Column:
    def count(*names):
        return F.coalesce(_whole(_first(doc, *names)), F.lit(0).cast("bigint"))

    urls = F.coalesce(F.from_json(_first(doc, "social_urls", "handles"), "array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(_first(doc, "client_id", "brand_id", "id"), F.lit("")).alias("client_id"),
        F.coalesce(_first(doc, "name"), F.lit("Cliente sin nombre")).alias("name"), urls.alias("social_urls"),
        count("templates", "template_count").alias("templates"), count("campaigns", "campaign_count").alias("campaigns"),
        _first(doc, "updated_at").alias("updated_at"))


def row_plan(doc: Column) -> Column:
    """Plan of a matrix row; null below row 2 or without a row number."""
    number = _whole(F.get_json_object(doc, "$.row_number"))
    status = strip_ws(F.coalesce(F.get_json_object(doc, "$.status"), F.lit("")))
    template = F.get_json_object(doc, "$.template.candidate_id")
    return F.when(number >= 2, F.struct(
        number.alias("row_number"), F.when(status.isin(*PLAN_STATES), status).otherwise("incompatible").alias("status"),
        F.greatest(F.lit(0).cast("bigint"), F.coalesce(_whole(F.get_json_object(doc, "$.product_count")), F.lit(0).cast("bigint"))).alias("product_count"),
        template.alias("template"),
        F.coalesce(F.from_json(F.get_json_object(doc, "$.blocking_fields"), "array<string>"), F.array().cast("array<string>")).alias("blocking_fields")))
