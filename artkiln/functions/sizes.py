"""Product family and real height from the words of a name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import let, rlike, spaced

_SCREEN_CM = 9 / math.sqrt(9**2 + 16**2) * 2.54 * 1.08


def _haystack(texts: tuple[Column, ...]) -> Column:
    return F.concat_ws(" ", *[F.when(t.isNotNull() & (t != ""), spaced(t)) for t in texts])


def inches(text: Column) -> Column:
    """Largest two-digit inch mark between 10 and 90 in normalised text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(K.INCH_PATTERN), F.lit(1)), lambda v: v.cast("int"))
    return F.array_max(F.filter(found, lambda v: v.between(10, 90)))


def family(*texts: Column) -> Column:
    def first(hay):
        return F.coalesce(*[F.when(rlike(hay, p), F.lit(k)) for k, p, _, _ in K.PRODUCT_FAMILIES])

    return let(_haystack(texts), first)


def measure_as(key: Column, *hints: Column) -> Column:
    """``STRUCT<height_cm,family>`` of a known family, refined by inches in the hints."""
    return let(F.struct(key.alias("k"), inches(_haystack(hints)).alias("i")), lambda v: _sized(v["k"], v["i"]))


def _sized(key: Column, inch: Column) -> Column:
    facts = F.create_map(*[c for k, _, h, n in K.PRODUCT_FAMILIES for c in (F.lit(k), F.struct(F.lit(h).alias("h"), F.lit(n).alias("n")))])
    fact = F.try_element_at(facts, key)
    screen, width = key.isin(*K.SCREEN_FAMILIES), key.isin(*K.WIDTH_FAMILIES)
    sized = (
        F.when(inch.isNotNull() & screen, inch * F.lit(_SCREEN_CM))
        .when(inch.isNotNull() & width, F.when(inch >= 26, 95.0).otherwise(90.0))
        .otherwise(fact["h"])
    )
    named = F.when(inch.isNotNull() & (screen | width), F.concat(fact["n"], F.lit(" de "), inch.cast("string"), F.lit('"')))
    return F.when(
        fact.isNotNull(), F.struct(F.bround(sized, 1).alias("height_cm"), F.coalesce(named, fact["n"]).alias("family")))


def measure(*texts: Column) -> Column:
    return let(family(*texts), lambda k: measure_as(k, *texts))


def measure_layer(stored_cm: Column, stored_family: Column, file_name: Column, name: Column, source_name: Column) -> Column:
    """Stored size, else what file name, layer name, source name say, in that order."""
    kept = F.when(
        stored_cm.isNotNull() & (stored_cm != 0),
        F.struct(stored_cm.cast("double").alias("height_cm"), F.coalesce(F.nullif(stored_family, F.lit("")), F.lit("producto")).alias("family")),
    )
    return F.coalesce(kept, measure(file_name), measure(name), measure(source_name))
