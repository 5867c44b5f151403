"""Colour maths on ``STRUCT<r,g,b>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(r, g, b) -> Column:
    return F.struct(
        *[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for v, n in ((r, "r"), (g, "g"), (b, "b"))]
    )


def _byte(hex6: Column, at: int) -> Column:
    return F.conv(F.substring(hex6, at, 2), 16, 10).cast("int")


def hex_to_rgb(c: Column) -> Column:
    raw = F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit("#000000")), "^#+", "")
    raw = F.when(F.length(raw) == 3, F.regexp_replace(raw, "(.)", "$1$1")).otherwise(raw)
    raw = F.when(F.length(raw) == 6, raw).otherwise("000000")
    return rgb(_byte(raw, 1), _byte(raw, 3), _byte(raw, 5))


def rgb_to_hex(c: Column) -> Column:
    def part(v):
        return F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(v.cast("double"), 0))).cast("int")), 2, "0")

    return F.concat(F.lit("#"), part(c["r"]), part(c["g"]), part(c["b"]))


def _linear(v: Column) -> Column:
    s = v / 255.0
    return F.when(s <= 0.03928, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance(c: Column) -> Column:
    """WCAG relative luminance."""
    return _linear(c["r"]) * 0.2126 + _linear(c["g"]) * 0.7152 + _linear(c["b"]) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def saturation(c: Column) -> Column:
    hi, lo = F.greatest(c["r"], c["g"], c["b"]), F.least(c["r"], c["g"], c["b"])
    return F.when(hi == 0, 0.0).otherwise((hi - lo) / hi)


def valid_hex(c: Column) -> Column:
    """``#RRGGBB`` in capitals; white for anything that is not a colour."""
    raw = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "^#", "")
    raw = F.when(F.length(raw) == 3, F.regexp_replace(raw, "(.)", "$1$1")).otherwise(raw)
    return F.when(F.rlike(raw, F.lit("^[0-9a-fA-F]{6}$")), F.concat(F.lit("#"), F.upper(raw))).otherwise("#FFFFFF")


def readable_text(bg: Column, preferred: Column) -> Column:
    """Preferred colour when it contrasts 4.5:1, else the better of white and near-black."""
    white, dark = rgb(255, 255, 255), rgb(0x11, 0x11, 0x11)
    best = F.when(contrast(white, bg) >= contrast(dark, bg), "#FFFFFF").otherwise("#111111")
    liked = preferred.isNotNull() & (preferred != "") & (contrast(hex_to_rgb(preferred), bg) >= 4.5)
    return F.when(liked, preferred).otherwise(best)


def ink_for(bg: Column, preferred: Column) -> Column:
    """First of (preferred, white, dark ink) with 3:1 contrast, else the strongest."""
    white, dark = rgb(255, 255, 255), rgb(17, 19, 34)
    has = preferred.isNotNull() & (preferred != "")
    liked = hex_to_rgb(preferred)
    cl, cw, cd = F.when(has, contrast(liked, bg)), contrast(white, bg), contrast(dark, bg)
    strongest = (
        F.when(has & (cl >= cw) & (cl >= cd), liked).when(cw >= cd, white).otherwise(dark)
    )
    return (
        F.when(has & (cl >= 3.0), liked).when(cw >= 3.0, white).when(cd >= 3.0, dark).otherwise(strongest)
    )


def distance(c: Column, d: Column) -> Column:
    return F.sqrt(F.pow(c["r"] - d["r"], F.lit(2)) + F.pow(c["g"] - d["g"], F.lit(2)) + F.pow(c["b"] - d["b"], F.lit(2)))
