"""Classification of layers and text lines by name, words and place."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import any_word, ascii_lower, casefold, fold, let, rlike, strip_ws


def _mentions(text: Column, words) -> Column:
    cond = F.lit(False)
    for word in words:
        short = len(word) <= 4 and word.isalpha()
        cond = cond | (rlike(text, rf"\b{re.escape(word)}\b") if short else F.contains(text, F.lit(word)))
    return cond


def _named(text: Column, confidence: float) -> Column:
    rules = F.coalesce(*[F.when(_mentions(text, words), F.lit(c)) for c, words in K.LAYER_NAME_RULES])
    category = F.when(any_word(text, K.SEAL_WORDS), "decoration").otherwise(rules)
    return F.when(
        (text != "") & category.isNotNull(),
        F.struct(category.alias("category"), F.lit(confidence).alias("confidence")),
    )


def category_by_name(name: Column, group_path: Column) -> Column:
    """Own name first (0.8); then the inner groups, the first path part ignored (0.6)."""
    inner = F.array_join(F.slice(F.split(F.coalesce(group_path, F.lit("")), "/"), 2, 10_000), "/")
    return F.coalesce(let(ascii_lower(name), lambda t: _named(t, 0.8)), let(ascii_lower(inner), lambda t: _named(t, 0.6)))


def generic_name(name: Column) -> Column:
    stripped = strip_ws(F.regexp_replace(ascii_lower(name), r"[\d\s]+", " "))
    cond = F.lit(False)
    for token in K.GENERIC_LAYER_NAMES:
        cond = cond | F.startswith(stripped, F.lit(token))
    return cond


def shape_class(x: Column, y: Column, w: Column, h: Column, cw: Column, ch: Column, opaque: Column) -> Column:
    """Place-based class; ``corner`` marks a logo candidate (only the first becomes one)."""
    share = (w * h) / F.greatest(F.lit(1), cw * ch).cast("double")
    cx, cy = F.try_divide(x + w / 2, cw), F.try_divide(y + h / 2, ch)
    aspect, tall = w / F.greatest(F.lit(1), h), F.try_divide(h, ch)
    corner = (share < 0.05) & ((cy < 0.22) | (cy > 0.85)) & ((cx < 0.32) | (cx > 0.68))
    return (
        F.when((share >= 0.92) & (opaque >= 0.85), "background")
        .when((aspect >= 2.5) & (tall < 0.22), "strip")
        .when(corner, "corner")
        .when(aspect.between(0.35, 2.4) & (tall >= 0.3) & (share <= 0.6), "product")
        .otherwise("decoration")
    )


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold(fold(name)), F.lit("([a-z0-9]+)"), F.lit(1)))


def asset_role(name: Column, kind: Column, is_group: Column) -> Column:
    """Role of a layer that may be frozen; null when it may not."""
    def lits(words):
        return F.array(*[F.lit(w) for w in words])

    tokens = F.array_except(name_tokens(name), lits(K.ASSET_DUPLICATE_TOKENS))
    return (
        F.when(F.lower(kind) == "type", F.lit(None).cast("string"))
        .when(F.arrays_overlap(tokens, lits(K.ASSET_EXCLUDED_TOKENS)), F.lit(None))
        .when(F.arrays_overlap(tokens, lits(K.ASSET_LOGO_TOKENS)), "logo")
        .when(is_group, F.lit(None))
        .when(F.arrays_overlap(tokens, lits(K.ASSET_BACKGROUND_TOKENS)), "fixed_background")
        .when(F.arrays_overlap(tokens, lits(K.ASSET_DECORATION_TOKENS)), "fixed_decoration")
    )


def line_category(text: Column, y: Column, height: Column, canvas_h: Column, tallest: Column) -> Column:
    """``STRUCT<category,confidence>`` of a recognised line."""
    t = strip_ws(text)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    low = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
    rel_h = height / F.greatest(F.lit(1), tallest)
    rel_y = (y + height / 2) / F.greatest(F.lit(1), canvas_h)
    price = rlike(t, K.LINE_PRICE) | (rlike(t, K.LINE_PERCENT) & (words <= 3))
    legal = (rel_h <= 0.45) & ((words >= 8) | any_word(low, K.LINE_LEGAL_WORDS) | (rel_y > 0.86))

    def out(category, confidence):
        return F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))

    return (
        F.when(price, out("price", 0.72))
        .when(any_word(low, K.LINE_CTA_WORDS) & (words <= 6), out("cta", 0.7))
        .when(legal, out("legal", 0.6))
        .when(rel_h >= 0.8, out("headline", 0.68))
        .when(rel_h >= 0.5, out("subheadline", 0.6))
        .otherwise(out("subheadline", 0.45))
    )


def document_roles(kind: Column, filename: Column, text: Column, has_fonts: Column, asset_roles: Column) -> Column:
    """Multi-label roles of a document from its kind and words."""
    hay = F.lower(F.concat(filename, F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 20_000)))
    layered = kind == "layered_design"
    early = [
        F.when((kind == "font") | has_fonts, "typography"),
        F.when(layered, "key_visual"),
        F.when(layered | kind.isin("image", "presentation"), "visual_reference"),
        F.when(layered & F.array_contains(asset_roles, "logo"), "logo"),
        F.when(layered & F.array_contains(asset_roles, "fixed_background"), "background"),
    ]
    words = let(hay, lambda h: F.array(*[F.when(any_word(h, ws), role) for role, ws in K.DOCUMENT_ROLE_WORDS]))
    roles = F.array_distinct(F.array_compact(F.concat(F.array(*early), words)))
    return F.when(F.size(roles) == 0, F.array(F.lit("other"))).otherwise(roles)
