"""Pieces of layered documents: frames, repeated texts, best piece, masters, logos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G
from ..functions.text import compact, is_price_text, rlike
from .skew import best_per_group, top_per_group
from .spatial import greedy_keep


def frames_or_pages(pages: DataFrame, images: DataFrame, doc: list[str], page: str = "page") -> DataFrame:
    """Framed images as pieces where a document has any, else its whole pages.

    ``pages``: ``doc, page, x, y, width, height``; ``images``: the same plus
    ``ord, xref, alpha``.
    """
    keys = [*doc, page]
    p = pages.select(*keys, *[F.col(c).alias(f"_p{c}") for c in ("x", "y", "width", "height")])
    d = images.where(~F.col("alpha") & (F.col("xref") > 0)).join(p, keys)
    inside = (
        (F.col("x") >= F.col("_px")) & (F.col("y") >= F.col("_py"))
        & (F.col("x") + F.col("width") <= F.col("_px") + F.col("_pwidth")) & (F.col("y") + F.col("height") <= F.col("_py") + F.col("_pheight")))
    share = F.col("width") * F.col("height") / (F.col("_pwidth") * F.col("_pheight"))
    shape = F.col("width") / F.col("height")
    fit = d.where(inside & share.between(*K.FRAME_RATIO) & (F.col("height") > 0) & shape.between(*K.FRAME_ASPECT))
    frames = greedy_keep(fit.select(*keys, "ord", "xref", "x", "y", "width", "height"), keys, [F.col("ord")], 0.5)
    framed = frames.select(*doc).distinct()
    art = pages.where((F.col("height") > 0) & (F.col("width") / F.col("height")).between(*K.FRAME_ASPECT)).join(framed, doc, "left_anti")
    art = art.join(images.select(*keys).distinct(), keys, "left_semi")
    whole = art.select(*keys, F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("xref"), "x", "y", "width", "height", F.lit("page").alias("kind"))
    out = frames.withColumn("kind", F.lit("frame")).withColumn("ord", F.col("ord").cast("bigint"))
    return out.select(*whole.columns).unionByName(whole)


def text_roles(texts: DataFrame, pieces: DataFrame, doc: list[str], piece: str = "piece_id") -> DataFrame:
    """``variable``, ``fixed`` or ``decoration`` for each text of a piece.

    ``pieces``: ``doc, piece_id, products``. A text is fixed when it stands in
    three pieces, or in two of which one has no product. Counting distinct
    pieces per text is a two-step aggregate.
    """
    d = texts.withColumn("_k", compact(F.col("text"))).where(F.col("_k") != "")
    per_piece = d.groupBy(*doc, piece, "_k").agg(F.count(F.lit(1)).alias("_times"))
    spread = per_piece.join(pieces.select(*doc, piece, "products"), [*doc, piece]).groupBy(*doc, "_k").agg(
        F.count(F.lit(1)).alias("_in"), F.bool_or(F.col("products") == 0).alias("_bare"))
    many = pieces.groupBy(*doc).agg((F.count(F.lit(1)) > 1).alias("_many"))
    j = d.join(per_piece, [*doc, piece, "_k"]).join(spread, [*doc, "_k"]).join(many, doc)
    digit = rlike(F.col("text"), r"\d")
    deco = F.col("rotated") | rlike(F.col("text"), K.SPACED_TEXT) | ((F.col("_times") >= 3) & ~digit)
    fixed = F.col("_many") & ~digit & ((F.col("_in") >= 3) | ((F.col("_in") >= 2) & F.col("_bare")))
    return j.select(*texts.columns, F.when(deco, "decoration").when(fixed, "fixed").otherwise("variable").alias("role"))


def best_pieces(pieces: DataFrame, doc: list[str]) -> DataFrame:
    """Best piece of each document and proportion family."""
    ok = ~F.col("catalog") & ((F.col("prices") > 0) | ((F.col("products") > 0) & (F.col("fields") > 0)))
    d = pieces.where(ok).withColumn("aspect", G.aspect_family(F.col("width").cast("int"), F.col("height").cast("int")))
    order = [F.when(F.col("products") > 0, 0).otherwise(1), F.when(F.col("prices") > 0, 0).otherwise(1),
             F.when(F.col("fields").between(2, 12), 0).otherwise(1), F.col("page"), F.col("x"), F.col("piece_id")]
    return best_per_group(d, [*doc, "aspect"], order, [*doc, "aspect", "piece_id", "page"])


def price_texts(c: Column) -> Column:
    return is_price_text(c, K.PRICE_TEXT)


def product_boxes(products: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Union of a piece's products cut to its frame, relative and scaled by ``scale``.

    Boxes are left/top/right/bottom; the frame comes as ``fx0..fy1``.
    """
    j = products.join(pieces.select(*keys, "fx0", "fy0", "fx1", "fy1", "scale"), keys)
    b = j.groupBy(*keys, "fx0", "fy0", "scale").agg(
        F.min(F.greatest("x0", "fx0")).alias("l"), F.min(F.greatest("y0", "fy0")).alias("t"),
        F.max(F.least("x1", "fx1")).alias("r"), F.max(F.least("y1", "fy1")).alias("b"))
    return b.select(*keys, *[
        G.rnd((F.col(c) - F.col(f)) * F.col("scale")).alias(n) for c, f, n in (("l", "fx0", "x0"), ("t", "fy0", "y0"), ("r", "fx0", "x1"), ("b", "fy0", "y1"))])


def scaled_reads(texts: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Variable texts as reads in pixels of the plate."""
    j = texts.join(pieces.select(*keys, "fx0", "fy0", "scale"), keys)
    return j.select(
        *keys, "ord", F.substring("text", 1, 200).alias("text"),
        *[G.rnd((F.col(c) - F.col(f)) * F.col("scale")).alias(c) for c, f in (("x0", "fx0"), ("y0", "fy0"), ("x1", "fx0"), ("y1", "fy0"))],
        F.bround(F.col("size") * F.col("scale"), 1).alias("size"), F.lit(1.0).alias("confidence"))


def master_arts(sources: DataFrame, keys: list[str], k: int = 2) -> DataFrame:
    """Sources a template plate is taken from: best role, square or upright first, two per campaign."""
    ranks = F.create_map(*[F.lit(v) for kv in K.PLATE_ROLE_RANK.items() for v in kv])
    best = F.array_min(F.transform("roles", lambda r: F.try_element_at(ranks, r)))
    late = F.col("kind").isin("pdf", "presentation") & F.col("page_count").between(1, 2) & ~F.array_contains("roles", "brand_manual")
    rank = F.coalesce(best, F.when(late, max(K.PLATE_ROLE_RANK.values()) + 1))
    shape = F.when(F.coalesce("height", F.lit(0)) > 0, F.col("width") / F.col("height")).otherwise(1.0)
    d = sources.where(F.col("kind").isin(*K.PLATE_KINDS)).withColumn("rank", rank).withColumn("shape", F.when(shape.between(0.5, 1.6), 0).otherwise(1))
    return top_per_group(d.where(F.col("rank").isNotNull()), keys, [F.col("rank"), F.col("shape"), F.col("ord")], k).select(*keys, "source_id", "rank", "shape", "rn")


def logos(sources: DataFrame, layer_assets: DataFrame, asset_files: DataFrame, keys: list[str]) -> DataFrame:
    """Logo of a campaign: source by source an isolated logo or a file so named; last, an image source with that role."""
    a = layer_assets.where(F.col("role") == "logo").select(*keys, "path", F.lit(0).alias("late"), "source_ord", F.lit(0).alias("stage"), "asset_ord")
    named = F.contains(F.lower(F.regexp_extract("path", r"([^/]+)$", 1)), F.lit("logo"))
    b = asset_files.where(named).select(*keys, "path", F.lit(0).alias("late"), "source_ord", F.lit(1).alias("stage"), "asset_ord")
    c = sources.where((F.col("kind") == "image") & F.array_contains("roles", "logo")).select(
        *keys, "path", F.lit(1).alias("late"), F.col("ord").alias("source_ord"), F.lit(2).alias("stage"), F.lit(0).alias("asset_ord"))
    every = a.unionByName(b).unionByName(c)
    return best_per_group(every, keys, [F.col(x) for x in ("late", "source_ord", "stage", "asset_ord")], [*keys, "path", "stage"])


def fixed_assets(candidates: DataFrame, sources: DataFrame, layer_assets: DataFrame, keys: list[str], k: int = K.FIXED_ASSET_LIMIT) -> DataFrame:
    """Frozen layers of the layered sources behind a candidate: background first, first eight."""
    ids = candidates.select(*keys, "candidate_id", F.posexplode("source_ids").alias("source_order", "source_id"))
    ids = ids.groupBy(*keys, "candidate_id", "source_id").agg(F.min("source_order").alias("source_order"))
    s = sources.where(F.col("kind") == "layered_design").select(*keys, "source_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    a = layer_assets.where(F.col("role").isin(*K.FIXED_ASSET_ROLES))
    j = ids.join(s, [*keys, "source_id"]).join(a, [*keys, "source_id"])
    w, h = F.col("_w"), F.col("_h")
    ok = (w > 0) & (h > 0) & (w.cast("bigint") * h <= K.MAX_SOURCE_PIXELS)
    j = j.where(ok).withColumn("b", G.clip_xy(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 0, 0, w, h)).where(F.col("b").isNotNull())
    role = F.when(F.col("role") == "fixed_background", 0).otherwise(1)
    top = top_per_group(j, [*keys, "candidate_id"], [role, F.col("source_order"), F.col("z_index"), F.col("name"), F.col("asset_id")], k)
    return top.select(*keys, "candidate_id", "rn", "asset_id", "role", "b.x0", "b.y0", "b.x1", "b.y1")


def layer_evidence(manifest: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of visible and text layers, logos, fixed backgrounds and decorations per source."""
    m = manifest.groupBy(*keys).agg(
        F.count_if("visible").alias("visible_layers"), F.count_if((F.col("kind") == "type") & (F.coalesce("text", F.lit("")) != "")).alias("text_layers"))
    a = assets.groupBy(*keys).agg(*[
        F.count_if(F.col("role") == r).alias(n) for r, n in (("logo", "logo_assets"), ("fixed_background", "fixed_backgrounds"), ("fixed_decoration", "fixed_decorations"))])
    return m.join(a, keys, "left").na.fill(0)
