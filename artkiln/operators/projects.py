"""Layers of art projects: usable sets, roles, twins, neighbours, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G
from ..functions import layers as L
from ..functions import sizes as S
from ..functions.text import rlike, strip_ws, without_copy_suffix
from .skew import best_per_group, bucketed_rank, with_group
from .spatial import box, box_pairs


def has_content() -> Column:
    return strip_ws(F.coalesce("content", F.lit(""))) != ""


def has_src() -> Column:
    return F.coalesce("src", F.lit("")) != ""


def usable(layers: DataFrame) -> DataFrame:
    """Visible layers a composition can use as they are."""
    ready = ((F.col("type") == "text") & has_content()) | ((F.col("type") == "image") & has_src())
    return layers.where(F.col("visible") & (F.col("category") != "background") & ready)


def template_layers(layers: DataFrame) -> DataFrame:
    """Layers that may enter a template; sort by ``z_index`` to read back to front."""
    return layers.where(F.col("visible") & (F.col("category") != "background") & ((F.col("type") == "image") | has_content()))


def planning_label() -> Column:
    """``working``, ``removed``, ``no_image``, ``empty_text`` or null; needs ``hidden`` ids."""
    hidden = F.array_contains("hidden", F.col("layer_id")) | ~F.col("visible")
    return (
        F.when(F.col("category") == "background", F.lit(None).cast("string"))
        .when(hidden, F.when(has_src() | has_content(), "removed"))
        .when((F.col("type") == "image") & ~has_src(), "no_image")
        .when((F.col("type") == "text") & ~has_content(), "empty_text")
        .otherwise("working"))


def erasable_boxes(manifest: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """Bounded content boxes that a new art may change. ``x0..y1``, ``canvas_w/h``."""
    live = manifest.where(F.coalesce("visible", F.lit(True))).join(frozen.select(*keys, "name").distinct(), [*keys, "name"], "left_anti")
    w, h = F.col("canvas_w"), F.col("canvas_h")
    cut = live.withColumn("b", G.clip_xy(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 0, 0, w, h)).where(F.col("b").isNotNull())
    bw, bh = F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0")
    scene = (bw / w >= K.ERASE_FULL_BLEED) & (bh / h >= K.ERASE_FULL_BLEED)
    ok = ~scene & (bw.cast("bigint") * bh <= w.cast("bigint") * h * K.ERASE_MAX_RATIO)
    return cut.where(ok).select(*keys, "ord", "b.x0", "b.y0", "b.x1", "b.y1")


def clip_to_canvas(boxes: DataFrame, smallest: int = K.GRID_MIN_SIDE) -> DataFrame:
    """Cut left/top/right/bottom boxes to the canvas; drop those left too small."""
    x0, y0 = F.greatest(F.lit(0), F.col("x0")), F.greatest(F.lit(0), F.col("y0"))
    w, h = F.least("canvas_w", "x1") - x0, F.least("canvas_h", "y1") - y0
    cut = boxes.select("*", x0.alias("x"), y0.alias("y"), w.alias("width"), h.alias("height"))
    return cut.where((F.col("width") >= smallest) & (F.col("height") >= smallest))


def manifest_reads(manifest: DataFrame) -> DataFrame:
    """Text layers as reads with boxes relative to their frame."""
    d = manifest.where((F.col("kind") == "type") & (strip_ws(F.coalesce("text", F.lit(""))) != "")
                       & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return d.select(
        *[c for c in d.columns if c not in ("text", "x0", "y0", "x1", "y1", "frame_x", "frame_y", "kind")],
        F.substring(strip_ws(F.col("text")), 1, 200).alias("text"),
        *[(F.col(c) - F.col(f)).alias(c) for c, f in (("x0", "frame_x"), ("y0", "frame_y"), ("x1", "frame_x"), ("y1", "frame_y"))],
        F.lit(1.0).alias("confidence"), F.lit("content").alias("role"))


def classify_by_geometry(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Place-based category; the first corner layer of a project is its logo."""
    shape = L.shape_class(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("canvas_w"), F.col("canvas_h"), F.col("opaque"))
    d = layers.withColumn("_shape", shape)
    d = with_group(d, keys, _first=F.min(F.when(F.col("_shape") == "corner", F.col("ord"))))
    s = F.col("_shape")
    logo = (s == "corner") & (F.col("ord") == F.col("_first"))
    return d.select(
        *layers.columns,
        F.when(s == "background", "background").when(logo, "logo").when(s == "product", "product").otherwise("decoration").alias("geo_category"),
        F.when(s == "background", 0.6).when(s == "strip", 0.45).when(logo, 0.45).when(s == "corner", 0.4).when(s == "product", 0.5)
        .otherwise(0.35).alias("geo_confidence"))


def classify_visual(detections: DataFrame, faces: DataFrame, keys: list[str]) -> DataFrame:
    """Detections to person, logo, product or decoration.

    A detection that holds the centre of a face is a person; the first corner
    one is the logo and the first large one that is not, the product.
    """
    centres = faces.select(
        *keys, F.col("ord").alias("face"), (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    dots = centres.select(*keys, F.col("face").alias("ord"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))
    p = box_pairs(detections.select(*keys, "ord", "x", "y", "width", "height"), dots, keys)
    people = p.where(
        (F.col("b_x") >= F.col("a_x")) & (F.col("b_x") <= F.col("a_x") + F.col("a_width"))
        & (F.col("b_y") >= F.col("a_y")) & (F.col("b_y") <= F.col("a_y") + F.col("a_height"))
    ).select(*keys, F.col("a_ord").alias("ord")).distinct().withColumn("_face", F.lit(True))
    d = detections.join(people, [*keys, "ord"], "left")
    w, h = F.col("canvas_w"), F.col("canvas_h")
    share = (F.col("width") * F.col("height")) / F.greatest(F.lit(1), w * h).cast("double")
    cx, cy = (F.col("x") + F.col("width") / 2) / w, (F.col("y") + F.col("height") / 2) / h
    aspect = F.col("width") / F.greatest(F.lit(1), F.col("height"))
    corner = ((cy < 0.18) | (cy > 0.88)) & ((cx < 0.3) | (cx > 0.7)) & (share < 0.06) & aspect.between(0.25, 6.0)
    free = F.col("_face").isNull()
    d = d.withColumn("_corner", free & corner).withColumn("_large", free & (share >= 0.05))
    d = with_group(d, keys, _logo=F.min(F.when(F.col("_corner"), F.col("ord"))))
    d = d.withColumn("_can", F.col("_large") & ~F.coalesce(F.col("ord") == F.col("_logo"), F.lit(False)))
    d = with_group(d, keys, _prod=F.min(F.when(F.col("_can"), F.col("ord"))))
    return d.select(
        *detections.columns,
        F.when(~free, "person").when(F.col("ord") == F.col("_logo"), "logo").when(F.col("ord") == F.col("_prod"), "product")
        .otherwise("decoration").alias("visual"))


def under_zone(layers: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Visible content layers with 35 % or more of themselves under the zone (``zx..zh`` fractions)."""
    z = zones.select(*keys, *[F.col(c) for c in ("zx", "zy", "zw", "zh")])
    d = layers.where(F.col("visible") & ~F.col("category").isin("background", "product", "decoration")).join(z, keys)
    w, h = F.greatest(F.lit(1), F.col("canvas_w")), F.greatest(F.lit(1), F.col("canvas_h"))
    x0, y0 = F.col("zx") * w, F.col("zy") * h
    cw = F.least(x0 + F.col("zw") * w, F.col("x") + F.col("width")) - F.greatest(x0, F.col("x"))
    ch = F.least(y0 + F.col("zh") * h, F.col("y") + F.col("height")) - F.greatest(y0, F.col("y"))
    own = F.greatest(F.lit(1), F.col("width") * F.col("height"))
    return d.where((cw > 0) & (ch > 0) & (cw * ch / own >= K.ZONE_CLASH)).select(*keys, "ord", "name")


def product_neighbours(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Compact images with a generic name beside a confirmed product."""
    live = layers.where(F.col("visible") & ~F.coalesce("external", F.lit(False)))
    anchors = live.where(F.col("category") == "product").select(*keys, "ord", "x", "y", "width", "height")
    aspect = F.col("width") / F.greatest(F.lit(1), F.col("height"))
    share = F.col("width") * F.col("height") / F.greatest(F.lit(1), F.col("canvas_w") * F.col("canvas_h"))
    generic = live.where(
        (F.col("type") == "image") & (F.col("category") == "decoration") & rlike(F.lower(strip_ws(F.col("name"))), r"^(capa|layer)\s*\d+")
        & aspect.between(0.45, 2.4) & share.between(0.015, 0.25))
    reach = F.greatest(F.lit(12), (F.least("canvas_w", "canvas_h") * 0.04).cast("int"))
    g = generic.select(*keys, "ord", "layer_id", "x", "y", "width", "height", reach.alias("reach"))
    p = box_pairs(g, anchors, keys, pad=F.col("reach"))
    dx, dy = G.gap(box("a_"), box("b_"))
    return p.where((dx <= F.col("a_reach")) & (dy <= F.col("a_reach"))).select(*keys, F.col("a_layer_id").alias("layer_id")).distinct()


def replacement_target(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Image to replace: a product first, then the largest."""
    d = layers.where((F.col("type") == "image") & (F.col("category") != "background") & F.col("replaceable"))
    order = [F.when(F.col("category") == "product", 0).otherwise(1), -F.col("width").cast("bigint") * F.col("height"), F.col("ord")]
    return best_per_group(d, keys, order, [*keys, "layer_id", "category"])


def twins(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Layers of two projects paired by category and rank from back to front."""
    order, bucket = [F.col("z_index"), F.col("ord")], F.floor(F.col("z_index") / 64)
    a = bucketed_rank(source, [*keys, "category"], bucket, order, "rank").select(*keys, "category", "rank", F.col("layer_id").alias("source_layer"))
    b = bucketed_rank(target, [*keys, "category"], bucket, order, "rank").select(*keys, "category", "rank", F.col("layer_id").alias("target_layer"))
    return a.join(b, [*keys, "category", "rank"], "left")


def propagate_roles(layers: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """Role by exact layer name, else by a name without copy suffix when only one fits."""
    exact = roles.select(*keys, F.col("name"), F.col("role").alias("_exact"))
    norm = F.lower(without_copy_suffix(F.col("name")))
    near = roles.withColumn("_n", norm).where(F.col("_n") != "").groupBy(*keys, "_n").agg(
        F.count_distinct("name").alias("_c"), F.min("role").alias("_near")).where(F.col("_c") == 1)
    j = layers.withColumn("_n", norm).join(exact, [*keys, "name"], "left").join(near.drop("_c"), [*keys, "_n"], "left")
    return j.select(*layers.columns, F.coalesce("_exact", "_near").alias("role"))


def override_actions(layers: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-batch texts against layers: apply, restore, unknown; unchanged ones are left out."""
    w = wanted.where(strip_ws(F.col("new_text")) != "").select(*keys, "layer_id", "new_text")
    l = layers.select(*keys, "layer_id", "current", "rewritten").withColumn("_l", F.lit(True))
    j = l.join(w, [*keys, "layer_id"], "full_outer")
    action = (
        F.when(F.col("_l").isNull(), "unknown")
        .when(F.col("new_text").isNull() & F.col("rewritten"), "restore")
        .when(F.col("new_text").isNotNull() & (F.col("current") != strip_ws(F.col("new_text"))), "apply"))
    return j.withColumn("action", action).where(F.col("action").isNotNull()).select(*keys, "layer_id", "action", "new_text")


def values_to_layers(rows: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """Row texts written to the layers of the category they belong to."""
    long = rows.select(*keys, F.expr(
        "stack(3, 'headline', titular, 'price', precio_actual, 'cta', cta) as (category, content)"
    )).where(F.coalesce("content", F.lit("")) != "")
    return layers.select(*keys, "layer_id", "category").join(long, [*keys, "category"])


def snapshot(saved: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """Saved placements over current layers; a layer that is gone drops out."""
    l = layers.select(*keys, "layer_id", F.col("content").alias("_content"), F.col("color").alias("_color"), F.col("font").alias("_font"))
    j = saved.join(l, [*keys, "layer_id"])

    def pick(c):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c)

    return j.select(*[c for c in saved.columns if c not in ("content", "color", "font")],
                    F.coalesce("content", "_content").alias("content"), pick("color"), pick("font"),
                    (F.coalesce("color", F.lit("")) == "").alias("auto_contrast"))


def numbered_names(df: DataFrame, keys: list[str], base: str, order: list[Column], bucket: Column, sep: str = " ", out: str = "unique_name") -> DataFrame:
    """``name``, ``name 2``, ``name 3`` ... in order."""
    d = bucketed_rank(df, [*keys, base], bucket, order, "_n")
    return d.withColumn(out, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws(sep, F.col(base), F.col("_n").cast("string")))).drop("_n")


def worth_measuring(layers: DataFrame, keys: list[str]) -> DataFrame:
    """Product size of each product layer: its own names, else the art's copy when it is the only product."""
    text = artwork_text(layers, keys)
    lone = layers.where((F.col("category") == "product") & F.col("visible")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = layers.where(F.col("category") == "product").join(text, keys, "left").join(lone, keys, "left")
    own = S.family(F.col("replaced_from"), F.col("name"), F.col("source_name"))
    art = F.when(F.col("_n") == 1, S.family(F.col("art_text")))
    key = F.coalesce(own, art)
    size = S.measure_as(key, F.col("replaced_from"), F.col("name"), F.col("source_name"), F.col("art_text"))
    return d.select(*keys, "ord", key.alias("family_key"), F.when(own.isNotNull(), "nombre").when(art.isNotNull(), "arte").alias("source"),
                    size["height_cm"].alias("height_cm"), size["family"].alias("family"))


def artwork_text(layers: DataFrame, keys: list[str]) -> DataFrame:
    """All copy of an art in layer order, as one text. The text is the result, one per art."""
    t = strip_ws(F.coalesce("content", F.lit("")))
    d = layers.where((F.col("type") == "text") & has_content()).withColumn("_t", t)
    parts = F.array_sort(F.collect_list(F.struct("ord", "_t")))
    return d.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["_t"]), " · ").alias("art_text"))


def paragraphs(lines: DataFrame, keys: list[str], block: int = 65_536) -> DataFrame:
    """Consecutive lines to blocks; tells wrapped prose from separate facts.

    Needs ``ord, top, bottom, span, r, g, b``. A new block starts at a large
    gap, another text size or another colour. Lines travel with each value
    once, and in stretches of ``block`` pixels that hold thousands of lines,
    so that the rows between stretches are few.
    """
    from .skew import bucketed_before

    h = F.col("bottom") - F.col("top") + 1
    d = lines.select(*keys, "ord", "top", "span", F.struct("bottom", h.alias("h"), "r", "g", "b").alias("_l"))
    order, bucket = [F.col("top"), F.col("ord")], F.floor(F.col("top") / block)
    d = bucketed_before(d, keys, bucket, order, {"_p": ("last", "_l")})
    tall, short = F.greatest("_p.h", "_l.h"), F.greatest(F.lit(1), F.least("_p.h", "_l.h"))
    dist = F.sqrt(sum((F.pow(F.col(f"_p.{c}") - F.col(f"_l.{c}"), F.lit(2)) for c in "rgb"), F.lit(0.0)))
    apart = (F.col("top") - F.col("_p.bottom") - 1 > tall * 0.9) | (tall / short > 1.3) | (dist > 70.0)
    d = d.select(*keys, "ord", "top", "span", F.col("_l.h").alias("h"), F.when(F.col("_p.h").isNull() | apart, 1).otherwise(0).alias("_cut"))
    d = bucketed_before(d, keys, bucket, order, {"_cuts": ("sum", "_cut")})
    d = d.withColumn("block", (F.coalesce("_cuts", F.lit(0)) + F.col("_cut")).cast("int"))
    g = d.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("lines"), F.max("h").alias("_hi"), F.min("h").alias("_lo"), F.max("span").alias("_wide"),
        F.max(F.struct("top", "ord")).alias("_end"))
    rest = d.join(g, [*keys, "block"]).where(F.struct("top", "ord") < F.col("_end")).groupBy(*keys, "block").agg(
        F.min(F.col("span") / F.col("_wide")).alias("_fill"))
    j = g.join(rest, [*keys, "block"], "left")
    same = F.col("_hi") <= F.col("_lo") * 1.15
    full = F.coalesce(F.col("_fill") >= 0.85, F.lit(True))
    return j.select(*keys, "block", "lines", ((F.col("lines") < 2) | (same & full)).alias("is_paragraph"))


def runs(rows: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """Stretches of consecutive marked positions ``y`` as ``start, stop``."""
    from .skew import bucketed_before

    marked = rows.where(F.col("ink")).select(*keys, "y")
    order, bucket = [F.col("y")], F.floor(F.col("y") / block)
    d = bucketed_before(marked, keys, bucket, order, {"_p": ("last", F.col("y"))})
    d = d.withColumn("_cut", F.when(F.col("_p").isNull() | (F.col("y") > F.col("_p") + 1), 1).otherwise(0)).select(*keys, "y", "_cut")
    d = bucketed_before(d, keys, bucket, order, {"_cuts": ("sum", F.col("_cut"))})
    run = F.coalesce("_cuts", F.lit(0)) + F.col("_cut")
    return d.groupBy(*keys, run.alias("run")).agg(F.min("y").alias("start"), F.max("y").alias("stop"))


def valid_bijection(answers: DataFrame, expected: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Groups whose answer names every index once with an allowed category."""
    a = answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"),
        F.bool_and(F.coalesce(F.col("category").isin(*categories), F.lit(False))).alias("ok"))
    j = expected.join(a, keys, "left")
    valid = (F.col("n") == F.col("expected")) & (F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & F.col("ok")
    return j.select(*keys, "expected", F.coalesce(valid, F.lit(False)).alias("valid"))
