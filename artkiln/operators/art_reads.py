"""Which field each line of an existing art is, and where it stood."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G
from ..functions.text import decompose, rlike
from .skew import many, top_per_group
from .spatial import free_band

# The slots in the order in which they take their line.
_CHAIN = ("logo", "legal", "validity", "discount", "installment", "previous_price", "price", "cta", "headline")


def _entries() -> Column:
    """Array over ``_CHAIN``: the value a line is ranked by for each slot it may fill, else null. Needs the marks of ``_marked``."""
    h = F.col("y1") - F.col("y0")
    high = F.try_divide(h, F.col("canvas_h"))
    low = (F.try_divide(F.col("y0"), F.col("canvas_h")) > 0.88) & (high < 0.035)
    by_order, tall, short = F.lit(0), -h, h
    rules = {
        "logo": (F.col("role") == "brand", by_order),
        "legal": (low | rlike(F.col("_text"), K.ART_LEGAL), short),
        "validity": ((high <= 0.05) & rlike(F.col("_text"), K.ART_VALIDITY), by_order),
        "discount": (rlike(F.col("_text"), K.ART_PERCENT), by_order),
        "installment": (rlike(F.col("_text"), K.ART_INSTALLMENT), by_order),
        "previous_price": (F.col("_before"), tall), "price": (F.col("_price"), tall),
        "cta": ((F.length("_text") <= 40) & rlike(F.col("_text"), K.ART_CTA), by_order),
        "headline": (F.lit(True), tall),
    }
    return F.array(*[F.when(rules[n][0], rules[n][1].cast("int")) for n in _CHAIN])


def _marked(live: DataFrame) -> DataFrame:
    """Each line with its plain text and what the price slots ask of it. Only lines with marks are decomposed; each pattern is tried once."""
    text = F.col("text")
    plain = F.when(F.length(text) != F.octet_length(text), decompose(text)).otherwise(text)
    d = live.withColumn("_text", plain).withColumn("_digit", rlike(F.col("_text"), r"\d"))
    d = d.withColumn("_before", F.col("_digit") & rlike(F.col("_text"), K.ART_BEFORE))
    return d.withColumn("_price", F.col("_digit") & (F.col("_before") | rlike(F.col("_text"), K.ART_MONEY) | rlike(F.col("_text"), K.ART_ONLY_FIGURE)))


def usable_reads(reads: DataFrame) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    canvas = F.col("canvas_w").cast("bigint") * F.col("canvas_h")
    return reads.where(
        (F.coalesce("confidence", F.lit(0.0)) >= K.ART_MIN_CONFIDENCE) & (w > 0) & (h > 0) & (w.cast("bigint") * h <= canvas * K.ART_MAX_FIELD))


def assign_slots(reads: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, slot, ord, x0..y1``: at most one line per slot and one slot per line.

    At most nine lines are taken before any choice, so the best ten lines per
    slot decide everything. They are ranked map-side before the shuffle and
    only those few meet in one row per art, which is used once: the lines
    below its headline join it there.
    """
    live = usable_reads(reads)
    d = _marked(live).select(*keys, "ord", "x0", "y0", "x1", "y1", F.posexplode(_entries()).alias("slot", "rank"))
    d = d.where(F.col("rank").isNotNull()).select(*keys, F.col("slot").cast("tinyint").alias("slot"), "rank", F.col("ord").cast("bigint").alias("ord"), "x0", "y0", "x1", "y1")
    few = top_per_group(d, [*keys, "slot"], [F.col("rank"), F.col("ord")], len(_CHAIN) + 1)
    packed = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "ord", "x0", "y0", "x1", "y1"))).alias("a"))
    item = "array<struct<slot:string,ord:bigint,x0:int,y0:int,x1:int,y1:int>>"
    start = F.struct(F.lit(-1).cast("tinyint").alias("slot"), F.array().cast("array<bigint>").alias("ords"), F.array().cast(item).alias("c"))
    names = F.array(*[F.lit(s) for s in _CHAIN])

    def take(acc, v):
        # Entries come slot by slot, best first: the first one whose line is still free fills the slot.
        free = (v["slot"] != acc["slot"]) & ((F.size(acc["ords"]) == 0) | ~F.array_contains(acc["ords"], v["ord"]))
        line = F.struct(F.get(names, v["slot"].cast("int")).alias("slot"), v["ord"].alias("ord"), *[v[c].cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])
        return F.when(free, F.struct(v["slot"].alias("slot"), F.concat(acc["ords"], F.array(v["ord"])).alias("ords"),
                                     F.concat(acc["c"], F.array(line)).alias("c"))).otherwise(acc)

    chosen = packed.select(*keys, F.aggregate("a", start, take).alias("_t")).select(*keys, "_t.c", "_t.ords")
    whole = _with_subheadline(chosen, live, keys)
    return whole.select(*keys, F.explode("c").alias("c")).select(*keys, "c.slot", "c.ord", "c.x0", "c.y0", "c.x1", "c.y1")


def _with_subheadline(chosen: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """The arts with the nearest free line just below their headline as one more line."""
    heads = chosen.withColumn("_hy", F.get(F.filter("c", lambda u: u["slot"] == "headline"), F.lit(0))["y1"])
    lines = live.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("ord").cast("bigint").alias("_ord"),
                        *[F.col(c).cast("int").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")], (F.col("canvas_h") * 0.10).alias("_near"))
    gap = F.col("_y0") - F.col("_hy")
    below = (gap >= 0) & (gap < F.col("_near")) & ~F.coalesce(F.array_contains("ords", F.col("_ord")), F.lit(False))
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    j = heads.join(many(lines), reduce(lambda a, b: a & b, same) & below, "left")
    sub = F.struct(F.lit("subheadline").alias("slot"), F.col("_ord").alias("ord"), *[F.col(f"_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    best = j.groupBy(*keys).agg(
        F.first("c").alias("c"), F.min_by(F.when(F.col("_y0").isNotNull(), sub), F.when(F.col("_y0").isNotNull(), F.struct("_y0", "_ord"))).alias("_s"))
    return best.select(*keys, F.when(F.col("_s").isNull(), F.col("c")).otherwise(F.concat("c", F.array("_s"))).alias("c"))


def slot_colours(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Colour each slot was written in, where it is a real hex colour."""
    slots = assign_slots(reads, keys)
    # The last read with the same box gives the colour.
    last = reads.groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.max_by("color", "ord").alias("color"))
    j = slots.join(last, [*keys, "x0", "y0", "x1", "y1"])
    return j.where(rlike(F.coalesce("color", F.lit("")), "^#[0-9a-fA-F]{6}$")).select(*keys, "slot", F.upper("color").alias("color"))


def art_placements(reads: DataFrame, keys: list[str], safe: Column) -> DataFrame:
    """Slot boxes, and the free band as the product's, in safe-area coordinates."""
    canvases = reads.select(*keys, "canvas_w", "canvas_h").distinct()
    boxes = reads.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    product = free_band(boxes, keys).withColumn("slot", F.lit("product"))
    box = [*keys, "slot", "x0", "y0", "x1", "y1", "canvas_w", "canvas_h"]
    j = assign_slots(reads, keys).join(canvases, keys).select(*box).unionByName(product.join(canvases, keys).select(*box))
    norm = G.normalise_to_safe(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("canvas_w"), F.col("canvas_h"), safe)
    return j.withColumn("p", norm).where(F.col("p").isNotNull()).select(
        *keys, G.aspect_family(F.col("canvas_w"), F.col("canvas_h")).alias("aspect"), "slot", "p.x", "p.y", "p.width", "p.height")
