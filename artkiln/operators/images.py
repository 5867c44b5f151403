"""Aggregates over a long ``pixels(image_id, x, y, r, g, b, a)`` table.

Every measure is a plain aggregate, so a huge image is combined map-side like
any other group. Palettes and dominant colours also take distinct colours with
their count ``n``, and signatures the cell sums that ``sources.pixels`` makes
of strips of raw bytes, so that large pictures need no row per pixel.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import color as C
from ..session import staged
from .skew import many, top_per_group, with_group

BAND_BITS, BANDS = 16, 16
#: Distinct pictures of a scope with one band value, above which the value alone is no meeting point.
HOT_BAND = 1000
#: Looks of a scope that each look meets first.
BUCKET = 512
LOOK = ["h0", "h1", "h2", "h3", "mean_r", "mean_g", "mean_b", "aspect"]


def rgb() -> Column:
    return F.struct("r", "g", "b")


def _count(pixels: DataFrame) -> Column:
    """Pixels of a group: rows, or the counts ``n`` of a table of distinct colours."""
    return F.sum("n") if "n" in pixels.columns else F.count(F.lit(1))


def _total(pixels: DataFrame, value: str) -> Column:
    return F.sum(F.col(value) * F.col("n") if "n" in pixels.columns else F.col(value))


def grey() -> Column:
    """Luma with the usual integer weights of image libraries."""
    return F.floor((F.col("r") * 19595 + F.col("g") * 38470 + F.col("b") * 7471 + 0x8000) / 65536).cast("int")


def palette(pixels: DataFrame, keys: list[str], k: int = 6, shift: int = 4) -> DataFrame:
    """Most frequent colour bins, near-white, near-black and greys dropped, first ``k``."""
    half = (1 << shift) >> 1

    def binned(c):
        return F.expr(f"(({c} >> {shift}) << {shift}) + {half}")

    counts = pixels.groupBy(*keys, *[binned(c).alias(c) for c in "rgb"]).agg(_count(pixels).alias("n"))
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    light = (F.col("r") + F.col("g") + F.col("b")) / 3
    plain = (light > 244) | (light < 14) | ((spread < 12) & (light > 40) & (light < 225))
    kept = top_per_group(counts.where(~plain), keys, [F.col("n").desc(), F.col("r"), F.col("g"), F.col("b")], k)
    return kept.select(*keys, "rn", C.rgb_to_hex(rgb()).alias("colour"), "n")


def campaign_palette(pixels: DataFrame, previews: DataFrame, keys: list[str], most: int = 8, **limits) -> DataFrame:
    """Palette of the first ``most`` previews (``image_id, ord``) of a campaign; the pixels of other pictures are left before the count."""
    shown = top_per_group(previews.select(*keys, "image_id", "ord"), keys, [F.col("ord"), F.col("image_id")], most, "_at").select(*keys, "image_id")
    return palette(pixels.join(shown, "image_id"), keys, **limits)


def dominant_bins(pixels: DataFrame, keys: list[str], k: int = 5, shift: int = 5) -> DataFrame:
    """Average colour of the ``k`` fullest colour bins of each image."""
    bins = [F.expr(f"{c} >> {shift}").alias(f"_{c}") for c in "rgb"]
    counts = pixels.groupBy(*keys, *bins).agg(_count(pixels).alias("n"), *[(_total(pixels, c) / _count(pixels)).alias(c) for c in "rgb"])
    top = top_per_group(counts, keys, [F.col("n").desc(), F.col("_r"), F.col("_g"), F.col("_b")], k)
    return top.select(*keys, "rn", "n", *[F.bround(c, 0).cast("int").alias(c) for c in "rgb"])


def brand_and_support(dominant: DataFrame, keys: list[str]) -> DataFrame:
    """Brand colour: the most saturated when saturated enough, else the first; support: the darkest other."""
    d = dominant.withColumn("hex", C.rgb_to_hex(rgb())).withColumn("_s", C.saturation(rgb())).withColumn("_l", C.luminance(rgb()))
    p = d.groupBy(*keys).agg(
        F.max_by(F.struct("hex", "_s"), F.struct("_s", -F.col("rn"))).alias("m"), F.min_by("hex", "rn").alias("f"))
    p = p.select(*keys, F.when(F.col("m._s") >= 0.22, F.col("m.hex")).otherwise(F.col("f")).alias("brand"))
    j = d.join(p, keys)
    other = F.col("hex") != F.col("brand")
    s = j.groupBy(*keys).agg(
        F.first("brand").alias("brand"),
        F.coalesce(F.min_by(F.when(other, F.col("hex")), F.when(other, F.struct("_l", "rn"))), F.min_by("hex", F.struct("_l", "rn"))).alias("support"))
    return s


def cluster_colours(pixels: DataFrame, keys: list[str], k: int = 5, rounds: int = 8, shift: int = 4) -> DataFrame:
    """The ``k`` dominant colours of each image: weighted k-means from its fullest colour bins, fullest cluster first.

    An image crosses the shuffle as its colour bins, 4,096 at most with four
    bits left of a channel, so the rounds fold one bounded row per image. Bins
    and centres stand for the floor of their mean, a bin goes to the first of
    its nearest centres, and a centre without bins stays where it is. So the
    answer is exact. Clusters that stay without pixels are left out; a picture
    of fewer bins has fewer clusters.
    """
    sums = pixels.groupBy(*keys, *[F.expr(f"{c} >> {shift}").alias(f"_{c}") for c in "rgb"]).agg(_count(pixels).alias("n"), *[_total(pixels, c).cast("bigint").alias(f"s{c}") for c in "rgb"])
    one = F.struct((-F.col("n")).alias("o"), *[F.col(f"_{c}") for c in "rgb"], "n", *[F.col(f"s{c}") for c in "rgb"], *[F.expr(f"s{c} div n").alias(c) for c in "rgb"])
    d = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_bins"))

    def dealt(centres: Column) -> Column:
        def nearest(x: Column) -> Column:
            far = F.transform(centres, lambda c, i: F.struct(sum(((x[h] - c[h]) * (x[h] - c[h]) for h in "rgb"), F.lit(0).cast("bigint")).alias("d"), i.alias("i")))
            return F.struct(F.array_min(far)["i"].alias("i"), x["n"].alias("n"), *[x[f"s{h}"].alias(f"s{h}") for h in "rgb"])

        return F.transform("_bins", nearest)

    def moved(centres: Column) -> Column:
        def centre(c: Column, i: Column, own: Column) -> Column:
            total = F.aggregate(F.filter(own, lambda x: x["i"] == i), F.struct(*[F.lit(0).cast("bigint").alias(h) for h in ("n", "sr", "sg", "sb")]),
                                lambda t, x: F.struct(*[(t[h] + x[h]).alias(h) for h in ("n", "sr", "sg", "sb")]))
            return F.transform(F.array(total), lambda t: F.when(t["n"] == 0, F.struct(*[c[h].alias(h) for h in "rgb"], F.lit(0).cast("bigint").alias("n"))).otherwise(
                F.struct(*[F.floor(t[f"s{h}"] / t["n"]).cast("bigint").alias(h) for h in "rgb"], t["n"].alias("n"))))[0]

        return F.transform(F.array(dealt(centres)), lambda own: F.transform(centres, lambda c, i: centre(c, i, own)))[0]

    start = F.transform(F.slice("_bins", 1, k), lambda x: F.struct(*[x[h].alias(h) for h in "rgb"], F.lit(0).cast("bigint").alias("n")))
    d = d.select(*keys, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda c, _: moved(c)).alias("_c"))
    full = F.filter(F.array_sort(F.transform("_c", lambda c, i: F.struct((-c["n"]).alias("o"), i.alias("i"), *[c[h].cast("int").alias(h) for h in "rgb"], c["n"].alias("n")))), lambda c: c["n"] > 0)
    return d.select(*keys, F.posexplode(full).alias("_p", "_x")).select(*keys, (F.col("_p") + 1).alias("rn"), F.col("_x.n").alias("n"), *[F.col(f"_x.{h}") for h in "rgb"])


def _in_boxes(pixels: DataFrame, boxes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Pixels inside boxes through square tiles of ``size``; a box is cut to tiles, then tested exactly."""
    t = F.lit(size)

    def span(a, n):
        return F.sequence(F.floor(F.col(a) / t), F.floor((F.col(a) + F.col(n) - 1) / t))

    b = boxes.where((F.col("width") > 0) & (F.col("height") > 0)).select(
        "*", F.explode(span("x", "width")).alias("_tx")).select("*", F.explode(span("y", "height")).alias("_ty"))
    b = b.select(*keys, "_tx", "_ty", F.col("ord"), *[F.col(c).alias(f"_b{c}") for c in ("x", "y", "width", "height")],
                 *[c for c in b.columns if c not in (*keys, "_tx", "_ty", "ord", "x", "y", "width", "height")])
    p = pixels.withColumn("_tx", F.floor(F.col("x") / t)).withColumn("_ty", F.floor(F.col("y") / t))
    j = p.join(b, [*keys, "_tx", "_ty"])
    inside = (
        (F.col("x") >= F.col("_bx")) & (F.col("x") < F.col("_bx") + F.col("_bwidth"))
        & (F.col("y") >= F.col("_by")) & (F.col("y") < F.col("_by") + F.col("_bheight")))
    return j.where(inside)


def region_stats(pixels: DataFrame, boxes: DataFrame, keys: list[str], tile: int = 64) -> DataFrame:
    """Mean colour and luma deviation under each box."""
    g = grey().cast("double")
    return _in_boxes(pixels, boxes, keys, tile).groupBy(*keys, "ord").agg(
        *[F.bround(F.avg(c), 0).cast("int").alias(c) for c in "rgb"], F.stddev_pop(g).alias("deviation"), F.count(F.lit(1)).alias("pixels"))


def text_background(pixels: DataFrame, boxes: DataFrame, keys: list[str], tile: int = 64) -> DataFrame:
    """Mean colour under a text, its own ink left out; ``color`` is the text's hex colour.

    Fewer than four far pixels (twelve channel values) -> all pixels count.
    """
    j = _in_boxes(pixels, boxes, keys, tile).withColumn("_far", C.distance(rgb(), C.hex_to_rgb(F.col("color"))) > 70)
    agg = []
    for c in "rgb":
        agg += [F.avg(F.when(F.col("_far"), F.col(c))).alias(f"f{c}"), F.avg(c).alias(f"a{c}")]
    g = j.groupBy(*keys, "ord").agg(F.count_if("_far").alias("far"), F.first("color").alias("color"), *agg)
    return g.select(*keys, "ord", "color", *[
        F.bround(F.when(F.col("far") * 3 < 12, F.col(f"a{c}")).otherwise(F.col(f"f{c}")), 0).cast("int").alias(c) for c in "rgb"])


def uniformity(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of pixels near the median colour, real transparency, subject share.

    The median of a channel comes from its 256-bin histogram, so no task ever
    holds the values of a whole image.
    """
    med = None
    for c in "rgb":
        m = _channel_median(pixels, keys, c)
        med = m if med is None else med.join(m, keys)
    d = pixels.join(med, keys)
    near = C.distance(rgb(), F.struct(F.col("m_r").alias("r"), F.col("m_g").alias("g"), F.col("m_b").alias("b"))) <= 20.0
    g = d.groupBy(*keys).agg(F.avg(near.cast("int")).alias("near"), (F.min("a") < 255).alias("has_alpha"), F.avg((F.col("a") > 8).cast("int")).alias("subject"))
    return g.withColumn("is_uniform", F.col("near") >= 0.97)


def _channel_median(pixels: DataFrame, keys: list[str], c: str) -> DataFrame:
    bins = pixels.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n"))
    bins = with_group(bins, keys, _t=F.sum("n"))
    w = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_upto", F.sum("n").over(w))
    lo, hi = F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)
    return bins.groupBy(*keys).agg(
        ((F.min(F.when(F.col("_upto") > lo, F.col(c))) + F.min(F.when(F.col("_upto") > hi, F.col(c)))) / 2).alias(f"m_{c}"))


def mask_boxes(pixels: DataFrame, keys: list[str], threshold: int = 8) -> DataFrame:
    return pixels.where(F.col("a") > threshold).groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def still_flattened(original: DataFrame, plate: DataFrame, layers: DataFrame, keys: list[str], tile: int = 64) -> DataFrame:
    """Layers whose pixels the background still holds: mean difference under 8."""
    p = plate.select(*keys, "x", "y", *[F.col(c).alias(f"p_{c}") for c in "rgb"])
    diff = (F.abs(F.col("r") - F.col("p_r")) + F.abs(F.col("g") - F.col("p_g")) + F.abs(F.col("b") - F.col("p_b"))) / 3.0
    j = original.join(p, [*keys, "x", "y"]).select(*keys, "x", "y", diff.alias("diff"))
    wanted = layers.where(~F.col("category").isin("background", "product", "person"))
    return _in_boxes(j, wanted, keys, tile).groupBy(*keys, "ord").agg(F.avg("diff").alias("difference")).withColumn(
        "flattened", F.col("difference") < K.PLATE_SAME_PIXELS)


def signatures(pixels: DataFrame, keys: list[str], cols: int = 16, rows: int = 16) -> DataFrame:
    """Difference hash of a (cols+1) x rows grey grid, mean colour and proportion.

    Bits run row by row, a bit is set where a cell is brighter than its right
    neighbour; they fill four 64-bit words, first bit highest.
    """
    size = pixels.groupBy(*keys).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"), *[F.floor(F.avg(c)).cast("int").alias(f"mean_{c}") for c in "rgb"])
    d = many(pixels.select(*keys, "x", "y", grey().alias("_grey"))).join(size.select(*keys, "_w", "_h"), keys)
    cells = d.groupBy(*keys, F.floor(F.col("y") * rows / F.col("_h")).cast("int").alias("_gy"), F.floor(F.col("x") * (cols + 1) / F.col("_w")).cast("int").alias("_gx")).agg(
        F.bround(F.avg("_grey"), 0).cast("int").alias("_v"))
    return _hashed(size, cells, keys, cols)


def signatures_of_sums(sums: DataFrame, cells: DataFrame, keys: list[str], cols: int = 16) -> DataFrame:
    """The same signatures from totals of strips (``w, h, n, sum_r, sum_g, sum_b`` and, per cell, ``gy, gx, grey, n``)."""
    size = sums.select(*keys, F.col("w").alias("_w"), F.col("h").alias("_h"), *[F.floor(F.col(f"sum_{c}") / F.col("n")).cast("int").alias(f"mean_{c}") for c in "rgb"])
    merged = cells.groupBy(*keys, F.col("gy").alias("_gy"), F.col("gx").alias("_gx")).agg(F.bround(F.sum("grey") / F.sum("n"), 0).cast("int").alias("_v"))
    return _hashed(size, merged, keys, cols)


def _hashed(size: DataFrame, cells: DataFrame, keys: list[str], cols: int) -> DataFrame:
    # A line of cells is short, and its pixels are together already: a window asks no join of the cells with themselves.
    right = F.lead(F.struct("_gx", "_v")).over(Window.partitionBy(*keys, "_gy").orderBy("_gx"))
    bits = cells.withColumn("_right", right).where((F.col("_right._gx") == F.col("_gx") + 1) & (F.col("_v") > F.col("_right._v")))
    bits = bits.withColumn("_i", F.col("_gy") * cols + F.col("_gx"))
    words = []
    for n in range(4):
        one = F.expr("shiftleft(1L, cast(63 - _i % 64 as int))")
        words.append(F.coalesce(F.bit_or(F.when(F.floor(F.col("_i") / 64) == n, one)), F.lit(0).cast("bigint")).alias(f"h{n}"))
    h = bits.groupBy(*keys).agg(*words)
    out = many(size).join(h, keys, "left").na.fill(0, ["h0", "h1", "h2", "h3"])
    return out.select(*keys, "h0", "h1", "h2", "h3", "mean_r", "mean_g", "mean_b", F.bround(F.col("_w") / F.col("_h"), 2).alias("aspect"))


def hamming(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}h{i}").bitwiseXOR(F.col(f"{b}h{i}"))) for i in range(4)), F.lit(0))


def _near(c: Column) -> Column:
    return F.array(c - 1, c, c + 1)


def _bands(df: DataFrame, probes: bool) -> DataFrame:
    """Sixteen 16-bit bands; with ``probes`` also every band value one bit away."""
    bands = [F.struct(F.lit(w * 4 + p).alias("i"), F.expr(f"cast(shiftrightunsigned(h{w}, {48 - 16 * p}) & 65535 as int)").alias("v"))
             for w in range(4) for p in range(4)]
    d = df.withColumn("_b", F.explode(F.array(*bands)))
    if probes:
        flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(BAND_BITS)])
        return d.withColumn("_i", F.col("_b.i")).withColumn("_v", F.explode(F.transform(flips, lambda m: F.col("_b.v").bitwiseXOR(m)))).drop("_b")
    return d.withColumn("_i", F.col("_b.i")).withColumn("_v", F.col("_b.v")).drop("_b")


def _alike(bits: int, colour: int, aspect: float) -> Column:
    """Whether the looks of the ``a_`` and the ``b_`` columns are near."""
    means = F.greatest(*[F.abs(F.col(f"a_mean_{c}") - F.col(f"b_mean_{c}")) for c in "rgb"])
    return (hamming("a_", "b_") <= bits) & (means <= colour) & (F.bround(F.abs(F.col("a_aspect") - F.col("b_aspect")), 6) <= aspect)


def _elsewhere() -> Column:
    """Whether a ``b_`` look also occurs outside the one piece of the ``a_`` look."""
    return (F.col("a_lo") != F.col("b_lo")) | (F.col("a_lo") != F.col("b_hi"))


def _sides(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides of a join with their columns named apart, and that their ``keys`` are equal."""
    left, right = (d.select(*[F.col(c).alias(side + c) for c in d.columns]) for d, side in ((a, "a_"), (b, "b_")))
    return many(left), right, functools.reduce(operator.and_, [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys])


def similar_signatures(sigs: DataFrame, scope: list[str], bits: int = K.NEAR_DUPLICATE_BITS, colour: int = K.NEAR_DUPLICATE_COLOUR,
                       aspect: float = K.NEAR_DUPLICATE_ASPECT, among: DataFrame | None = None) -> DataFrame:
    """Pairs of distinct signatures of a scope that look alike (``a_sig`` < ``b_sig``).

    At distance 24 or less, at least four of sixteen bands differ by one bit at
    most. Meeting on a band value or a value one bit away therefore finds every
    pair even if a picture looks in its thirteen rarest bands only, so plain
    rows, which many pictures share, are left out where others tell them apart.
    Values of more than ``HOT_BAND`` pictures that remain are met by cells of
    the mean colour and neighbouring proportion steps: the asking side looks
    into all cells around, the other has one row per band. ``sig`` must name
    each distinct signature once: copies are folded before the join.

    With ``among`` (signatures of a scope with the range ``lo``, ``hi`` of their
    pieces) no pairs are listed: the signatures of ``sigs``, each of the one
    piece ``lo``, that look like one of ``among`` that is also elsewhere. A
    look-up ends at the first that it finds.
    """
    asking = sigs.select(*scope, "sig", *LOOK, *([] if among is None else ["lo"]))
    others = asking if among is None else among.select(*scope, *LOOK, "lo", "hi")
    index = _bands(others, False)
    held = index.groupBy(*scope, "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    # Of the bands of a pair, at most bits / 2 differ by two bits or more: each picture can do without as many as are left over, less one.
    needed = min(BANDS, bits // 2 + 1)
    probes = many(_bands(asking, True)).join(held, [*scope, "_i", "_v"])
    probes = probes.withColumn("_cost", F.sum("_n").over(Window.partitionBy(*scope, "sig", "_i")))
    probes = probes.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*scope, "sig").orderBy("_cost", "_i"))).where(F.col("_rank") <= needed)
    # A value that very many pictures hold is met by cells of the mean colour and steps of the proportion.
    hot = F.col("_n") > HOT_BAND
    step = F.floor(F.col("aspect") / (aspect * 1.01) + 1e-9)
    cell = [F.floor(F.col(f"mean_{c}") / (colour + 1)).cast("int") for c in "rgb"]

    def code(r: Column, g: Column, b: Column) -> Column:
        return r * 10000 + g * 100 + b

    def where_hot(here: Column) -> Column:
        return F.when(hot, here).otherwise(F.array(F.lit(0).cast("bigint")))

    around = F.flatten(F.flatten(F.transform(_near(cell[0]), lambda r: F.transform(_near(cell[1]), lambda g: F.transform(_near(cell[2]), lambda b: code(r, g, b).cast("bigint"))))))
    left = probes.withColumn("_a", F.explode(where_hot(_near(step)))).withColumn("_c", F.explode(where_hot(around))).drop("_n", "_cost", "_rank")
    right = many(index).join(held, [*scope, "_i", "_v"]).withColumn("_a", where_hot(F.array(step))[0]).withColumn("_c", where_hot(F.array(code(*cell).cast("bigint")))[0]).drop("_n")
    a, b, same = _sides(left, right, [*scope, "_i", "_v", "_a", "_c"])
    near = _alike(bits, colour, aspect)
    if among is not None:
        return a.join(b, same & _elsewhere() & near, "left_semi").select(*[F.col(f"a_{c}").alias(c) for c in (*scope, "sig")]).distinct()
    j = a.join(b, same & (F.col("a_sig") < F.col("b_sig")) & near)
    return j.groupBy(*[F.col(f"a_{c}").alias(c) for c in scope], "a_sig", "b_sig").agg(F.first(hamming("a_", "b_")).cast("int").alias("distance"))


def _open_looks(looks: DataFrame, scope: list[str]) -> DataFrame:
    """Wanted looks of one piece that a bucket of about ``BUCKET`` looks of their scope does not settle.

    In a scope where many look alike, nearly each of them has its like in any
    bucket, and one is enough. What is left is held against the whole scope.
    """
    known = [*scope, "sig", *LOOK, "lo", "hi", "wanted", "several"]
    bucket = F.pmod(F.xxhash64("sig"), F.ceil(F.col("_n") / BUCKET))
    looks = looks.select(*known, bucket.alias("_b"))
    a, b, same = _sides(looks.where(F.col("wanted") & F.col("several") & (F.col("lo") == F.col("hi"))), looks.drop("sig", "wanted", "several"), [*scope, "_b"])
    left = a.join(b, same & _elsewhere() & _alike(K.NEAR_DUPLICATE_BITS, K.NEAR_DUPLICATE_COLOUR, K.NEAR_DUPLICATE_ASPECT), "left_anti")
    return left.select(*[F.col(f"a_{c}").alias(c) for c in (*scope, "sig", *LOOK, "lo")])


def repeated_images(images: DataFrame, scope: list[str], piece: str = "piece_id") -> DataFrame:
    """Product candidates, and whether their look (or very file) also occurs in another piece of their scope.

    A candidate is a cut-out (``alpha``, a file of its own) that takes
    ``PIECE_PRODUCT_RATIO`` of its piece (``ratio``). It is held against all
    cut-outs of the other pieces, of whatever size: a small logo of one piece is
    the large one of another. In a scope of one piece nothing is repeated.

    Copies are folded to one row per signature with the range of their pieces,
    so a look that fills a third of the table costs one row. One like look in
    another piece is enough, so no pair of images is listed: a look of several
    pieces is repeated as it is, one of a single piece meets a bucket of its
    scope first, and those that remain meet their whole scope.
    """
    key = F.unhex(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in LOOK]), 256))
    d = staged(images.where(F.col("alpha") & (F.col("xref") > 0)).withColumn("sig", key), "cut-outs")
    product = F.col("ratio").between(*K.PIECE_PRODUCT_RATIO)
    folded = staged(d.groupBy(*scope, "sig").agg(*[F.first(c).alias(c) for c in LOOK], F.min(piece).alias("lo"), F.max(piece).alias("hi"), F.bool_or(product).alias("wanted")), "looks")
    looks = with_group(folded, scope, _n=F.count(F.lit(1)), _lo=F.min("lo"), _hi=F.max("hi")).withColumn("several", F.col("_lo") != F.col("_hi"))
    left = staged(_open_looks(looks, scope), "open-looks")
    alone = many(left.select(*scope, "sig")).join(similar_signatures(left, scope, among=folded), [*scope, "sig"], "left_anti")
    alone = looks.where(~F.col("several")).select(*scope, "sig").unionByName(alone).withColumn("_alone", F.lit(True))
    files = d.groupBy(*scope, "xref").agg(F.min(piece).alias("flo"), F.max(piece).alias("fhi"))
    j = many(many(d.where(product)).join(alone, [*scope, "sig"], "left")).join(files, [*scope, "xref"])
    other = F.col("_alone").isNull() | (F.col("flo") != F.col(piece)) | (F.col("fhi") != F.col(piece))
    return j.select(*images.columns, F.when(F.col(piece).isNotNull(), other).alias("repeated"))
