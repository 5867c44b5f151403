"""Box arithmetic as column expressions.

A box is a tuple of four columns ``(x, y, width, height)`` in pixels, unless a
name says ``xy`` (left, top, right, bottom). Rounding is half-to-even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", names=("x", "y", "width", "height")) -> Box:
    return tuple(F.col(prefix + n) for n in names)  # type: ignore[return-value]


def num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rnd(c: Column) -> Column:
    """Half-to-even rounding to an integer."""
    return F.bround(c.cast("double"), 0).cast("int")


def rnd4(c: Column) -> Column:
    return F.bround(c, 4)


def overlap_area(a: Box, b: Box) -> Column:
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w.cast("bigint") * h).otherwise(F.lit(0).cast("bigint"))


def area(a: Box) -> Column:
    return a[2].cast("bigint") * a[3]


def overlap_of_smaller(a: Box, b: Box) -> Column:
    return overlap_area(a, b) / F.greatest(F.lit(1), F.least(area(a), area(b)))


def overlap_of_first(a: Box, b: Box) -> Column:
    return overlap_area(a, b) / F.greatest(F.lit(1), area(a))


def iou(a: Box, b: Box) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def gap(a: Box, b: Box) -> tuple[Column, Column]:
    dx = F.greatest(a[0] - (b[0] + b[2]), b[0] - (a[0] + a[2]), F.lit(0))
    dy = F.greatest(a[1] - (b[1] + b[3]), b[1] - (a[1] + a[3]), F.lit(0))
    return dx, dy


def full_bleed(a: Box, w: Column, h: Column, share: float = K.FULL_BLEED) -> Column:
    return (a[2] >= w * share) & (a[3] >= h * share)


def rotated_bounds(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return w * c + h * s, w * s + h * c


def fit_contain(w: Column, h: Column, bw: Column, bh: Column, upscale: bool = True) -> Column:
    scale = F.least(bw / w, bh / h)
    if not upscale:
        scale = F.least(scale, F.lit(1.0))
    fitted = F.struct(
        F.greatest(F.lit(1), rnd(w * scale)).alias("width"),
        F.greatest(F.lit(1), rnd(h * scale)).alias("height"),
    )
    raw = F.struct(F.greatest(F.lit(1), bw).cast("int").alias("width"), F.greatest(F.lit(1), bh).cast("int").alias("height"))
    return F.when((w <= 0) | (h <= 0), raw).otherwise(fitted)


def _shrink(w: Column, h: Column, over: Column, scale: Column) -> tuple[Column, Column]:
    nw = F.when(over, F.greatest(F.lit(1), (w * scale).cast("int"))).otherwise(w.cast("int"))
    nh = F.when(over, F.greatest(F.lit(1), (h * scale).cast("int"))).otherwise(h.cast("int"))
    return nw, nh


def clamp_into_margin(a: Box, cw: Column, ch: Column, margin: Column) -> Column:
    """Keep a box inside the margin without deforming it."""
    max_w, max_h = cw - margin * 2, ch - margin * 2
    w1, h1 = _shrink(a[2], a[3], a[2] > max_w, max_w / a[2])
    w2, h2 = _shrink(w1, h1, h1 > max_h, max_h / h1)
    return F.struct(
        F.greatest(margin, F.least(a[0], cw - margin - w2)).cast("int").alias("x"),
        F.greatest(margin, F.least(a[1], ch - margin - h2)).cast("int").alias("y"),
        w2.alias("width"), h2.alias("height"),
    )


def safe_bounds(cw: Column, ch: Column, safe: Column) -> Column:
    """Essential rectangle of a format (left, top, right, bottom in pixels)."""
    def side(size, name):
        return F.greatest(F.lit(0), rnd(size * F.coalesce(safe[name], F.lit(K.SAFE_MARGIN))))

    left, top = side(cw, "left"), side(ch, "top")
    return F.struct(
        left.alias("x0"), top.alias("y0"),
        F.greatest(left + 1, cw - side(cw, "right")).alias("x1"),
        F.greatest(top + 1, ch - side(ch, "bottom")).alias("y1"),
    )


def constrain_to(a: Box, bounds: Column) -> Column:
    """Shrink and move a box into given bounds."""
    aw = F.greatest(F.lit(1), bounds["x1"] - bounds["x0"])
    ah = F.greatest(F.lit(1), bounds["y1"] - bounds["y0"])
    scale = F.least(F.lit(1.0), aw / F.greatest(F.lit(1), a[2]), ah / F.greatest(F.lit(1), a[3]))
    w = F.when(scale < 1, F.greatest(F.lit(1), rnd(a[2] * scale))).otherwise(a[2])
    h = F.when(scale < 1, F.greatest(F.lit(1), rnd(a[3] * scale))).otherwise(a[3])
    return F.struct(
        F.greatest(bounds["x0"], F.least(a[0], bounds["x1"] - w)).alias("x"),
        F.greatest(bounds["y0"], F.least(a[1], bounds["y1"] - h)).alias("y"),
        w.alias("width"), h.alias("height"), scale.alias("scale"),
    )


def to_pixels(a: Box, cw: Column, ch: Column) -> Column:
    return F.struct(
        rnd(a[0] * cw).alias("x"), rnd(a[1] * ch).alias("y"),
        F.greatest(F.lit(1), rnd(a[2] * cw)).alias("width"),
        F.greatest(F.lit(1), rnd(a[3] * ch)).alias("height"),
    )


def from_pixels(a: Box, cw: Column, ch: Column) -> Column:
    w, h = F.greatest(F.lit(1), cw), F.greatest(F.lit(1), ch)
    one, zero, tiny = F.lit(1.0), F.lit(0.0), F.lit(1e-6)
    x, y = F.least(F.greatest(a[0] / w, zero), one), F.least(F.greatest(a[1] / h, zero), one)
    bw, bh = F.least(F.greatest(a[2] / w, tiny), one), F.least(F.greatest(a[3] / h, tiny), one)
    return F.struct(x.alias("x"), y.alias("y"), F.least(bw, one - x).alias("width"), F.least(bh, one - y).alias("height"))


def inside_canvas(a: Box, smallest: float = 0.0) -> Column:
    """Fraction box cut at the right and bottom edge; null when nothing is left."""
    w, h = F.least(a[2], F.lit(1.0) - a[0]), F.least(a[3], F.lit(1.0) - a[1])
    ok = (w >= smallest) & (h >= smallest) if smallest else (w > 0) & (h > 0)
    return F.when(ok, F.struct(a[0].alias("x"), a[1].alias("y"), w.alias("width"), h.alias("height")))


def clip_xy(x0: Column, y0: Column, x1: Column, y1: Column, fx0, fy0, fx1, fy1) -> Column:
    """Cut a left/top/right/bottom box to a frame; null when empty."""
    l, t = F.greatest(num(fx0), F.least(num(fx1), x0)), F.greatest(num(fy0), F.least(num(fy1), y0))
    r, b = F.greatest(num(fx0), F.least(num(fx1), x1)), F.greatest(num(fy0), F.least(num(fy1), y1))
    return F.when((r > l) & (b > t), F.struct(l.alias("x0"), t.alias("y0"), r.alias("x1"), b.alias("y1")))


def aspect_family(w: Column, h: Column) -> Column:
    return (
        F.when((w <= 0) | (h <= 0), "square")
        .when(h / w >= 1.62, "story")
        .when(h / w > 1.2, "portrait")
        .when(w / h > 1.35, "landscape")
        .otherwise("square")
    )


def normalise_to_safe(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, safe: Column) -> Column:
    """Pixel box -> coordinates of the safe area; round first, then cut; null when empty."""
    uw = F.lit(1.0) - safe["left"] - safe["right"]
    uh = F.lit(1.0) - safe["top"] - safe["bottom"]

    def pos(v, size, edge, room):
        return rnd4(F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.try_divide(F.try_divide(v, size) - edge, room))))

    x, y = pos(x0, w, safe["left"], uw), pos(y0, h, safe["top"], uh)
    bw = F.least(rnd4(F.try_divide(F.try_divide(x1 - x0, w), uw)), rnd4(F.lit(1.0) - x))
    bh = F.least(rnd4(F.try_divide(F.try_divide(y1 - y0, h), uh)), rnd4(F.lit(1.0) - y))
    ok = (w > 0) & (h > 0) & (uw > 0) & (uh > 0) & (bw > 0) & (bh > 0)
    return F.when(ok, F.struct(x.alias("x"), y.alias("y"), bw.alias("width"), bh.alias("height")))


def coverage(sw: Column, sh: Column, tw: Column, th: Column) -> Column:
    """Share of the target canvas an art covers without deforming."""
    s = F.least(tw / sw, th / sh)
    return F.when(F.least(sw, sh, tw, th) <= 0, 0.0).otherwise((sw * s) * (sh * s) / (tw.cast("double") * th))


def cover_upscale(sw: Column, sh: Column, w: Column, h: Column) -> Column:
    return F.when(F.least(sw, sh, w, h) <= 0, 0.0).otherwise(F.greatest(w / sw, h / sh))


def aspect_delta(sw: Column, sh: Column, w: Column, h: Column) -> Column:
    return F.when(F.least(sw, sh, w, h) <= 0, 0.0).otherwise(F.abs((w / h) / (sw / sh) - 1.0))


def pinned_box(a: Box, sw: Column, sh: Column, cw: Column, ch: Column) -> Column:
    """Box under one uniform scale, centred on the new canvas."""
    s = F.least(cw / F.greatest(F.lit(1), sw), ch / F.greatest(F.lit(1), sh))
    ox, oy = (cw - sw * s) / 2, (ch - sh * s) / 2
    return F.struct(
        rnd(ox + a[0] * s).alias("x"), rnd(oy + a[1] * s).alias("y"),
        F.greatest(F.lit(1), rnd(a[2] * s)).alias("width"),
        F.greatest(F.lit(1), rnd(a[3] * s)).alias("height"),
    )


def split_zone(z: Box, count: Column, cw: Column, ch: Column, aspect: Column, arrangement: Column, gap_share: float = 0.012) -> Column:
    """Cells of a zone for ``count`` items: row, column or overlapped."""
    x, y, w, h = (v.cast("double") for v in z)
    n = count
    last = F.greatest(F.lit(1), n - 1)
    g = F.lit(gap_share)
    row_w = F.greatest(F.lit(0.02), (w - g * (n - 1)) / n)
    col_h = F.greatest(F.lit(0.02), (h - g * (n - 1)) / n)

    def fitted(sw, sh):
        return F.least(sh * ch, sw * cw / F.greatest(aspect, F.lit(0.01)))

    horizontal = (
        F.when(arrangement == "horizontal", True).when(arrangement == "vertical", False)
        .otherwise(fitted(row_w, h) >= fitted(w, col_h))
    )
    ow = F.greatest(F.lit(0.02), w * F.least(F.lit(0.82), F.lit(1.0) - (n - 1) * 0.04))
    oh = F.greatest(F.lit(0.02), h * F.least(F.lit(0.94), F.lit(1.0) - (n - 1) * 0.025))
    tx, ty = F.greatest(F.lit(0.0), w - ow), F.greatest(F.lit(0.0), h - oh)

    def cell(a, b, c, d):
        return F.struct(a.alias("x"), b.alias("y"), c.alias("width"), d.alias("height"))

    def at(i):
        over = cell(
            x + tx * i / last,
            y + ty * (i % 2) / F.greatest(F.lit(1), F.least(F.lit(2), n - 1)), ow, oh,
        )
        return (
            F.when(arrangement == "overlap", over)
            .when(horizontal, cell(x + i * (row_w + g), y, row_w, h))
            .otherwise(cell(x, y + i * (col_h + g), w, col_h))
        )

    many = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)
    return F.when(n <= 1, F.array(cell(x, y, w, h))).otherwise(many)


def combo_aspect(sizes: Column) -> Column:
    """Width/height of a group: first item whole, others smaller and overlapped 18 %."""
    usable = F.filter(sizes, lambda s: (s["width"] > 0) & (s["height"] > 0))
    shares = F.transform(
        usable,
        lambda s, i: F.when(i == 0, s["width"] / s["height"]).otherwise(
            s["width"] / s["height"]
            * F.greatest(F.lit(0.5), F.lit(0.8) - F.lit(0.08) * F.floor((i - 1) / 2)) * (1 - 0.18)
        ),
    )
    return F.when(F.size(usable) > 0, F.aggregate(shares, F.lit(0.0), lambda a, s: a + s))
