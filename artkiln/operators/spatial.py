"""Box joins and area aggregates.

Boxes meet through grid cells. A group with few boxes is one cell, so it costs
what a plain equi-join costs; a group with many boxes gets a finer grid, so no
task has to compare all of its pairs. Each pair is reported only by the cell
that holds the top-left corner of the common area, hence exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G
from ..session import staged
from .skew import bucketed_before, ordered_list, with_group

PER_CELL = 48
MAX_GRID = 64


def _extent(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_x0").alias("lx"), F.min("_y0").alias("ly"),
        F.max("_x1").alias("hx"), F.max("_y1").alias("hy"))


def _cell(v: Column, low: Column, high: Column) -> Column:
    size = F.greatest((high - low) / F.col("_g"), F.lit(1e-9))
    return F.least(F.col("_g") - 1, F.greatest(F.lit(0), F.floor((v - low) / size))).cast("int")


def _edges(df: DataFrame, pad: Column) -> DataFrame:
    return (
        df.withColumn("_x0", (F.col("x") - pad).cast("double")).withColumn("_y0", (F.col("y") - pad).cast("double"))
        .withColumn("_x1", (F.col("x") + F.col("width") + pad).cast("double"))
        .withColumn("_y1", (F.col("y") + F.col("height") + pad).cast("double"))
    )


def _spread(df: DataFrame, grid: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    d = df.join(grid, keys)
    cx = F.sequence(_cell(F.col("_x0"), F.col("lx"), F.col("hx")), _cell(F.col("_x1"), F.col("lx"), F.col("hx")))
    cy = F.sequence(_cell(F.col("_y0"), F.col("ly"), F.col("hy")), _cell(F.col("_y1"), F.col("ly"), F.col("hy")))
    d = d.withColumn("_cx", F.explode(cx)).withColumn("_cy", F.explode(cy))
    shared = [*keys, "_cx", "_cy"]
    grid_cols = ["_g", "lx", "ly", "hx", "hy"]
    return d.select(*shared, *([] if prefix == "b_" else grid_cols), *[
        F.col(c).alias(prefix + c) for c in d.columns if c not in shared and c not in grid_cols and c != "n"])


def box_pairs(left: DataFrame, right: DataFrame, keys: list[str], pad: Column | None = None) -> DataFrame:
    """Pairs of ``left`` (``a_``) and ``right`` (``b_``) boxes that touch when padded by ``pad``.

    Both sides need ``x, y, width, height``; ``keys`` are shared.
    """
    pad = F.lit(0) if pad is None else pad
    a, b = _edges(left, pad), _edges(right, F.lit(0))
    edges = ["_x0", "_y0", "_x1", "_y1"]
    own = left is right
    grid = _extent(a.select(*keys, *edges) if own else a.select(*keys, *edges).unionByName(b.select(*keys, *edges)), keys)
    side = F.when(F.col("n") <= (PER_CELL if own else 2 * PER_CELL), 1).otherwise(F.least(F.lit(MAX_GRID), F.ceil(F.sqrt(F.col("n") / PER_CELL))))
    grid = grid.withColumn("_g", side.cast("int"))
    p = _spread(a, grid, keys, "a_").join(_spread(b, grid, keys, "b_"), [*keys, "_cx", "_cy"])
    p = p.where(
        (F.col("a__x0") <= F.col("b__x1")) & (F.col("b__x0") <= F.col("a__x1"))
        & (F.col("a__y0") <= F.col("b__y1")) & (F.col("b__y0") <= F.col("a__y1")))
    home = (F.col("_g") == 1) | (
        (_cell(F.greatest("a__x0", "b__x0"), F.col("lx"), F.col("hx")) == F.col("_cx"))
        & (_cell(F.greatest("a__y0", "b__y0"), F.col("ly"), F.col("hy")) == F.col("_cy")))
    drop = ["_cx", "_cy", "_g", "lx", "ly", "hx", "hy"] + [s + e for s in ("a_", "b_") for e in edges]
    return p.where(home).drop(*drop)


def box(prefix: str) -> G.Box:
    return G.box(prefix)


def can_overlap() -> Column:
    return (~G.full_bleed(G.box(), F.col("canvas_w"), F.col("canvas_h")) & (F.col("category") != "decoration")
            & (F.col("width") > 0) & (F.col("height") > 0))


def meeting(a: Callable[[str], Column], b: Callable[[str], Column]) -> tuple[Column, Column, Column, Column]:
    """Of two boxes, whose columns ``a`` and ``b`` give by name: whether their overlap counts, its ratio, the threshold, whether a product meets what it must not hide."""
    fixed = a("pinned") & b("pinned") & ~a("product") & ~b("product")
    protected = (a("product") & b("mandatory")) | (b("product") & a("mandatory"))
    limit = F.when(protected, 0.08).when(a("text") | b("text"), 0.16).otherwise(0.30)
    sides = ("x", "y", "width", "height")
    return ~fixed, G.overlap_of_smaller(tuple(map(a, sides)), tuple(map(b, sides))), limit, protected


def severe(ratio: Column, threshold: Column) -> Column:
    return ratio > F.greatest(F.lit(0.45), threshold)


def overlaps(placements: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping pairs (earlier, later) with ratio, threshold and severity."""
    live = placements.where(can_overlap())
    # What a pair asks of its boxes is asked of each box once.
    product, mandatory = F.col("category") == "product", F.col("category").isin(*K.MANDATORY)
    live = staged(live.select(*keys, "ord", "name", "category", "x", "y", "width", "height", product.alias("product"), mandatory.alias("mandatory"), (F.col("type") == "text").alias("text"), "pinned"), "overlap-boxes")
    p = box_pairs(live, live, keys).where(F.col("a_ord") < F.col("b_ord"))
    free, ratio, limit, protected = meeting(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    p = p.where(free).withColumn("ratio", ratio).withColumn("threshold", limit).withColumn("protected", protected)
    return p.where(F.col("ratio") > F.col("threshold")).withColumn("severity", F.when(severe(F.col("ratio"), F.col("threshold")), "severe").otherwise("moderate"))


def union_coverage(boxes: DataFrame, keys: list[str], grid: int = 64) -> DataFrame:
    """Share of the canvas under at least one box, on a 64 x 64 grid.

    A box is the four numbers of its grid cells in one. A group holds each such
    number once, however many boxes it has, and they meet in one row: between
    two neighbouring edges the grid rows are alike, so one OR of the column
    masks stands for all of them.
    """
    d = boxes.select(*keys, *cell_code(grid)).where("_counts")
    return covered(d.groupBy(*keys).agg(F.collect_set("_box").alias("_set")), grid).select(*keys, "fill")


def cell_code(grid: int = 64) -> tuple[Column, Column]:
    """The grid cells of a box in one number (``_box``), and whether it covers any or stands for a blank canvas (``_counts``)."""
    g = F.lit(grid)

    def cut(v):
        return F.greatest(F.lit(0), F.least(g, v.cast("int")))

    def share(v, size):
        return F.coalesce(F.try_divide(v, F.col(size)), F.lit(0.0)) * grid

    x0, y0 = cut(share(F.col("x"), "canvas_w")), cut(share(F.col("y"), "canvas_h"))
    x1 = F.greatest(x0 + 1, F.least(g, share(F.col("x") + F.col("width"), "canvas_w").cast("int")))
    y1 = F.greatest(y0 + 1, F.least(g, share(F.col("y") + F.col("height"), "canvas_h").cast("int")))
    blank = (F.col("canvas_w") <= 0) | (F.col("canvas_h") <= 0)
    n, y1 = F.when(blank, 0).otherwise(F.least(x1, g) - x0), F.least(y1, g)
    packed = F.when(n > 0, ((x0 * 128 + n) * 128 + y0) * 128 + y1).otherwise(0)
    return packed.alias("_box"), ((y0 < grid) & ((n > 0) | (y0 == 0))).alias("_counts")


def covered(d: DataFrame, grid: int = 64) -> DataFrame:
    """Adds ``fill``, the share of the canvas under the boxes of ``_set``."""
    def opened(p):
        n, at = F.floor(p / 16384).cast("int") % 128, F.floor(p / 2097152).cast("int")
        ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(64) - n)
        return F.struct((F.floor(p / 128).cast("int") % 128).alias("y0"), (p % 128).alias("y1"), F.when(n > 0, F.call_function("shiftleft", ones, at)).otherwise(0).alias("m"))

    d = d.withColumn("_b", F.transform("_set", opened))
    edges = F.array_sort(F.array_distinct(F.concat(F.transform("_b", lambda b: b["y0"]), F.transform("_b", lambda b: b["y1"]))))
    d = d.withColumn("_e", edges)

    def band(e, i):
        mask = F.aggregate("_b", F.lit(0).cast("bigint"), lambda m, b: F.when((b["y0"] <= e) & (e < b["y1"]), m.bitwiseOR(b["m"])).otherwise(m))
        return F.bit_count(mask) * F.coalesce(F.get(F.col("_e"), i + 1) - e, F.lit(0))

    return d.withColumn("fill", F.aggregate(F.transform("_e", band), F.lit(0), lambda a, n: a + n) / (grid * grid)).drop("_set", "_b", "_e")


def dead_bands(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Free strips on the four sides, as shares of the canvas."""
    return boxes.groupBy(*keys).agg(*band_extents(F.lit(True))).select(*keys, *band_shares())


def band_extents(content: Column) -> list[Column]:
    """Aggregates over the boxes that are ``content``."""
    x, y, w, h = G.box()
    parts = {"x0": F.min(F.when(content, x)), "y0": F.min(F.when(content, y)), "x1": F.max(F.when(content, x + w)), "y1": F.max(F.when(content, y + h)),
             "w": F.max(F.when(content, F.col("canvas_w"))), "h": F.max(F.when(content, F.col("canvas_h")))}
    return [c.alias(f"_band_{n}") for n, c in parts.items()]


def band_shares() -> list[Column]:
    x0, y0, x1, y1, cw, ch = (F.col(f"_band_{n}") for n in ("x0", "y0", "x1", "y1", "w", "h"))

    def share(v, size):
        return F.coalesce(F.try_divide(F.greatest(F.lit(0), v), size), F.lit(0.0))

    return [share(y0, ch).alias("top"), share(ch - y1, ch).alias("bottom"), share(x0, cw).alias("left"), share(cw - x1, cw).alias("right")]


def text_share(boxes: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each box that text boxes cover (overlaps between texts counted), at most 1."""
    p = box_pairs(boxes, texts, keys)
    inter = p.groupBy(*keys, F.col("a_ord").alias("ord")).agg(F.sum(G.overlap_area(box("a_"), box("b_"))).alias("_in"))
    j = boxes.join(inter, [*keys, "ord"], "left")
    share = F.least(F.lit(1.0), F.coalesce("_in", F.lit(0)) / F.greatest(F.lit(1), G.area(G.box())))
    return j.withColumn("text_share", share).drop("_in")


def without_plates(boxes: DataFrame, texts: DataFrame, keys: list[str], ratio: float = K.TEXT_PLATE_RATIO) -> DataFrame:
    """The boxes that are no text plates: text covers less than ``ratio`` of them."""
    return text_share(boxes, texts, keys).where(F.col("text_share") < ratio).select(*boxes.columns)


class _Kept:
    """Kept boxes of one group, found through grid cells of about their own size.

    A box of size class k (longest side up to 2**k) lies in at most four cells
    of the grid of that class, so one that asks looks at few cells of each
    class, however many boxes are kept and however large one of them is.
    """

    def __init__(self) -> None:
        self.cells: dict[int, dict[tuple[int, int], list[tuple]]] = {}

    @staticmethod
    def _span(b: tuple, size: int) -> tuple[range, range]:
        return range(int(b[0] // size), int((b[0] + b[2]) // size) + 1), range(int(b[1] // size), int((b[1] + b[3]) // size) + 1)

    def add(self, b: tuple) -> None:
        k = max(0, int(max(b[2], b[3], 1)) - 1).bit_length()
        xs, ys = self._span(b, 1 << k)
        grid = self.cells.setdefault(k, {})
        for cx in xs:
            for cy in ys:
                grid.setdefault((cx, cy), []).append(b)

    def covers(self, b: tuple, share: float, iou: bool) -> bool:
        area = max(1, b[2] * b[3])
        for k, grid in self.cells.items():
            xs, ys = self._span(b, 1 << k)
            found = (grid.get((cx, cy), ()) for cx in xs for cy in ys) if len(xs) * len(ys) <= len(grid) else (v for (cx, cy), v in grid.items() if cx in xs and cy in ys)
            for boxes in found:
                for o in boxes:
                    w, h = min(b[0] + b[2], o[0] + o[2]) - max(b[0], o[0]), min(b[1] + b[3], o[1] + o[3]) - max(b[1], o[1])
                    if w > 0 and h > 0 and w * h > share * (b[2] * b[3] + o[2] * o[3] - w * h if iou else area):
                        return True
        return False


def _tiles(rows: DataFrame, tile_boxes: int, shift: float) -> DataFrame:
    """A row for each tile of its group (``_g``) that a box touches; ``_own`` in the one that holds its centre.

    Tiles hold about ``tile_boxes`` boxes, but are at least twice as long as
    boxes are on average, so a box touches few of them.
    """
    right, low = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    extent = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"), F.min("x").alias("_lx"), F.min("y").alias("_ly"), F.max(right).alias("_hx"), F.max(low).alias("_hy"),
        F.greatest(F.avg("width"), F.avg("height"), F.sqrt(F.avg(F.col("width").cast("double") * F.col("height")))).alias("_long"))
    side = F.greatest(F.col("_hx") - F.col("_lx"), F.col("_hy") - F.col("_ly")) + 1
    tile = F.when(F.col("_n") <= tile_boxes, side).otherwise(F.greatest(side / F.ceil(F.sqrt(F.col("_n") / tile_boxes)), 2 * F.col("_long"), F.lit(1.0)))
    d = rows.join(extent.select("_g", "_lx", "_ly", tile.cast("double").alias("_tile"), F.when(F.col("_n") <= tile_boxes, 0.0).otherwise(shift).alias("_shift")), "_g")

    def cell(v: Column, low: str) -> Column:
        return F.floor((v - F.col(low)) / F.col("_tile") + F.col("_shift")).cast("int")

    xs, ys = F.sequence(cell(F.col("x"), "_lx"), cell(right, "_lx")), F.sequence(cell(F.col("y"), "_ly"), cell(low, "_ly"))
    d = d.withColumn("_tx", F.explode(xs)).withColumn("_ty", F.explode(ys))
    own = (cell(F.col("x") + F.col("width") / 2, "_lx") == F.col("_tx")) & (cell(F.col("y") + F.col("height") / 2, "_ly") == F.col("_ty"))
    return d.withColumn("_own", own).drop("_lx", "_ly", "_tile", "_shift")


def _settled(rows: DataFrame, order: list[str], share: float, kind: str, tile_boxes: int, turn: int) -> DataFrame:
    """The open boxes that are kept or stay open after a pass over the tiles in rank order; ``_state`` 1 or 0."""
    tiled = _tiles(rows, tile_boxes, 0.5 * (turn % 2))
    if turn:
        live = tiled.where(F.col("_own") & (F.col("_state") == 0)).select("_g", "_tx", "_ty").distinct()
        tiled = tiled.join(live, ["_g", "_tx", "_ty"], "left_semi")
    names = rows.columns

    def run(batches):
        place, kept, maybe = None, _Kept(), _Kept()
        for batch in batches:
            states = []
            for g, tx, ty, own, state, *b in zip(*[batch[c] for c in ("_g", "_tx", "_ty", "_own", "_state")], *[batch[c].astype(float) for c in ("x", "y", "width", "height")]):
                if place != (g, tx, ty):
                    place, kept, maybe = (g, tx, ty), _Kept(), _Kept()
                if state == 0 and not kept.covers(b, share, kind == "iou"):
                    # Where an open box covers it, or where it may be covered in the tile of its centre, only later passes know.
                    sure = own and not maybe.covers(b, share, kind == "iou")
                    (kept if sure else maybe).add(b)
                    states.append((1 if sure else 0) if own else -1)
                else:
                    if state:
                        kept.add(b)
                    states.append(-1)
            yield batch.assign(_state=states).loc[[x >= 0 for x in states], names]

    stream = tiled.repartition("_g", "_tx", "_ty").sortWithinPartitions("_g", "_tx", "_ty", *order)
    return stream.mapInPandas(run, rows.schema)


def greedy_keep(boxes: DataFrame, keys: list[str], rank: list[Column], share: float, kind: str = "contained", tile_boxes: int = 2000) -> DataFrame:
    """Keep boxes in rank order, ties by ``ord``; drop one that an already kept box covers by more than ``share`` (0.5 or more).

    A box that covers half of another holds its centre, so all that decides on
    a box touches the tile of its centre. A tile is read once in rank order as
    a stream: a box is dropped under a kept one, kept if no box that is still
    open could drop it, else it stays open. Open boxes take further passes,
    with the kept ones of their tiles; a small group is one tile and settled
    in the first. Runs its passes when called; boxes are written between them.
    """
    if share < 0.5:
        raise ValueError("a share below one half is not decided at the centre")
    order = [*[f"_o{i}" for i in range(len(rank))], "ord", "_id"]
    rows = boxes.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(rank)], F.to_json(F.struct(*keys)).alias("_g"), F.monotonically_increasing_id().alias("_id"), F.lit(0).alias("_state"))
    rows, turn, done = staged(rows, "boxes"), 0, []
    while True:
        new = staged(_settled(rows, order, share, kind, tile_boxes, turn), "boxes-settled")
        done.append(new.where(F.col("_state") == 1))
        left = new.where(F.col("_state") == 0)
        kept = done[0]
        for more in done[1:]:
            kept = kept.unionByName(more)
        if left.isEmpty():
            return kept.select(*boxes.columns)
        rows, turn = left.unionByName(kept.join(left.select("_g").distinct(), "_g", "left_semi").select(*left.columns)), turn + 1


def axis_clusters(items: DataFrame, keys: list[str], block: int = 512) -> DataFrame:
    """Cluster boxes along their group's ``axis``; adds ``cluster`` (0, 1, ...).

    Boxes come by start. One joins the last cluster when it overlaps any of its
    members by half of the shorter one, else it opens the next. With members
    (s, e) that start no later, that is so if the farthest end reaches half of
    the box, or the farthest middle its start: two running maxima. A cluster is
    opened only by a box that no earlier member reached, so the maxima over all
    boxes before say the same as those over the last cluster. Boxes without
    length overlap nothing; they part the row, and maxima begin anew after one.
    """
    along = F.col("axis") == "x"
    start = F.when(along, F.col("x")).otherwise(F.col("y")).cast("double")
    size = F.when(along, F.col("width")).otherwise(F.col("height")).cast("double")
    minor = F.when(along, F.col("y") + F.col("height") / 2).otherwise(F.col("x") + F.col("width") / 2).cast("double")
    rows = items.withColumn("ord", F.col("ord").cast("bigint")).select("*", start.alias("_s"), (start + size).alias("_e"), minor.alias("_m"))
    r, at = K.GROUP_OVERLAP, [*keys, "_b"]
    long = F.col("_e") > F.col("_s")
    middle = (1 - r) * F.col("_e") + r * F.col("_s")
    rows = rows.withColumn("_b", F.floor(F.col("_s") / block))
    local = Window.partitionBy(*at).orderBy("_s", "_m", "ord")
    inside = local.rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def part_of(part: Column, v: Column) -> Column:
        return F.struct(part.alias("part"), v.alias("v"))

    # Within a bucket: boxes without length so far, and the maxima since the last of them.
    here = {"_end": F.when(long, part_of(F.col("_part"), F.col("_e"))), "_mid": F.when(long, part_of(F.col("_part"), middle))}
    rows = rows.withColumn("_part", F.sum(F.when(long, 0).otherwise(1)).over(local.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({f"_l{c}": F.max(v).over(inside) for c, v in here.items()})
    # Across buckets: the same of all buckets before, a row for each bucket.
    sums = rows.groupBy(*at).agg(F.max("_part").alias("_parts"), *[F.max(v).alias(c) for c, v in here.items()])
    sums = sums.withColumn("_base", F.coalesce(F.sum("_parts").over(before), F.lit(0)))
    sums = sums.select(*at, "_base", *[F.max(F.when(F.col(c).isNotNull(), part_of(F.col("_base") + F.col(f"{c}.part"), F.col(f"{c}.v")))).over(before).alias(f"_c{c}") for c in here])
    rows = rows.join(sums, at).withColumn("_part", F.col("_base") + F.col("_part"))
    best = {c: F.greatest(F.when(F.col(f"_l{c}").isNotNull(), part_of(F.col("_base") + F.col(f"_l{c}.part"), F.col(f"_l{c}.v"))), F.col(f"_c{c}")) for c in here}
    rows = rows.withColumns(best)
    reached = [(F.col(f"{c}.part") == F.col("_part")) & (F.col(f"{c}.v") >= to) for c, to in (("_end", F.col("_s") + r * (F.col("_e") - F.col("_s"))), ("_mid", F.col("_s")))]
    opens = F.when(F.coalesce(long & (reached[0] | reached[1]), F.lit(False)), 0).otherwise(1)
    rows = staged(rows.select(*items.columns, "_s", "_m", "_b", opens.alias("_opens")), "axis-openings")
    counts = rows.groupBy(*at).agg(F.sum("_opens").alias("_n"))
    counts = counts.select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.sum("_opens").over(local.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_number", number).join(counts, at).select(*items.columns, (F.col("_before") + F.col("_number") - 1).cast("int").alias("cluster"))


def free_band(occupied: DataFrame, keys: list[str]) -> DataFrame:
    """Largest free horizontal band of each art, as the box for its product."""
    h, w = F.col("canvas_h"), F.col("canvas_w")
    s, e = F.greatest(F.lit(0), F.col("y0")), F.least(h, F.col("y1"))
    # A line outside of the canvas, or of no art, only tells that there is a canvas.
    inside = s < e
    for k in keys:
        inside = inside & F.col(k).isNotNull()
    # One row per canvas and start: no more of them than the canvas has pixels, however many lines an art has.
    spans = occupied.select(*keys, "canvas_w", "canvas_h", F.when(inside, s).alias("b"), F.when(inside, e).alias("e")).groupBy(
        *keys, "canvas_w", "canvas_h", "b").agg(F.min("e").alias("_lo"), F.max("e").alias("_hi"))
    art = Window.partitionBy(*keys)
    reach = F.max("_hi").over(art.orderBy("b", "_lo").rowsBetween(Window.unboundedPreceding, -1))
    gaps = spans.withColumn("_a", F.coalesce(reach, F.lit(0))).withColumn("_z", F.coalesce(F.max("_hi").over(art), F.lit(0)))

    def gap(a: Column, b: Column) -> Column:
        return F.when(b > a, F.struct((b - a).alias("n"), (-a).alias("o"), a.alias("a"), b.alias("b")))

    best = gaps.groupBy(*keys, "canvas_w", "canvas_h").agg(
        F.max(F.greatest(gap(F.col("_a"), F.col("b")), gap(F.col("_z"), h))).alias("g"))
    size = F.col("g.b") - F.col("g.a")
    breath = (size * 0.06).cast("int")
    out = best.where(size >= h * K.MIN_PRODUCT_BAND).select(
        *keys, (w * 0.06).cast("int").alias("x0"), (F.col("g.a") + breath).alias("y0"), (w * 0.94).cast("int").alias("x1"),
        (F.col("g.b") - breath).alias("y1"))
    return out.where(F.col("y1") > F.col("y0"))


def union_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    b = boxes.groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("_r"), F.max(F.col("y") + F.col("height")).alias("_b"))
    return b.select(*keys, "x", "y", F.greatest(F.lit(1), F.col("_r") - F.col("x")).alias("width"),
                    F.greatest(F.lit(1), F.col("_b") - F.col("y")).alias("height"))


def reading_axis(items: DataFrame, keys: list[str]) -> DataFrame:
    """``x`` or ``y``: by canvas shape, else by the larger spread of centres."""
    def centre(at, size, canvas):
        return F.coalesce(F.try_divide(F.col(at) + F.col(size) / 2, F.col(canvas)), F.lit(0.0))

    cx, cy = centre("x", "width", "canvas_w"), centre("y", "height", "canvas_h")
    a = items.groupBy(*keys).agg(
        F.max("canvas_w").alias("w"), F.max("canvas_h").alias("h"),
        (F.max(cx) - F.min(cx)).alias("sx"), (F.max(cy) - F.min(cy)).alias("sy"))
    shape = F.col("w") / F.greatest(F.lit(1), F.col("h"))
    return a.select(*keys, F.when(shape >= 1.8, "x").when(shape <= 0.6, "y").when(F.col("sx") >= F.col("sy"), "x").otherwise("y").alias("axis"))


def reading_order(items: DataFrame, keys: list[str]) -> DataFrame:
    """Rank top to bottom in tolerant bands, then left to right."""
    d = with_group(items, keys, _low=F.min("height"))
    tol = F.greatest(F.lit(24), F.floor(F.col("_low") / 2))
    d = d.withColumn("band", F.floor(F.col("y") / tol))
    from .skew import bucketed_rank

    return bucketed_rank(d, keys, F.floor(F.col("band") / 16), [F.col("band"), F.col("x"), F.col("ord")], "rank").drop("_low")


__all__ = ["box_pairs", "overlaps", "union_coverage", "dead_bands", "text_share", "without_plates", "greedy_keep", "axis_clusters", "free_band",
           "union_box", "reading_axis", "reading_order", "ordered_list"]
