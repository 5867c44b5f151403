"""Format catalogue joins: resolution, fan-out, nearest size, variant plans.

The catalogue has 37 fixed rows, so its broadcast never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas
from ..functions import geometry as G
from ..functions.text import slug, strip_ws
from .skew import best_per_group

_MEASURE = r"^\s*(\d{2,5})\s*[xX×]\s*(\d{2,5})\s*$"


def _safe_lit(values) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("left", "top", "right", "bottom"), values)])


def resolve_formats(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Token -> ``format_id, width, height, safe`` or a ``rule`` saying why not."""
    spark = tokens.sparkSession
    cat = F.broadcast(schemas.formats(spark).select("id", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("safe").alias("_s")))
    ali = F.broadcast(schemas.format_aliases(spark).select(F.col("alias"), F.col("id").alias("_alias_id")))
    raw = strip_ws(F.col(token))
    t = tokens.withColumn("_raw", raw).withColumn("_slug", slug(raw))
    ids = cat.select(F.col("id").alias("_exact"))
    t = t.join(F.broadcast(ids), F.col("_raw") == F.col("_exact"), "left").join(ali, F.col("_slug") == F.col("alias"), "left")
    t = t.withColumn("_id", F.coalesce("_exact", "_alias_id")).join(cat, F.col("_id") == F.col("id"), "left")
    mw, mh = F.regexp_extract("_raw", _MEASURE, 1).try_cast("int"), F.regexp_extract("_raw", _MEASURE, 2).try_cast("int")
    w, h = F.coalesce("_w", mw), F.coalesce("_h", mh)
    rule = (
        F.when(w.isNull(), "unknown_format")
        .when(F.col("_id").isNull() & ((F.least(w, h) < 100) | (F.greatest(w, h) > 8000)), "out_of_range")
        .when(w.cast("bigint") * h > K.MAX_OUTPUT_PIXELS, "too_many_pixels")
    )
    ok = rule.isNull()
    return t.select(
        *tokens.columns,
        F.when(ok, F.coalesce("_id", F.concat(w.cast("string"), F.lit("x"), h.cast("string")))).alias("format_id"),
        F.when(ok, w).alias("width"), F.when(ok, h).alias("height"),
        F.when(ok, F.coalesce("_s", _safe_lit(K.DEFAULT_SAFE))).alias("safe"), rule.alias("rule"),
    )


def row_formats(rows: DataFrame, keys: list[str], default: str = K.DEFAULT_FORMAT) -> DataFrame:
    """Distinct resolved formats of each row in order of first use."""
    tokens = F.when(F.size("formatos") > 0, F.col("formatos")).otherwise(F.array(F.lit(default)))
    long = rows.select(*keys, F.posexplode_outer(tokens).alias("pos", "token"))
    # The catalogue is fixed and small, so tokens are resolved in place and the rows are read once.
    good = resolve_formats(long).where(F.col("rule").isNull())
    return best_per_group(good, [*keys, "format_id"], [F.col("pos")], [*keys, "format_id", "pos", "width", "height", "safe"])


def planned_pieces(rows: DataFrame, keys: list[str], row_key: str, default: str = K.DEFAULT_FORMAT) -> DataFrame:
    """Pieces that would be made: distinct resolved formats x proposals."""
    formats = row_formats(rows.select(*keys, row_key, "formatos", "cantidad_propuestas"), [*keys, row_key, "cantidad_propuestas"], default)
    n = F.col("cantidad_propuestas")
    return formats.groupBy(*keys).agg(
        F.sum(n).alias("pieces"),
        F.sum(F.col("width").cast("bigint") * F.col("height") * n).alias("pixels"),
    )


def with_format(df: DataFrame, column: str = "format_id") -> DataFrame:
    """Catalogue metadata, neutral values where the id is not a preset."""
    cat = F.broadcast(schemas.formats(df.sparkSession).drop("ord").withColumnRenamed("id", "_fid"))
    j = df.join(cat, F.col(column) == F.col("_fid"), "left")
    neutral = {"platform": F.lit("Personalizado"), "family": F.lit("Formato heredado"), "placement": F.col(column),
               "recommended": F.lit(False), "safe": _safe_lit(K.DEFAULT_SAFE)}
    for name, value in neutral.items():
        j = j.withColumn(name, F.coalesce(F.col(name), value))
    return j.drop("_fid")


def art_formats(arts: DataFrame, layer_count: str | None = None, k: int | None = None) -> DataFrame:
    """Every art x format with its coverage; ``viable`` and ``needs_split`` flags.

    With ``k``, the first ``k`` formats of each row as the picker orders them;
    they are found within the row, so the others never reach a sort.
    """
    cat = F.broadcast(schemas.formats(arts.sparkSession).select(
        F.col("ord").alias("format_ord"), F.col("id").alias("format_id"), F.col("width").alias("fw"), F.col("height").alias("fh"),
        F.col("recommended")))
    if k is None:
        j = arts.crossJoin(cat)  # 37 fixed rows on the right
    else:
        # Recommended ones, then catalogue order, is a fixed order; plain numbers add whether they are crowded (unknown comes first).
        fixed = sorted(schemas.format_rows(), key=lambda r: (not r[9], r[0]))
        sizes = F.array(*[F.struct(F.lit(r[5]).alias("w"), F.lit(r[6]).alias("h"), F.lit(i).alias("i")) for i, r in enumerate(fixed)])

        def place(f):
            crowded = G.coverage(F.col("width"), F.col("height"), f["w"], f["h"]) < K.MIN_SOURCE_COVERAGE
            return F.coalesce(crowded.cast("int") + 1, F.lit(0)) * 100 + f["i"]

        places = F.transform(sizes, place)
        j = arts.withColumn("_place", F.explode(F.slice(F.sort_array(places), 1, k))).withColumn(
            "format_ord", F.get(F.array(*[F.lit(r[0]) for r in fixed]), F.col("_place") % 100)).drop("_place").join(cat, "format_ord")
    cov = G.coverage(F.col("width"), F.col("height"), F.col("fw"), F.col("fh"))
    layers = F.col(layer_count) if layer_count else F.lit(0)
    return (
        j.withColumn("coverage", cov)
        .withColumn("needs_split", F.col("coverage") < K.MIN_SOURCE_COVERAGE)
        .withColumn("viable", (layers >= K.MIN_LAYERS_TO_RECOMPOSE) | (F.col("coverage") >= K.MIN_SOURCE_COVERAGE))
    )


def pinned_fanout(layers: DataFrame, canvas_w: str = "canvas_w", canvas_h: str = "canvas_h") -> DataFrame:
    """Each layer on each catalogue format under one uniform scale."""
    cat = F.broadcast(schemas.formats(layers.sparkSession).select(
        F.col("id").alias("format_id"), F.col("width").alias("fw"), F.col("height").alias("fh")))
    j = layers.crossJoin(cat)  # 37 fixed rows on the right
    placed = G.pinned_box(G.box(), F.col(canvas_w), F.col(canvas_h), F.col("fw"), F.col("fh"))
    return j.withColumn("placed", placed)


def _best_named(arts: DataFrame, keys: list[str], ranks: dict[str, list[Column]], out: str, columns: list[str]) -> DataFrame:
    """The name with the least rank per art; the earlier one on a tie.

    Each row keeps its own best name before the rows of an art meet.
    """
    best = F.least(*[F.struct(F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], F.lit(o).alias("o")).alias("rank"), F.lit(n).alias("name"))
                     for o, (n, rank) in enumerate(ranks.items())])
    named = arts.withColumn("_best", best).withColumn(out, F.col("_best.name"))
    return best_per_group(named, keys, [F.col("_best.rank")], [*keys, out, *columns])


def _ratio_gap(ratio: Column) -> Column:
    return F.abs(ratio - F.col("width") / F.greatest(F.lit(1), F.col("height")))


def nearest_native(arts: DataFrame, keys: list[str]) -> DataFrame:
    """Older size closest in proportion, then in pixels, then first in the list."""
    def rank(w, h):
        size = F.abs(F.lit(w) - F.col("width")) + F.abs(F.lit(h) - F.col("height"))
        exact = (F.lit(w) == F.col("width")) & (F.lit(h) == F.col("height"))
        return [F.when(exact, 0).otherwise(1), _ratio_gap(F.lit(w) / F.lit(h)), size]

    return _best_named(arts, keys, {n: rank(w, h) for n, w, h in K.LEGACY_SIZES}, "native", [])


def auto_formats(arts: DataFrame, keys: list[str], layers: str) -> DataFrame:
    """Native size plus the social sizes the art can fill, in order."""
    ranks = {n: [_ratio_gap(F.lit(w) / F.lit(h))] for n, w, h in K.LEGACY_SIZES}
    native = _best_named(arts, keys, ranks, "native", ["width", "height", layers])
    extras = []
    sizes = {n: (w, h) for n, w, h in K.LEGACY_SIZES}
    for name in K.SOCIAL_DEFAULTS:
        w, h = sizes[name]
        fits = (F.col(layers) >= K.MIN_LAYERS_TO_RECOMPOSE) | (
            G.coverage(F.col("width"), F.col("height"), F.lit(w), F.lit(h)) >= K.MIN_SOURCE_COVERAGE)
        extras.append(F.when((F.col("native") != name) & fits, F.lit(name)))
    return native.select(*keys, F.array_compact(F.array(F.col("native"), *extras)).alias("formats"))


def nearest_ratio(arts: DataFrame, keys: list[str]) -> DataFrame:
    return _best_named(arts, keys, {n: [_ratio_gap(F.lit(r))] for n, r in K.NAMED_RATIOS}, "name", [])


def worst_fit(fits: DataFrame) -> DataFrame:
    """Per format over all arts: the tightest capacity and the lowest coverage.

    Arts are folded by the room they lack with plain numbers as the state, which
    needs no sort; only one row per format and lack is compared after.
    """
    first = F.coalesce(-F.col("art_ord"), F.lit(-(2**63)))
    folded = fits.groupBy("format_id", (F.col("total") - F.col("fits")).alias("_lack")).agg(
        F.max(first).alias("_first"), *[F.max_by(c, first).alias(c) for c in ("total", "fits", "art_id")],
        F.min("coverage").alias("coverage"),
        F.bool_or(F.col("layers") < K.MIN_LAYERS_TO_RECOMPOSE).alias("few_layers"))
    return folded.groupBy("format_id").agg(
        F.max_by(F.struct("total", "fits", "art_id"), F.struct("_lack", "_first")).alias("w"),
        F.min("coverage").alias("coverage"), F.bool_or("few_layers").alias("few_layers"),
    ).select(
        "format_id", F.col("w.total").alias("total"), F.col("w.fits").alias("fits"), F.col("w.art_id").alias("art_id"), "coverage",
        (F.col("coverage") >= K.MIN_SOURCE_COVERAGE).alias("recommended"),
        ((F.col("coverage") < K.MIN_SOURCE_COVERAGE) & F.col("few_layers")).alias("needs_split"),
    )


def variant_plans(requests: DataFrame) -> DataFrame:
    """``(project_id, formats, n_variants, seed)`` -> one row per planned variant."""
    n = F.size("formats")
    i = F.col("index")
    return requests.select("*", F.explode(F.sequence(F.lit(0), F.col("n_variants") - 1)).alias("index")).select(
        "project_id", "index", F.element_at("formats", (F.pmod(i, n) + 1).cast("int")).alias("format_id"),
        F.floor(i / n).cast("int").alias("within"), (F.col("seed") * 1000 + i).cast("bigint").alias("seed"))


def retry_seed(seed: Column, attempt: Column) -> Column:
    return seed + attempt * K.RETRY_SEED_STEP


def layout_pool(sw: Column, sh: Column, fw: Column, fh: Column, reflow_ok: Column) -> Column:
    """Layouts reserved for an art on a format."""
    aspect = fw / F.greatest(F.lit(1), fh)
    faithful = F.abs((fw / fh) / (sw / F.greatest(F.lit(1), sh)) - 1.0) <= K.FAITHFUL_ASPECT
    tight = (aspect >= K.BANNER_ASPECT) | (G.coverage(sw, sh, fw, fh) < K.MIN_SOURCE_COVERAGE)
    return F.array_compact(F.array(F.when(faithful, "source_faithful"), F.when(tight & reflow_ok, "source_flow")))


def with_format_ids(df: DataFrame, column: str = "ord") -> DataFrame:
    """The id of the format at a place of the catalogue."""
    cat = F.broadcast(schemas.formats(df.sparkSession).select(F.col("ord").alias("_at"), F.col("id").alias("format_id")))
    return df.join(cat, F.col(column) == F.col("_at")).drop("_at")


def picker_order() -> list[Column]:
    """Not crowded first, then recommended, then catalogue order."""
    return [F.col("crowded").asc(), F.col("recommended").desc(), F.col("ord").asc()]
