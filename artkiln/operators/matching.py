"""Product names to product photos.

Exact keys join by equality. Only tokens without an exact hit take part in the
substring match, and they meet photo names through shared letter groups: a
shorter text can lie inside a longer one only if all its letter groups occur
there, so it is enough that it meets the texts with the rarest of them. Groups
that many texts share (a prefix that all names of a client begin with) then
join nothing, and a text with a group that no longer one has is done at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import list_cell, slug, stem
from ..session import staged
from .matrix import product_count

GRAMS = (3, 6, 12)
#: Texts with one letter group that a task compares with one that asks for it.
SLICE = 2000


def tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per product token of a matrix row (files first, else names)."""
    files, names = list_cell(F.col("imagen")), list_cell(F.col("producto"))
    listed = F.when(F.coalesce("imagen", F.lit("")) != "", files).otherwise(names)
    return rows.select(*keys, F.posexplode(listed).alias("pos", "token")).select(
        "*", slug(F.col("token")).alias("key"), slug(stem(F.col("token"))).alias("stem_key"))


def markers(assets: DataFrame, scope: list[str]) -> DataFrame:
    """Names a photo answers to: full file name and stem. Empty names answer to nothing."""
    both = F.array_distinct(F.array(slug(F.col("filename")), slug(stem(F.col("filename")))))
    return assets.select(*scope, "asset_id", F.explode(both).alias("marker")).where(F.col("marker") != "")


def _pieces(c: str, size: int) -> Column:
    """All stretches of ``size`` letters of a column."""
    every = F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substr(F.col(c), i, F.lit(size)))
    return F.when(F.length(c) >= size, every).otherwise(F.array().cast("array<string>"))


def _hashed(c: str, size: int) -> Column:
    """The same as numbers; two stretches of one number only make a pair that the texts then deny."""
    return F.transform(_pieces(c, size), lambda x: F.xxhash64(x))


def _contained(short: DataFrame, s: str, long: DataFrame, l: str, scope: list[str]) -> DataFrame:
    """Pairs with ``s`` inside ``l``: the letter group of ``s`` that the fewest ``l`` have against all letter groups of ``l``.

    Where even the rarest group is in many texts, the texts that have it and
    those that look for it are spread by salt.
    """
    n = F.length(s)
    every = F.array().cast("array<bigint>")
    for g in GRAMS:
        every = F.when(n >= g, F.array_distinct(_hashed(s, g))).otherwise(every)
    asked = short.where(n >= GRAMS[0]).select(*scope, s, F.explode(every).alias("_gram"), F.size(every).alias("_asked"))
    groups = F.array_distinct(F.flatten(F.array(*[_hashed(l, g) for g in GRAMS])))
    right = long.where(F.length(l) >= GRAMS[0]).select(*scope, l, F.explode(groups).alias("_gram"))
    counts = right.groupBy(*scope, "_gram").agg(F.count(F.lit(1)).alias("_held"))
    rarest = asked.join(counts, [*scope, "_gram"]).groupBy(*scope, s).agg(
        F.min(F.struct("_held", "_gram")).alias("_r"), F.count(F.lit(1)).alias("_found"), F.first("_asked").alias("_asked"))
    # Texts of a common group come in slices of SLICE, told apart by their hash; one that asks goes to each slice.
    slices = F.ceil(F.col("_held") / SLICE).cast("int")
    left = rarest.where(F.col("_found") == F.col("_asked")).select(*scope, s, F.col("_r._gram").alias("_gram"), F.col("_r._held").alias("_held"))
    wanted = left.select(*scope, "_gram", slices.alias("_slices")).distinct()
    right = right.join(wanted, [*scope, "_gram"]).withColumn("_slice", F.pmod(F.xxhash64(l), F.col("_slices")).cast("int")).drop("_slices")
    left = left.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_held")
    return left.join(right, [*scope, "_gram", "_slice"]).where(F.contains(F.col(l), F.col(s))).select(*scope, s, l)


def _fuzzy_pairs(keys_left: DataFrame, marks: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct ``(scope, key, marker)`` with one text inside the other."""
    a = _contained(keys_left, "key", marks, "marker", scope)
    b = _contained(marks, "marker", keys_left, "key", scope).select(*scope, "key", "marker")
    # A marker shorter than three letters lies inside a key too; those few get their own letter groups.
    return a.select(*scope, "key", "marker").unionByName(b).unionByName(_tiny(keys_left, marks, scope)).distinct()


def _tiny(keys_left: DataFrame, marks: DataFrame, scope: list[str]) -> DataFrame:
    small = marks.where(F.length("marker") < GRAMS[0]).distinct()
    pieces = F.array_distinct(F.flatten(F.array(_pieces("key", 1), _pieces("key", 2))))
    return keys_left.where(F.length("key") >= GRAMS[0]).withColumn("marker", F.explode(pieces)).join(
        small, [*scope, "marker"], "left_semi").select(*scope, "key", "marker")


def _twins(assets: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Photos that answer to the same names, as one: ``(asset_id, first, photos)`` of each photo, and the names of the first.

    Every token fits all of them or none, so copies of a name multiply nothing.
    """
    named = markers(assets, scope).groupBy(*scope, "asset_id").agg(F.array_sort(F.collect_set("marker")).alias("_names"))
    named = staged(named, "photo-names")
    first = named.groupBy(*scope, "_names").agg(F.min("asset_id").alias("first"), F.count(F.lit(1)).alias("twins"))
    names = first.select(*scope, F.col("first").alias("asset_id"), "twins", F.explode("_names").alias("marker"))
    return named.join(first, [*scope, "_names"]).select(*scope, "asset_id", "first"), staged(names, "twin-names")


def _key_hits(toks: DataFrame, marks: DataFrame, scope: list[str]) -> DataFrame:
    """Photos (the first of its twins, and their number) of each distinct token key: exact ones, substring ones where no exact one exists."""
    names = marks.select(*scope, "marker").distinct()
    distinct = staged(toks.select(*scope, "key", "stem_key").distinct(), "token-keys")
    wanted = distinct.select(*scope, "key", "stem_key", F.explode(F.array_distinct(F.array("key", "stem_key"))).alias("marker"))
    exact = staged(wanted.where(F.col("marker") != "").join(names, [*scope, "marker"]).select(*scope, "key", "stem_key", "marker"), "exact-hits")
    rest = staged(distinct.join(exact.select(*scope, "key", "stem_key").distinct(), [*scope, "key", "stem_key"], "left_anti"), "open-keys")
    open_keys = rest.where(F.length("key") >= 3).select(*scope, "key").distinct()
    fuzzy = _fuzzy_pairs(open_keys, names, scope).join(rest, [*scope, "key"]).select(*scope, "key", "stem_key", "marker")
    return exact.unionByName(fuzzy).join(marks, [*scope, "marker"]).select(*scope, "key", "stem_key", "asset_id", "twins").distinct()


def _first_candidates(toks: DataFrame, marks: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Every token x photo candidate; of photos that answer to the same names, the first."""
    extra = [c for c in scope if c not in keys]
    return toks.join(_key_hits(toks, marks, scope), [*scope, "key", "stem_key"]).select(*keys, *extra, "pos", "token", "asset_id")


def candidates(toks: DataFrame, assets: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Every token x photo candidate."""
    twins, marks = _twins(assets, scope)
    found = _first_candidates(toks, marks, keys, scope).withColumnRenamed("asset_id", "_first")
    t = twins.select(*[F.col(c).alias(f"_{c}") for c in scope], "asset_id", "first")
    same = F.col("_first").eqNullSafe(F.col("first"))
    for c in scope:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return found.join(t, same).select(*[c for c in found.columns if c != "_first"], "asset_id")


def token_hits(toks: DataFrame, assets: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Matched tokens with their number of photos and the first one.

    The photos are counted once per distinct key, so a popular or unclear token
    joins back as one row however many rows use it or photos fit it.
    """
    per_key = _key_hits(toks, _twins(assets, scope)[1], scope).groupBy(*scope, "key", "stem_key").agg(
        F.sum("twins").alias("photos"), F.min("asset_id").alias("asset_id"))
    extra = [c for c in scope if c not in keys]
    hits = toks.join(per_key, [*scope, "key", "stem_key"]).select(*keys, *extra, "pos", "token", "photos", "asset_id")
    return staged(hits, "token-hits")


def ambiguous(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens that fit several photos."""
    return hits.where(F.col("photos") > 1).select(*keys, "pos", "token", "photos")


def matches(rows: DataFrame, assets: DataFrame, keys: list[str], scope: list[str], hits: DataFrame | None = None) -> DataFrame:
    """Photos of each row, ambiguous tokens apart, first token wins on a repeat.

    A row that asks for products and matched none takes the only photo of its
    scope, if there is just one.
    """
    hits = token_hits(tokens(rows, keys), assets, keys, scope) if hits is None else hits
    found = hits.where(F.col("photos") == 1).groupBy(*keys, "asset_id").agg(F.min("pos").alias("pos"))
    only = assets.groupBy(*scope).agg(F.min("asset_id").alias("asset_id"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 1)
    asking = rows.where(product_count(F.col("producto"), F.col("imagen")) > 0).select(*{**dict.fromkeys(keys), **dict.fromkeys(scope)})
    unmatched = asking.join(only, scope).join(hits.select(*keys).distinct(), keys, "left_anti")
    return found.unionByName(unmatched.select(*keys, "asset_id", F.lit(0).alias("pos")))


def readiness(rows: DataFrame, assets: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Expected and found photos, unclear tokens, and whether the row may run."""
    hits = token_hits(tokens(rows, keys), assets, keys, scope)
    expected = rows.select(*keys, product_count(F.col("producto"), F.col("imagen")).alias("expected"))
    found = matches(rows, assets, keys, scope, hits).groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    unclear = hits.where(F.col("photos") > 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("unclear"))
    j = expected.join(found, keys, "left").join(unclear, keys, "left").na.fill(0, ["found", "unclear"])
    return j.withColumn("ready", (F.col("found") >= F.col("expected")) & (F.col("unclear") == 0))


def rows_of_assets(rows: DataFrame, assets: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Inverse view: how many rows use each photo; unused photos count zero."""
    twins, marks = _twins(assets, scope)
    used = _first_candidates(tokens(rows, keys), marks, keys, scope).select(*keys, *[c for c in scope if c not in keys], "asset_id").distinct()
    counts = used.groupBy(*scope, F.col("asset_id").alias("first")).agg(F.count(F.lit(1)).alias("rows"))
    counts = twins.join(counts, [*scope, "first"]).drop("first")
    return assets.select(*scope, "asset_id").join(counts, [*scope, "asset_id"], "left").na.fill(0, ["rows"])


def missing(rows: DataFrame, assets: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    return readiness(rows, assets, keys, scope).where(F.col("found") < F.col("expected")).select(*keys, "expected", "found")


#: Photos of a piece, pixels of one, pixels of all.
BUDGET = (K.MAX_PRODUCTS_PER_PIECE, K.MAX_PRODUCT_PIXELS, K.MAX_DECODE_PIXELS)


def render_budget(row_assets: DataFrame, keys: list[str], limits: tuple[int, int, int] = BUDGET) -> DataFrame:
    """Decode budget of a row: products, largest photo, pixels in all."""
    products, single, total = limits
    px = F.col("width").cast("bigint") * F.col("height")
    return row_assets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("products"), F.max(px).alias("largest"), F.sum(px).alias("pixels"),
    ).withColumn(
        "rule",
        F.when(F.col("products") > products, "too_many_products").when(F.col("largest") > single, "photo_too_large")
        .when(F.col("pixels") > total, "too_many_pixels"),
    )
