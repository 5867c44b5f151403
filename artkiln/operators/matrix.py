"""Production matrix: header aliases, cells to rows, expansion, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import display_name, distinct_folded, let, list_cell, list_size, slug, slug_in, strip_ws
from .skew import bucketed_before

ROW_BLOCK = 50_000


def alias_map() -> Column:
    pairs = [F.lit(v) for kv in sorted(K.ALIAS_TO_COLUMN.items()) for v in kv]
    return F.create_map(*pairs)


def canonical(c: Column) -> Column:
    """Canonical matrix column of a header text; null when unknown."""
    return F.try_element_at(alias_map(), slug(c))


def header_columns(headers: DataFrame) -> DataFrame:
    """``(matrix_id, cells)`` header records -> ``(matrix_id, canonical, pos)``, first use per name."""
    hits = headers.select("matrix_id", F.posexplode("cells").alias("pos", "header")).withColumn(
        "canonical", canonical(F.col("header")))
    return (
        hits.where(F.col("canonical").isNotNull()).groupBy("matrix_id", "canonical")
        .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("uses"))
    )


def header_errors(columns: DataFrame) -> DataFrame:
    """A column named twice is an error of its matrix."""
    return columns.where(F.col("uses") > 1).select(
        "matrix_id", F.lit(1).alias("row_number"), F.lit("duplicate_column").alias("rule"),
        F.col("canonical").alias("detail"),
    )


def separator_score(first_lines: Column, separator: str) -> Column:
    """``(known headers, lines as wide as the header, width)`` of one separator."""
    # A separator counts only outside quotes: an even number of quotes follows it.
    outside = F.lit(separator + '(?=(?:[^"]*"[^"]*")*[^"]*$)')
    quoted = lambda line: F.transform(F.split(line, outside, F.lit(-1)), lambda c: F.regexp_replace(c, '^"|"$', ""))
    split = F.transform(first_lines, lambda line: F.when(F.contains(line, F.lit('"')), quoted(line)).otherwise(F.split(line, F.lit(separator), F.lit(-1))))

    def scored(rows: Column, head: Column) -> Column:
        known = F.size(F.filter(head, lambda c: canonical(c).isNotNull()))
        same = F.size(F.filter(F.slice(rows, 2, 5), lambda r: F.size(r) == F.size(head)))
        return F.struct(known.alias("known"), same.alias("consistent"), F.size(head).alias("width"))

    # Each line is split once.
    return let(split, lambda rows: let(F.element_at(rows, 1), lambda head: scored(rows, head)))


def infer_separator(first_lines: Column) -> Column:
    """Separator whose header is best known; null when no header is known."""
    ranked = F.array(*[
        F.struct(separator_score(first_lines, s).alias("score"), F.lit(-i).alias("order"), F.lit(s).alias("separator"))
        for i, s in enumerate(K.SEPARATORS)
    ])
    return let(F.array_max(ranked), lambda best: F.when(best["score"]["known"] > 0, best["separator"]))


def cells_to_fields(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Data records -> one trimmed text column per canonical name.

    The column positions of a matrix are one small map joined by its id, so the
    cells themselves are neither exploded nor regrouped.
    """
    positions = columns.groupBy("matrix_id").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "pos"))).alias("_at"))
    joined = cells.where(F.col("record_no") > 1).join(positions, "matrix_id")

    def field(name):
        at = F.try_element_at(F.col("_at"), F.lit(name))
        return strip_ws(F.coalesce(F.get(F.col("cells"), at), F.lit(""))).alias(name)

    blank = F.forall("cells", lambda c: strip_ws(c) == "")
    return joined.where(~blank).select(
        "matrix_id", F.col("record_no").alias("row_number"), *[field(n) for n in K.HEADER_ALIASES])


def quantity(c: Column) -> Column:
    """Empty -> 1; 1..6 as written; null for anything else."""
    number = F.when(F.rlike(c, F.lit(r"^[+-]?\d+$")), c.try_cast("int"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(1)).when(number.between(1, K.MAX_PROPOSALS), number)


def mode(c: Column) -> Column:
    return F.when(slug_in(c, K.INDIVIDUAL_TOKENS), "individual").otherwise("combo")


def suppressed(c: Column) -> Column:
    return slug_in(c, K.SUPPRESS_TOKENS)


def format_list(c: Column) -> Column:
    return distinct_folded(list_cell(c))


def normalise_rows(fields: DataFrame) -> DataFrame:
    """Field texts -> typed rows with a ``rule`` column (null when the row is good)."""
    order = [*K.OPTIONAL_TEXT, "producto"]
    rule = (
        F.when((F.coalesce("formatos", F.lit("")) != "") & (list_size(F.col("formatos")) == 0), "formats")
        .when(quantity(F.col("cantidad_propuestas")).isNull(), "quantity"))
    # Each cell is held against the suppress words once.
    marked = fields.select("*", rule.alias("rule"), meaningful().alias("_keep"), *[suppressed(F.col(f)).alias(f"_off_{f}") for f in order])
    typed = marked.select(
        *[c for c in fields.columns if c not in K.HEADER_ALIASES],
        F.when(F.col("_off_producto"), "").otherwise(F.coalesce("producto", F.lit(""))).alias("producto"),
        *[F.when((F.col(f) != "") & ~F.col(f"_off_{f}"), F.col(f)).alias(f) for f in K.OPTIONAL_TEXT],
        format_list(F.col("formatos")).alias("formatos"),
        quantity(F.col("cantidad_propuestas")).alias("cantidad_propuestas"),
        F.array_compact(F.array(*[F.when(F.col(f"_off_{f}"), F.lit(f)) for f in order])).alias("suppressed_fields"),
        mode(F.col("modo")).alias("modo"),
        "rule", "_keep",
    )
    return typed.withColumn("ai_fields", F.array().cast("array<string>")).withColumn("fila_origen", F.lit(None).cast("int"))


def meaningful() -> Column:
    """Does the row order an art at all? A template name alone does not.

    A written cell counts whether it holds a value or a suppress word, so this
    looks at the raw cells and stays small in the plan.
    """
    texts = ["producto", *[f for f in K.OPTIONAL_TEXT if f != "plantilla"]]
    return (F.concat_ws("", *texts) != "") | (list_size(F.col("formatos")) > 0) | suppressed(F.col("plantilla"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good meaningful rows, and the rest with the rule they break."""
    good = rows.where(F.col("rule").isNull() & F.col("_keep")).drop("rule", "_keep")
    return good, rows.where(F.col("rule").isNotNull()).drop("_keep")


def parse_matrix_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw cells of many matrices -> rows and errors."""
    columns = header_columns(cells.where(F.col("record_no") == 1))
    doubled = header_errors(columns)
    usable = columns.join(doubled.select("matrix_id").distinct(), "matrix_id", "left_anti")
    good, bad = split_errors(normalise_rows(cells_to_fields(cells, usable)))
    return good, bad.select("matrix_id", "row_number", "rule").unionByName(doubled.select("matrix_id", "row_number", "rule"))


def product_count(producto: Column, imagen: Column) -> Column:
    return F.greatest(list_size(producto), list_size(imagen))


def art_count() -> Column:
    n = product_count(F.col("producto"), F.col("imagen"))
    return F.when(F.col("modo") == "individual", F.greatest(n, F.lit(1))).otherwise(1)


def expand_rows(rows: DataFrame, keys: list[str] | None = None, block: int = ROW_BLOCK) -> DataFrame:
    """One row per product of an ``individual`` row, numbered without clashes.

    The first product keeps the row number; the others count on from the
    highest number of the matrix, in row order. The count of earlier extra rows
    is carried over blocks of row numbers, so one huge matrix spreads over many
    tasks.
    """
    keys = keys or ["matrix_id"]
    base = rows.withColumn("_n", art_count()).withColumn("_extra", F.col("_n") - 1)
    tops = rows.groupBy(*keys).agg(F.max("row_number").alias("_top"))
    placed = bucketed_before(
        base, keys, F.floor(F.col("row_number") / block), [F.col("row_number")], {"_before": ("sum", F.col("_extra"))}
    ).join(tops, keys)
    # Lists are read once per written row, and only of rows that are split.
    split = F.col("_n") > 1
    cells = ("producto", "imagen", *K.PER_PRODUCT_FIELDS)
    listed = placed.select("*", *[F.when(split, list_cell(F.col(f))).alias(f"_l_{f}") for f in cells])
    # The sequence is never empty; the outer form keeps Spark from deriving a filter from it.
    exploded = listed.select("*", F.posexplode_outer(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i", "_unused"))
    names, files, i = F.col("_l_producto"), F.col("_l_imagen"), F.col("_i")
    name, file = F.get(names, i), F.get(files, i)
    new = {
        "producto": F.when(split, F.coalesce(name, F.when(file.isNotNull(), display_name(file)), F.lit(""))).otherwise(F.col("producto")),
        "imagen": F.when(split, file).otherwise(F.col("imagen")),
        "modo": F.when(split, "combo").otherwise(F.col("modo")),
        "fila_origen": F.when(split, F.col("row_number")).otherwise(F.col("fila_origen")).cast("int"),
        "row_number": F.when(i == 0, F.col("row_number")).otherwise(
            F.col("_top") + F.coalesce(F.col("_before"), F.lit(0)) + i).cast("int"),
    }
    for f in K.PER_PRODUCT_FIELDS:
        parts = F.col(f"_l_{f}")
        new[f] = F.when(split & (F.size(parts) > 1), F.get(parts, i)).otherwise(F.col(f))
    return exploded.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def requested_pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Raw count: formats as written (at least one) x proposals."""
    n = F.greatest(F.lit(1), F.size("formatos")) * F.col("cantidad_propuestas")
    return rows.groupBy(*keys).agg(F.sum(n).alias("pieces"), F.count(F.lit(1)).alias("rows"))


def requested_fields() -> Column:
    """Fields a template has to place for the row."""
    items = [F.when(product_count(F.col("producto"), F.col("imagen")) > 0, "producto")]
    for f in K.CONTENT_FIELDS:
        items.append(F.when(F.coalesce(F.col(f), F.lit("")) != "", "precio" if f == "precio_actual" else f))
    return F.array_compact(F.array(*items))


def pick_sheet(cells: DataFrame) -> DataFrame:
    """Best sheet of each workbook from long cells ``(workbook, sheet_ord, row, col, value)``.

    The header is the first of the first 20 rows with a known column name; the
    sheet with most known names wins, the earlier one on a tie.
    """
    rows = cells.groupBy("workbook", "sheet_ord", "row").agg(
        F.count_if(canonical(F.col("value")).isNotNull()).alias("known"))
    first = rows.groupBy("workbook", "sheet_ord").agg(
        F.min(F.when((F.col("known") > 0) & (F.col("row") <= 20), F.col("row"))).alias("hit"), F.min("row").alias("top"))
    scored = first.withColumn("header_row", F.coalesce("hit", "top")).join(
        rows.select("workbook", "sheet_ord", F.col("row").alias("header_row"), F.col("known").alias("score")),
        ["workbook", "sheet_ord", "header_row"])
    best = scored.groupBy("workbook").agg(
        F.max_by(F.struct("sheet_ord", "header_row", "score"), F.struct("score", -F.col("sheet_ord"))).alias("b"))
    return best.select("workbook", "b.*").where(F.col("score") > 0)


def sheet_records(cells: DataFrame, picked: DataFrame) -> DataFrame:
    """Picked sheets as matrix cells; record numbers start at the header."""
    rows = cells.join(picked.select("workbook", "sheet_ord", "header_row"), ["workbook", "sheet_ord"]).where(
        F.col("row") >= F.col("header_row"))
    wide = rows.groupBy("workbook", "row", "header_row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_m"), F.max("col").alias("_w"))
    cells_out = F.transform(
        F.sequence(F.lit(0), F.col("_w")), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit("")))
    return wide.select(
        F.col("workbook").alias("matrix_id"), (F.col("row") - F.col("header_row") + 1).cast("int").alias("record_no"),
        cells_out.alias("cells"))


def shared_strings(cells: DataFrame, strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve dictionary cells; cells whose index is missing are returned apart."""
    index = F.when(F.col("kind") == "s", F.col("value").try_cast("int"))
    joined = cells.withColumn("idx", index).join(
        strings.select("workbook", "idx", F.col("value").alias("_text")), ["workbook", "idx"], "left")
    bad = (F.col("kind") == "s") & (F.col("value") != "") & F.col("_text").isNull()
    good = joined.where(~bad).withColumn("value", F.when(F.col("kind") == "s", F.coalesce("_text", F.lit(""))).otherwise(F.col("value")))
    return good.select(*cells.columns), joined.where(bad).select(*cells.columns)


def column_index(reference: Column) -> Column:
    """Spreadsheet reference -> zero-based column (``AA1`` -> 26)."""
    letters = F.upper(F.regexp_extract(reference, r"^([A-Za-z]+)", 1))
    chars = F.filter(F.split(letters, ""), lambda c: c != "")
    return F.greatest(F.lit(0), F.aggregate(chars, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1)


def chosen_products(rows: DataFrame, chosen: Column) -> DataFrame:
    """Re-order a row's products: names and per-product values follow their file."""
    previous = F.transform(list_cell(F.col("imagen")), F.lower)

    def pipe(c):
        return F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), strip_ws)

    def at(file):
        return F.array_position(previous, F.lower(file)) - 1

    names = pipe(F.col("producto"))
    typed = F.transform(
        chosen,
        lambda f, i: F.coalesce(
            F.nullif(F.when(F.size(previous) > 0, F.when(at(f) >= 0, F.get(names, at(f)))).otherwise(F.get(names, i)), F.lit("")),
            display_name(f)),
    )
    out = {"producto": F.array_join(typed, " | "), "imagen": F.array_join(chosen, " | "),
           "modo": F.when(F.size(chosen) < 2, "combo").otherwise(F.col("modo"))}
    for f in K.PER_PRODUCT_FIELDS:
        parts = pipe(F.col(f))
        values = F.transform(chosen, lambda x: F.when(at(x) >= 0, F.coalesce(F.get(parts, at(x)), F.lit(""))).otherwise(""))
        same = F.size(F.array_distinct(values)) <= 1
        out[f] = F.when(
            F.size(parts) > 1, F.when(same, F.coalesce(F.get(values, F.lit(0)), F.lit(""))).otherwise(F.array_join(values, " | "))
        ).otherwise(F.col(f))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in rows.columns])


def all_known(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
