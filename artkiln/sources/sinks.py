"""Manifests and exports. Writes go through Spark's file commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_slug

MANIFEST = ("fila", "producto", "plantilla", "formato", "propuesta", "estado", "png", "jpg", "psd", "avisos")
MATRIX_HEADERS = (
    "producto", "imagen", "titular", "subtitulo", "precio_actual", "precio_anterior", "cuota", "descuento",
    "cta", "legal", "vigencia", "formatos", "cantidad_propuestas", "notas", "plantilla", "modo",
)


def piece_path(product: Column, row_number: Column, format_id: Column, proposal: Column, extension: str) -> Column:
    """``product/format/fila-002_propuesta-01.png``."""
    fallback = F.concat(F.lit("fila-"), row_number.cast("string"))
    folder = url_slug(F.coalesce(F.nullif(product, F.lit("")), fallback), "producto")
    return F.concat(
        folder, F.lit("/"), url_slug(format_id, "formato"), F.lit("/"),
        F.format_string(f"fila-%03d_propuesta-%02d.{extension}", row_number, proposal))


def manifest(pieces: DataFrame) -> DataFrame:
    """Ten fixed columns, warnings in one cell."""
    return pieces.select(
        F.col("row_number").alias("fila"), F.col("product").alias("producto"), F.col("template_name").alias("plantilla"),
        F.col("format_id").alias("formato"), F.col("proposal").alias("propuesta"), F.col("status").alias("estado"), "png", "jpg", "psd",
        F.array_join("warnings", " | ").alias("avisos"))


#: A file that begins with it is read as UTF-8.
BOM = "\ufeff"


def write_manifest(pieces: DataFrame, path: str, per_batch: list[str] | None = None) -> None:
    """CSV with header and byte order mark, as spreadsheets expect. With ``per_batch`` each batch gets its own folder and tasks stay spread."""
    out = manifest(pieces).withColumnRenamed("fila", f"{BOM}fila")
    if per_batch:
        keyed = pieces.select(*[F.col(c) for c in per_batch], *manifest_columns()).withColumnRenamed("fila", f"{BOM}fila")
        keyed.write.mode("overwrite").partitionBy(*per_batch).option("encoding", "UTF-8").csv(path, header=True)
    else:
        out.write.mode("overwrite").csv(path, header=True)


def manifest_columns() -> list[Column]:
    return [
        F.col("row_number").alias("fila"), F.col("product").alias("producto"), F.col("template_name").alias("plantilla"),
        F.col("format_id").alias("formato"), F.col("proposal").alias("propuesta"), F.col("status").alias("estado"), F.col("png"), F.col("jpg"),
        F.col("psd"), F.array_join("warnings", " | ").alias("avisos")]


def export_manifest(projects: DataFrame, variants: DataFrame, placements: DataFrame) -> DataFrame:
    """One nested document per project: its variants, their files and editable texts."""
    editable = (F.trim(F.coalesce("content", F.lit(""))) != "") & F.col("text_verified") & ((F.col("type") == "text") | F.col("export_as_text"))
    names = placements.where(editable).groupBy("project_id", "variant_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]).alias("texts"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("category") == "legal", F.struct("ord", "name")))), lambda s: s["name"]).alias("legals"))
    v = variants.join(names, ["project_id", "variant_id"], "left")
    file = F.concat(
        url_slug(F.col("product_label"), "producto"), F.lit("/"), F.col("format_id"), F.lit("/"),
        F.format_string("%02d_%s_%s.png", F.col("index"), F.col("layout"), F.substring("variant_id", 1, 8)))
    none = F.array().cast("array<string>")
    doc = F.struct(
        "index", F.col("variant_id").alias("id"), file.alias("file"), F.regexp_replace(file, r"\.png$", ".psd").alias("psd"),
        F.coalesce("texts", none).alias("editable_text_layers"), F.coalesce("legals", none).alias("editable_legal_layers"), "score")
    grouped = v.groupBy("project_id").agg(F.array_sort(F.collect_list(doc)).alias("variants"))
    return projects.select("project_id", "name").join(grouped, "project_id", "left")


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def matrix_lines(rows: DataFrame) -> DataFrame:
    """Matrix rows as fully quoted CSV lines."""
    cells = []
    for h in MATRIX_HEADERS:
        c = {"formatos": F.array_join("formatos", "|"), "cantidad_propuestas": F.greatest(F.lit(1), F.col("cantidad_propuestas")),
             "modo": F.when(F.col("modo") == "individual", "individual").otherwise("")}.get(h, F.col(h))
        cells.append(quoted(c))
    return rows.select("matrix_id", "row_number", F.concat_ws(",", *cells).alias("line"))


def write_matrix(rows: DataFrame, path: str) -> None:
    out = rows.select(*[F.array_join(h, "|").alias(h) if h == "formatos" else F.col(h) for h in MATRIX_HEADERS])
    out.write.mode("overwrite").option("quoteAll", "true").option("escape", '"').csv(path, header=True)


def write_documents(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Whole-table replace; readers see the old or the new files, never half of them."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)
