"""Drop folders, image gates, documents and JSON records."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import clean_document


def relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^file:(//)?", ""), "^" + root.rstrip("/") + "/", "")


def inventory(files: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """Usable files of a drop folder (``rel, length``): no dot files, depth 3, known extension; the first `most`, if given."""
    name = F.regexp_extract("rel", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    ok = ~F.startswith(name, F.lit(".")) & (F.size(F.split("rel", "/")) <= depth) & ext.isin(*K.DROP_EXTENSIONS)
    shown = files.where(ok).select("rel", name.alias("name"), ext.alias("extension"), F.bround(F.col("length") / (1024 * 1024), 1).alias("size_mb"))
    return shown if most is None else shown.orderBy("rel").limit(most)


def list_folder(spark: SparkSession, root: str, **kw) -> DataFrame:
    """Inventory of a folder; file contents are never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return inventory(raw.select(relative(F.col("path"), root).alias("rel"), "length"), **kw)


#: Bytes of a file's head that hold the size of its picture; a TIFF may keep it anywhere.
HEAD = 262_144
# Fixed value: the note on a file that cannot be read as a picture.
UNREADABLE = ": no se pudo leer (UnidentifiedImageError)."


def _jpeg_size(b: bytes) -> tuple[int, int] | None:
    """Width and height from the frame header, past all segments before it."""
    at = 2
    while at + 9 <= len(b) and b[at] == 0xFF:
        if b[at + 1] == 0xFF:  # padding
            at += 1
        elif 0xC0 <= b[at + 1] <= 0xCF and b[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", b, at + 5)
            return w, h
        elif b[at + 1] == 0x01 or 0xD0 <= b[at + 1] <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack_from(">H", b, at + 2)[0]
    return None


def _webp_size(b: bytes) -> tuple[int, int] | None:
    kind = b[12:16]
    if kind == b"VP8X":
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L" and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack_from("<HH", b, 26)
        return w & 0x3FFF, h & 0x3FFF
    return None


def _tiff_size(b: bytes) -> tuple[int, int] | None:
    """Width and length among the fields of the first directory."""
    order = "<" if b[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", b, 4)[0]
    size = {}
    for k in range(struct.unpack_from(order + "H", b, at)[0]):
        tag, kind = struct.unpack_from(order + "HH", b, at + 2 + 12 * k)
        if tag in (256, 257) and kind in (3, 4):
            size[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), b, at + 10 + 12 * k)[0]
    return (size[256], size[257]) if len(size) == 2 else None


def header_size(b: bytes | None, kind: str | None) -> tuple[int, int] | None:
    """Width and height told by the head of a picture of that format; None where it is cut short, broken or empty."""
    try:
        if kind == "PNG" and b[12:16] == b"IHDR":
            size = struct.unpack_from(">II", b, 16)
        elif kind == "PSD":
            size = struct.unpack_from(">II", b, 14)[::-1]
        elif kind == "AVIF" and (at := b.find(b"ispe")) >= 0:
            size = struct.unpack_from(">II", b, at + 8)
        else:
            reader = {"JPEG": _jpeg_size, "WEBP": _webp_size, "TIFF": _tiff_size}.get(kind)
            size = reader(b) if reader else None
    except (struct.error, IndexError, TypeError):
        return None
    return tuple(size) if size and min(size) > 0 else None


_SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


def image_size(content: Column) -> Column:
    """``width, height`` of a picture, both null where its head does not tell; only the head goes to Python."""

    @F.pandas_udf(_SIZE)
    def sizes(head: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(b, k) or (None, None) for b, k in zip(head, kind)], columns=["width", "height"], dtype="Int64")

    kind = image_format(content)
    return sizes(F.when(kind == "TIFF", content).otherwise(F.substring(content, 1, HEAD)), kind)


def inspect(files: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """Inventory with ``format, width, height`` of ``rel, length, content``, and a ``warning`` on what cannot be read.

    A file that no head tells the size of is a row with its warning in place of
    a size. With `most`, the first so many readable files are shown, and one row
    without a name says so where there are more.
    """
    known = inventory(files, depth).drop("extension")
    told = files.select("rel", image_format(F.col("content")).alias("format"), image_size(F.col("content")).alias("_s"))
    j = known.join(told, "rel").select("rel", "name", "size_mb", "format", "_s.width", "_s.height")
    bad = F.col("width").isNull()
    rows = j.withColumn("warning", F.when(bad, F.concat("rel", F.lit(UNREADABLE)))).withColumn("format", F.when(~bad, F.col("format")))
    if most is None:
        return rows
    good = rows.where(F.col("warning").isNull())
    more = good.limit(most + 1).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[:-1]], F.lit(f"Se listan solo los primeros {most} archivos.").alias("warning"))
    return good.orderBy("rel").limit(most).unionByName(rows.where(F.col("warning").isNotNull())).unionByName(more)


def inspect_folder(spark: SparkSession, root: str, **kw) -> DataFrame:
    """Inventory of a folder with the sizes of its pictures; Spark reads the files whole and lists none that is empty, Python sees their heads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return inspect(raw.select(relative(F.col("path"), root).alias("rel"), "length", "content"), **kw)


def image_format(content: Column) -> Column:
    """Format told by the leading bytes; ``SVG`` is named so that it can be refused."""
    def at(pos, n):
        return F.hex(F.substring(content, pos, n))

    head = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    return (
        F.when(at(1, 3) == "FFD8FF", "JPEG").when(at(1, 8) == "89504E470D0A1A0A", "PNG").when(at(1, 4) == "38425053", "PSD")
        .when(at(1, 4).isin("49492A00", "4D4D002A"), "TIFF")
        .when((at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "WEBP")
        .when((at(5, 4) == "66747970") & at(9, 4).isin("61766966", "61766973"), "AVIF")
        .when(F.startswith(F.ltrim(head), F.lit("<?xml")) | F.contains(head, F.lit("<svg")), "SVG"))


def image_rejects(real: Column, magic: Column, w: Column, h: Column, min_side: int, max_pixels: int, allow_psd: bool = False) -> Column:
    """Reasons to refuse a decoded image, in order; empty when it may pass."""
    accepted = ["JPEG", "PNG", "WEBP", "TIFF", "AVIF"] + (["PSD"] if allow_psd else [])
    return F.array_compact(F.array(
        F.when(~F.coalesce(real.isin(*accepted), F.lit(False)), "format"), F.when(~real.eqNullSafe(magic), "signature"),
        F.when((w < min_side) | (h < min_side), "too_small"), F.when(w.cast("bigint") * h > max_pixels, "too_large")))


def extension_kind(filename: Column) -> Column:
    """Kind of a campaign source by extension; null when it is not accepted."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(v) for kv in {**K.EXTENSION_KINDS, **_DOCUMENT_KINDS}.items() for v in kv])
    return F.try_element_at(known, ext)


# Accepted document and font extensions -> kind.
_DOCUMENT_KINDS = {
    "docx": "document", "xlsx": "document", "csv": "document", "tsv": "document", "txt": "document", "md": "document",
    "rtf": "document", "ttf": "font", "otf": "font", "zip": "document",
}


def plain_text(content: Column) -> Column:
    """Text of a document file; null when it holds NUL bytes near its start."""
    nul = F.contains(F.hex(F.substring(content, 1, 4096)), F.lit("00")) & F.exists(
        F.sequence(F.lit(1), F.least(F.lit(4096), F.greatest(F.lit(1), F.octet_length(content)))),
        lambda i: F.hex(F.substr(content, i, F.lit(1))) == "00")
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(~nul, clean_document(text, K.TEXT_LIMIT))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", plain_text(F.col("content")).alias("text"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records with a fixed schema; corrupt ones are left out. Their order is the reader's to choose."""
    df = spark.read.schema(f"{schema}, _bad STRING").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path)
    return df.where(F.col("_bad").isNull()).drop("_bad")


def read_partitioned(spark: SparkSession, path: str, schema: str, states: list[str] | None = None) -> DataFrame:
    """Records under ``client_id=/campaign_id=`` folders, limited to their own tenant and given states.

    The folder columns prune files; a record that names another tenant than its
    folder is dropped.
    """
    df = spark.read.schema(f"{schema}, doc_client STRING, client_id STRING, campaign_id STRING").json(path)
    df = df.where(F.col("doc_client") == F.col("client_id"))
    return df.where(F.col("state").isin(*states)) if states else df


def parse_records(df: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON texts of a table as columns; corrupt ones are left out."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    d = df.withColumn("_r", F.from_json(F.col(text), f"{schema}, _bad STRING", opts))
    return d.where(F.col("_r._bad").isNull()).select(*[c for c in df.columns if c != text], "_r.*").drop("_bad")


def tenant(df: DataFrame, client_id: str, campaign_id: str) -> DataFrame:
    return df.where((F.col("client_id") == client_id) & (F.col("campaign_id") == campaign_id))
