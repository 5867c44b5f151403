"""Queries over pixels and image signatures derived from the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import images as I
from ..operators.skew import many
from ..session import staged
from ..sources import pixels as X
from .base import BIND, ORACLE, Tables, query

# An 8 x 8 picture per vector.
BIND["pix"] = ((), """
SELECT vec_id AS image_id, CAST(pos % 8 AS INT) AS x, CAST(floor(pos / 8) AS INT) AS y, v AS r, CAST((v * 3 + pos) % 256 AS INT) AS g, CAST((v * 7 + vec_id) % 256 AS INT) AS b,
 CAST(CASE WHEN vec_id % 3 = 0 THEN 255 ELSE v END AS INT) AS a FROM {pixel_source}""")
BOXES = "SELECT DISTINCT image_id, CAST(1 AS BIGINT) AS ord, CAST(image_id % 3 AS INT) AS x, CAST(1 AS INT) AS y, CAST(3 + image_id % 4 AS INT) AS width, CAST(5 AS INT) AS height, CASE WHEN image_id % 2 = 0 THEN '#404040' ELSE '#fff' END AS color FROM pix"
_SRC = "(SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 255))) AS INT) AS v FROM embeddings, unnest(range(1, 65)) AS u(i))"
_PIX = "WITH pix AS (" + BIND["pix"][1].replace("{pixel_source}", _SRC) + ")\n"


def pixels(t: Tables):
    e = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    src = e.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.5) * 255))).cast("int").alias("v"))
    return t.spark.sql(BIND["pix"][1], pixel_source=src)


def boxes(t: Tables):
    return t.spark.sql(BOXES.replace("FROM pix", "FROM {pix}"), pix=pixels(t))


@query("palettes", "AGG-21", _PIX + """, b AS (SELECT image_id, (r >> 4 << 4) + 8 AS r, (g >> 4 << 4) + 8 AS g, (b >> 4 << 4) + 8 AS b, count(*) AS n FROM pix GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS m FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m) AS rn FROM m WHERE NOT ((r + g + b) / 3 > 244 OR (r + g + b) / 3 < 14 OR (greatest(r, g, b) - least(r, g, b) < 12 AND (r + g + b) / 3 > 40 AND (r + g + b) / 3 < 225)))
 SELECT image_id, CAST(rn AS INT) AS rn, printf('#%02X%02X%02X', r, g, b) AS colour, n FROM k WHERE rn <= 6""")
def _(t: Tables):
    return I.palette(pixels(t), ["image_id"])


_LUM = " + ".join(f"{k} * CASE WHEN {c} / 255 <= 0.03928 THEN {c} / 255 / 12.92 ELSE power(({c} / 255 + 0.055) / 1.055, 2.4) END" for k, c in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b")))


@query("brand_colours", "AGG-22", _PIX + f""", bn AS (SELECT image_id, r >> 5 AS br, g >> 5 AS bg, b >> 5 AS bb, count(*) AS n, CAST(round_even(avg(r), 0) AS INT) AS r, CAST(round_even(avg(g), 0) AS INT) AS g, CAST(round_even(avg(b), 0) AS INT) AS b FROM pix GROUP BY image_id, r >> 5, g >> 5, b >> 5),
 dm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, br, bg, bb) AS rn FROM bn) WHERE rn <= 5),
 cl AS (SELECT image_id, rn, printf('#%02X%02X%02X', r, g, b) AS hex, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS s, {_LUM} AS l FROM dm),
 br AS (SELECT image_id, CASE WHEN max(s) >= 0.22 THEN arg_max(hex, (s, -rn)) ELSE arg_min(hex, rn) END AS brand FROM cl GROUP BY ALL)
 SELECT image_id, any_value(brand) AS brand, coalesce(arg_min(hex, (l, rn)) FILTER (hex <> brand), arg_min(hex, (l, rn))) AS support FROM cl JOIN br USING (image_id) GROUP BY image_id""")
def _(t: Tables):
    return I.brand_and_support(I.dominant_bins(pixels(t), ["image_id"]), ["image_id"])


def _rounds(n: int) -> str:
    """Rounds of weighted k-means as joins of bins and centres."""
    steps = []
    for i in range(n):
        steps.append(f"""d{i} AS (SELECT b.image_id, b.n, b.sr, b.sg, b.sb, arg_min(c.i, (power(b.r - c.r, 2) + power(b.g - c.g, 2) + power(b.b - c.b, 2), c.i)) AS i FROM bn b JOIN c{i} c USING (image_id) GROUP BY b.image_id, b.br, b.bg, b.bb, b.n, b.sr, b.sg, b.sb),
 m{i} AS (SELECT image_id, i, sum(n) AS n, sum(sr) // sum(n) AS r, sum(sg) // sum(n) AS g, sum(sb) // sum(n) AS b FROM d{i} GROUP BY ALL),
 c{i + 1} AS (SELECT c.image_id, c.i, coalesce(m.n, 0) AS n, coalesce(m.r, c.r) AS r, coalesce(m.g, c.g) AS g, coalesce(m.b, c.b) AS b FROM c{i} c LEFT JOIN m{i} m USING (image_id, i))""")
    return ", ".join(steps)


@query("clustered_colours", "AGG-22", _PIX + f""", bn AS (SELECT *, sr // n AS r, sg // n AS g, sb // n AS b, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, br, bg, bb) AS i FROM (SELECT image_id, r >> 4 AS br, g >> 4 AS bg, b >> 4 AS bb, count(*) AS n, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM pix GROUP BY ALL)),
 c0 AS (SELECT image_id, i, 0 AS n, r, g, b FROM bn WHERE i <= 5), {_rounds(8)}
 SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY n DESC, i) AS INT) AS rn, CAST(n AS BIGINT) AS n, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM c8 WHERE n > 0""")
def _(t: Tables):
    return I.cluster_colours(pixels(t), ["image_id"])


# A campaign's previews: eight pictures of its own, the rest is not looked at.
@query("campaign_palettes", "AGG-21", _PIX + """, pv AS (SELECT image_id % 60 AS campaign_id, image_id, dense_rank() OVER (PARTITION BY image_id % 60 ORDER BY image_id) AS pos, r, g, b FROM pix),
 b AS (SELECT campaign_id, (r >> 4 << 4) + 8 AS r, (g >> 4 << 4) + 8 AS g, (b >> 4 << 4) + 8 AS b, count(*) AS n FROM pv WHERE pos <= 8 GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY n DESC, r, g, b) AS rn FROM b WHERE NOT ((r + g + b) / 3 > 244 OR (r + g + b) / 3 < 14 OR (greatest(r, g, b) - least(r, g, b) < 12 AND (r + g + b) / 3 > 40 AND (r + g + b) / 3 < 225)))
 SELECT campaign_id, CAST(rn AS INT) AS rn, printf('#%02X%02X%02X', r, g, b) AS colour, n FROM k WHERE rn <= 6""")
def _(t: Tables):
    p = pixels(t)
    previews = p.select((F.col("image_id") % 60).alias("campaign_id"), "image_id").distinct().withColumn("ord", F.col("image_id"))
    return I.campaign_palette(p, previews, ["campaign_id"])


@query("region_stats", "AGG-23", _PIX + f""", bx AS ({BOXES}) SELECT p.image_id, ord, CAST(round_even(avg(r), 0) AS INT) AS r, CAST(round_even(avg(g), 0) AS INT) AS g, CAST(round_even(avg(b), 0) AS INT) AS b, round(stddev_pop(floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536)), 6) AS deviation, count(*) AS pixels
 FROM pix p JOIN bx ON bx.image_id = p.image_id AND p.x >= bx.x AND p.x < bx.x + width AND p.y >= bx.y AND p.y < bx.y + height GROUP BY ALL""")
def _(t: Tables):
    return I.region_stats(pixels(t), boxes(t), ["image_id"]).withColumn("deviation", F.round("deviation", 6))


@query("text_backgrounds", "AGG-24", _PIX + f""", bx AS ({BOXES}), j AS (SELECT p.image_id, ord, r, g, b, sqrt(power(r - c, 2) + power(g - c, 2) + power(b - c, 2)) > 70 AS far FROM (SELECT *, CASE WHEN color = '#fff' THEN 255 ELSE 64 END AS c, x AS bx0, y AS by0 FROM bx) b0 JOIN (SELECT * FROM pix) p ON b0.image_id = p.image_id AND p.x >= bx0 AND p.x < bx0 + width AND p.y >= by0 AND p.y < by0 + height)
 SELECT image_id, ord, CAST(round_even(CASE WHEN count_if(far) * 3 < 12 THEN avg(r) ELSE avg(r) FILTER (far) END, 0) AS INT) AS r, CAST(round_even(CASE WHEN count_if(far) * 3 < 12 THEN avg(g) ELSE avg(g) FILTER (far) END, 0) AS INT) AS g, CAST(round_even(CASE WHEN count_if(far) * 3 < 12 THEN avg(b) ELSE avg(b) FILTER (far) END, 0) AS INT) AS b FROM j GROUP BY ALL""")
def _(t: Tables):
    return I.text_background(pixels(t), boxes(t), ["image_id"]).drop("color")


@query("uniform_images", "AGG-25", _PIX + """, m AS (SELECT image_id, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM pix GROUP BY ALL) SELECT image_id, round(avg(CAST(sqrt(power(r - mr, 2) + power(g - mg, 2) + power(b - mb, 2)) <= 20 AS INT)), 9) AS near, min(a) < 255 AS has_alpha, round(avg(CAST(a > 8 AS INT)), 9) AS subject FROM pix JOIN m USING (image_id) GROUP BY ALL""")
def _(t: Tables):
    return I.uniformity(pixels(t), ["image_id"]).select("image_id", F.round("near", 9).alias("near"), "has_alpha", F.round("subject", 9).alias("subject"))


@query("mask_boxes", "AGG-26", _PIX + "SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM pix WHERE a > 150 GROUP BY ALL")
def _(t: Tables):
    return I.mask_boxes(pixels(t), ["image_id"], 150)


@query("flattened_layers", "AGG-27", _PIX + f""", bx AS ({BOXES}), d AS (SELECT image_id, x, y, (abs(r - least(255, r + x * 3)) + abs(g - g) + abs(b - greatest(0, b - 9))) / 3.0 AS diff FROM pix) SELECT d.image_id, ord, round(CAST(avg(diff) AS DOUBLE), 6) AS difference, avg(diff) < 8 AS flattened FROM d JOIN bx ON bx.image_id = d.image_id AND d.x >= bx.x AND d.x < bx.x + width AND d.y >= bx.y AND d.y < bx.y + height GROUP BY ALL""")
def _(t: Tables):
    p = pixels(t)
    plate = p.select("image_id", "x", "y", F.least(F.lit(255), F.col("r") + F.col("x") * 3).alias("r"), "g", F.greatest(F.lit(0), F.col("b") - 9).alias("b"))
    return I.still_flattened(p, plate, boxes(t).withColumn("category", F.lit("logo")), ["image_id"]).withColumn("difference", F.round("difference", 6))


@query("image_signatures", "FN-30 SRC-19", _PIX + """, g AS (SELECT *, CAST(floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536) AS INT) AS v FROM pix), s AS (SELECT image_id, sum(CASE WHEN a.v > n THEN CAST(power(2, 63 - (y * 7 + x)) AS HUGEINT) ELSE 0 END) AS h FROM (SELECT *, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS n FROM g) a GROUP BY ALL)
 SELECT image_id, CAST(CASE WHEN h > 9223372036854775807 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS h0, CAST(floor(avg(r)) AS INT) AS mean_r, CAST(floor(avg(g)) AS INT) AS mean_g, CAST(floor(avg(b)) AS INT) AS mean_b FROM s JOIN pix USING (image_id) GROUP BY ALL""")
def _(t: Tables):
    return I.signatures(pixels(t), ["image_id"], 7, 8).select("image_id", "h0", "mean_r", "mean_g", "mean_b")


def _strips(t: Tables):
    """The same pictures as raw bytes of four channels, cut into strips of two pixel rows."""
    px = F.array_sort(F.collect_list(F.struct("y", "x", *[F.lpad(F.hex(c), 2, "0").alias(c) for c in "bgra"])))
    data = F.unhex(F.array_join(F.transform(px, lambda p: F.concat(p["b"], p["g"], p["r"], p["a"])), ""))
    d = pixels(t).groupBy("image_id").agg(data.alias("data"))
    return X.strips(d.select("image_id", F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(4).alias("c"), "data"), strip_bytes=64)


@query("strip_signatures", "SRC-19 FN-30 AGG-26", ORACLE["image_signatures"].replace("GROUP BY ALL)\n SELECT image_id,", "GROUP BY ALL), bx AS (SELECT image_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM pix WHERE a > 150 GROUP BY ALL)\n SELECT image_id, CAST(any_value(bx.x) AS BIGINT) AS x, CAST(any_value(bx.y) AS BIGINT) AS y, CAST(any_value(width) AS BIGINT) AS width, CAST(any_value(height) AS BIGINT) AS height,").replace("JOIN pix USING (image_id)", "JOIN pix USING (image_id) LEFT JOIN bx USING (image_id)"))
def _(t: Tables):
    sums = staged(X.strip_sums(_strips(t), 8, 8, 150), "strip-sums")
    whole = X.picture_sums(sums)
    s = I.signatures_of_sums(whole, X.picture_cells(sums), ["image_id"], 7).select("image_id", "h0", "mean_r", "mean_g", "mean_b")
    s = many(s).join(whole.select("image_id", "x", "y", "width", "height"), "image_id")
    return s.withColumn("image_id", F.col("image_id").cast("bigint"))


@query("strip_palettes", "SRC-19 AGG-21", ORACLE["palettes"].replace(", b AS (SELECT", ", fl AS (SELECT image_id, " + ", ".join(f"CAST(round_even(({c} * a + 255 * (255 - a)) / 255, 0) AS INT) AS {c}" for c in "rgb") + " FROM pix), b AS (SELECT").replace("AS n FROM pix", "AS n FROM fl"))
def _(t: Tables):
    return I.palette(X.flatten_alpha(X.colour_counts(_strips(t))), ["image_id"]).withColumn("image_id", F.col("image_id").cast("bigint"))


def _images(t: Tables):
    s = I.signatures(pixels(t), ["image_id"], 7, 8)
    # Every picture is a cut-out that can be a product of its piece: none is left out.
    return s.withColumns({"doc": F.col("image_id") % 5, "piece_id": F.col("image_id") % 40, "xref": F.col("image_id").cast("int") + 1, "alpha": F.lit(True), "ratio": F.lit(0.3)})


@query("repeated_images", "JOI-31", _PIX + """, g AS (SELECT *, CAST(floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536) AS INT) AS v FROM pix), s AS (SELECT image_id, sum(CASE WHEN a.v > n THEN CAST(power(2, 63 - (y * 7 + x)) AS HUGEINT) ELSE 0 END) AS h FROM (SELECT *, lead(v) OVER (PARTITION BY image_id, y ORDER BY x) AS n FROM g) a GROUP BY ALL),
 m AS (SELECT image_id, h, floor(avg(r)) AS mr, floor(avg(g)) AS mg, floor(avg(b)) AS mb FROM s JOIN pix USING (image_id) GROUP BY ALL)
 SELECT a.image_id, bool_or(b.image_id IS NOT NULL) AS repeated FROM m a LEFT JOIN m b ON a.image_id % 5 = b.image_id % 5 AND a.image_id % 40 <> b.image_id % 40 AND bit_count(xor(a.h, b.h)) <= 24 AND greatest(abs(a.mr - b.mr), abs(a.mg - b.mg), abs(a.mb - b.mb)) <= 18 GROUP BY ALL""")
def _(t: Tables):
    return I.repeated_images(_images(t), ["doc"]).select("image_id", "repeated")


@query("colour_maths", "FN-20 FN-21 FN-32", """WITH c AS (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_size * 5) % 256 AS b FROM part), l AS (SELECT *, 0.2126 * CASE WHEN r / 255 <= 0.03928 THEN r / 255 / 12.92 ELSE power((r / 255 + 0.055) / 1.055, 2.4) END + 0.7152 * CASE WHEN g / 255 <= 0.03928 THEN g / 255 / 12.92 ELSE power((g / 255 + 0.055) / 1.055, 2.4) END
 + 0.0722 * CASE WHEN b / 255 <= 0.03928 THEN b / 255 / 12.92 ELSE power((b / 255 + 0.055) / 1.055, 2.4) END AS lum FROM c)
 SELECT p_partkey, printf('#%02X%02X%02X', r, g, b) AS hex, round(lum, 6) AS luminance, round(1.05 / (lum + 0.05), 6) AS on_white, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round((greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b), 6) END AS saturation,
 CASE WHEN 1.05 / (lum + 0.05) >= (lum + 0.05) / (0.2126 * 0.005605391624202723 + 0.7152 * 0.005605391624202723 + 0.0722 * 0.005605391624202723 + 0.05) THEN '#FFFFFF' ELSE '#111111' END AS ink FROM l""")
def _(t: Tables):
    k = F.col("p_partkey")
    c = C.rgb(k % 256, (k * 7) % 256, (F.col("p_size") * 5) % 256)
    d = t.part.select("p_partkey", C.valid_hex(F.lower(C.rgb_to_hex(c))).alias("hex")).withColumn("c", C.hex_to_rgb(F.col("hex")))
    return d.select("p_partkey", "hex", F.round(C.luminance(F.col("c")), 6).alias("luminance"), F.round(C.contrast(F.col("c"), C.rgb(255, 255, 255)), 6).alias("on_white"),
                    F.round(C.saturation(F.col("c")), 6).alias("saturation"), C.readable_text(F.col("c"), F.lit("")).alias("ink"))




@query("plate_inks", "FN-21", """WITH c AS (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_size * 5) % 256 AS b FROM part),
 l AS (SELECT p_partkey, """ + " + ".join(f"{k} * CASE WHEN {c} / 255 <= 0.03928 THEN {c} / 255 / 12.92 ELSE power(({c} / 255 + 0.055) / 1.055, 2.4) END" for k, c in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b"))) + """ AS lum FROM c),
 k AS (SELECT *, 1.05 / (lum + 0.05) AS cw, (lum + 0.05) / (0.2126 * power((17 / 255 + 0.055) / 1.055, 2.4) + 0.7152 * power((19 / 255 + 0.055) / 1.055, 2.4) + 0.0722 * power((34 / 255 + 0.055) / 1.055, 2.4) + 0.05) AS cd FROM l)
 SELECT p_partkey, CASE WHEN cw >= 3 THEN '#FFFFFF' WHEN greatest(cd, 1 / cd) >= 3 THEN '#111322' WHEN cw >= greatest(cd, 1 / cd) THEN '#FFFFFF' ELSE '#111322' END AS ink FROM k""")
def _(t: Tables):
    k = F.col("p_partkey")
    c = C.rgb(k % 256, (k * 7) % 256, (F.col("p_size") * 5) % 256)
    return t.part.select("p_partkey", C.rgb_to_hex(C.ink_for(c, F.lit(""))).alias("ink"))
