"""Queries over placements and layers: geometry, scores, clusters, projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geometry as G
from ..functions import layers as L
from ..functions import sizes as S
from ..operators import catalog as C
from ..operators import projects as P
from ..operators import quality as Q
from ..operators import spatial as S2
from ..operators import art_reads as A
from ..session import staged
from .base import Tables, big, ctes, query

V = ["variant_id"]
PJ = ["project_id"]
_BLEED = "(width >= canvas_w * 0.92 AND height >= canvas_h * 0.92)"
_IX = "greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x))::BIGINT * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"
_MAND = "('logo','headline','subheadline','price','cta','legal')"
_OVER = f""", ov AS (SELECT * FROM (SELECT a.variant_id, a.ord AS a_ord, b.ord AS b_ord, {_IX} / greatest(1, least(a.width::BIGINT * a.height, b.width::BIGINT * b.height)) AS ratio,
 CASE WHEN (a.category = 'product' AND b.category IN {_MAND}) OR (b.category = 'product' AND a.category IN {_MAND}) THEN 0.08 WHEN a.type = 'text' OR b.type = 'text' THEN 0.16 ELSE 0.30 END AS threshold
 FROM placements a JOIN placements b ON a.variant_id = b.variant_id AND a.ord < b.ord
 WHERE NOT (a.width >= a.canvas_w * 0.92 AND a.height >= a.canvas_h * 0.92) AND NOT (b.width >= b.canvas_w * 0.92 AND b.height >= b.canvas_h * 0.92)
 AND a.category <> 'decoration' AND b.category <> 'decoration' AND NOT (a.pinned AND b.pinned AND a.category <> 'product' AND b.category <> 'product')) WHERE ratio > threshold)
"""


@query("overlap_pairs", "JOI-24", ctes("placements") + _OVER + "SELECT variant_id, a_ord, b_ord, round(ratio, 6) AS ratio, CASE WHEN ratio > greatest(0.45, threshold) THEN 'severe' ELSE 'moderate' END AS severity FROM ov")
def _(t: Tables):
    return S2.overlaps(t.bind("placements"), V).select("variant_id", "a_ord", "b_ord", F.round("ratio", 6).alias("ratio"), "severity")


_FILL = f""", content AS (SELECT * FROM placements WHERE NOT {_BLEED}), gr AS (SELECT variant_id, greatest(0, least(64, CAST(trunc(x / canvas_w * 64) AS INT))) AS x0, greatest(0, least(64, CAST(trunc(y / canvas_h * 64) AS INT))) AS y0,
 CAST(trunc((x + width) / canvas_w * 64) AS INT) AS x1, CAST(trunc((y + height) / canvas_h * 64) AS INT) AS y1 FROM content),
 cells AS (SELECT DISTINCT variant_id, cx, cy FROM gr, unnest(range(x0, least(64, greatest(x0 + 1, least(64, x1))))) AS a(cx), unnest(range(y0, least(64, greatest(y0 + 1, least(64, y1))))) AS b(cy)),
 fill AS (SELECT variant_id, count(*) / 4096 AS fill FROM cells GROUP BY ALL)
"""


@query("union_coverage", "AGG-06", ctes("placements") + _FILL + "SELECT variant_id, fill FROM fill")
def _(t: Tables):
    p = t.bind("placements")
    return S2.union_coverage(p.where(~G.full_bleed(G.box(), F.col("canvas_w"), F.col("canvas_h"))), V)


_BANDS = f""", bands AS (SELECT variant_id, greatest(0, min(y)) / max(canvas_h) AS t, greatest(0, max(canvas_h) - max(y + height)) / max(canvas_h) AS b, greatest(0, min(x)) / max(canvas_w) AS l,
 greatest(0, max(canvas_w) - max(x + width)) / max(canvas_w) AS r FROM placements WHERE NOT {_BLEED} GROUP BY ALL)
"""


@query("dead_bands", "AGG-07", ctes("placements") + _BANDS + "SELECT variant_id, t AS top, b AS bottom, l AS \"left\", r AS \"right\" FROM bands")
def _(t: Tables):
    return S2.dead_bands(t.bind("placements").where(~G.full_bleed(G.box(), F.col("canvas_w"), F.col("canvas_h"))), V)


_METRICS = f""", pm AS (SELECT variant_id, count_if(NOT (pinned AND {_BLEED}) AND (x < 0 OR y < 0 OR x + width > canvas_w OR y + height > canvas_h)) AS outside_canvas,
 count_if(NOT pinned AND least(x, y, canvas_w - (x + width), canvas_h - (y + height)) < round_even(least(canvas_w, canvas_h) * 0.035, 0) * 0.6) AS tight_margins,
 count_if(type = 'text' AND font_size / canvas_h < CASE WHEN category = 'headline' THEN 0.022 ELSE 0.008 END) AS small_text,
 count_if(coalesce(type = 'text' AND contrast < 4.5, false)) AS low_contrast_text,
 count_if(type = 'image' AND preserve_aspect AND NOT stretch AND layer_h > 0 AND height > 0 AND abs(want - width / height) / greatest(want, 0.0001) > greatest(0.02, 1.5 / greatest(1, least(width, height)))) AS distorted_layers,
 count(*) AS elements, count_if(type = 'text') AS text_elements, count_if(category = 'product') AS products,
 sum(width::BIGINT * height) FILTER (category = 'product') / max(canvas_w::BIGINT * canvas_h) AS cover, arg_min(width / canvas_w, ord) FILTER (category = 'logo') AS logo,
 list(category) AS present, count_if(NOT {_BLEED}) AS content, bool_and({_BLEED} OR pinned) AS all_pinned, max(canvas_w) AS cw, max(canvas_h) AS ch
 FROM (SELECT *, CASE WHEN rotation <> 0 AND NOT pixel_critical THEN (layer_w * abs(cos(radians(rotation))) + layer_h * abs(sin(radians(rotation)))) / (layer_w * abs(sin(radians(rotation))) + layer_h * abs(cos(radians(rotation)))) ELSE layer_w / layer_h END AS want FROM placements)
 GROUP BY variant_id)
"""


@query("placement_metrics", "AGG-09 AGG-11 AGG-12", big(ctes("placements") + _METRICS + """SELECT variant_id, outside_canvas, tight_margins, small_text, low_contrast_text, distorted_layers, elements, text_elements,
 coalesce(floor(cover * 1000000), 0) / 1000000 AS product_coverage, floor(logo * 1000000) / 1000000 AS logo_width_ratio FROM pm""", "outside_canvas", "tight_margins", "small_text", "low_contrast_text", "distorted_layers", "text_elements"))
def _(t: Tables):
    m = Q.placement_metrics(t.bind("placements"), V)
    return m.select("variant_id", "outside_canvas", "tight_margins", "small_text", "low_contrast_text", "distorted_layers", "elements", "text_elements",
                    (F.coalesce(F.floor(F.col("_cover") * 1000000), F.lit(0)) / 1000000).alias("product_coverage"), (F.floor(F.col("_logo") * 1000000) / 1000000).alias("logo_width_ratio"))


_RELH = """, pr AS (SELECT variant_id, ord, name, height, height_cm, CASE WHEN count(height_cm) OVER w >= 2 THEN greatest(0.30, coalesce(height_cm, avg(height_cm) OVER w) / max(height_cm) OVER w) ELSE 1.0 END AS ratio,
 count(height_cm) OVER w >= 2 AS real FROM placements WHERE category = 'product' WINDOW w AS (PARTITION BY variant_id))
"""
_CONF = _RELH + """, cf AS (SELECT a.variant_id, a.ord AS a_ord, b.ord AS b_ord FROM pr a JOIN pr b ON a.variant_id = b.variant_id AND a.ord < b.ord WHERE a.real AND a.height_cm IS NOT NULL AND b.height_cm IS NOT NULL
 AND abs((a.height / b.height) - (a.ratio / b.ratio)) / (a.ratio / b.ratio) > 0.22)
"""


@query("relative_heights", "WIN-06", ctes("placements") + _RELH + "SELECT variant_id, ord, round(ratio, 6) AS ratio, real FROM pr")
def _(t: Tables):
    p = t.bind("placements").where(F.col("category") == "product").select("variant_id", "ord", "name", "height", "height_cm")
    return Q.relative_heights(p, V).select("variant_id", "ord", F.round("ratio", 6).alias("ratio"), "real")


@query("proportion_conflicts", "WIN-07", ctes("placements") + _CONF + "SELECT * FROM cf")
def _(t: Tables):
    p = t.bind("placements").where(F.col("category") == "product").select("variant_id", "ord", "name", "height", "height_cm")
    return Q.proportion_conflicts(p, V).select("variant_id", "a_ord", "b_ord")


def _variants(t: Tables):
    k = F.col("variant_id")
    cats = F.when(k % 2 == 0, F.array(*[F.lit(c) for c in ("logo", "cta", "product")])).otherwise(F.array(F.lit("legal")))
    return t.bind("placements").select("variant_id").distinct().select(
        "variant_id", F.when(k % 4 == 0, 900).otherwise(1080).alias("source_w"), F.when(k % 4 == 1, 1080).otherwise(660).alias("source_h"), (k % 5 == 0).alias("from_psd"),
        F.when(k % 6 == 0, 2).otherwise(0).alias("rewritten"), (k % 12 == 0).alias("has_font"), cats.alias("project_categories"),
        F.when(k % 10 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).when(k % 10 == 5, F.array(F.lit("Falta el texto legal en la variante."), F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("extra_warnings"))


_SCORE = _OVER + _FILL + _BANDS + _METRICS + _CONF + """, vs AS (SELECT variant_id, CASE WHEN variant_id % 4 = 0 THEN 900 ELSE 1080 END AS sw, CASE WHEN variant_id % 4 = 1 THEN 1080 ELSE 660 END AS sh FROM placements GROUP BY ALL),
 j AS (SELECT pm.*, variant_id AS k, coalesce(sev, 0) AS sev, coalesce(md, 0) AS md, coalesce(fill, 0) AS f, coalesce(t, 0) AS t, coalesce(b, 0) AS b, coalesce(l, 0) AS l, coalesce(r, 0) AS r, coalesce(nc, 0) AS nc,
  abs((cw / ch) / (sw / sh) - 1) <= 0.18 AS native FROM pm JOIN vs USING (variant_id) LEFT JOIN fill USING (variant_id) LEFT JOIN bands USING (variant_id)
  LEFT JOIN (SELECT variant_id, count_if(ratio > greatest(0.45, threshold)) AS sev, count_if(ratio <= greatest(0.45, threshold)) AS md FROM ov GROUP BY ALL) USING (variant_id)
  LEFT JOIN (SELECT variant_id, count(*) AS nc FROM cf GROUP BY ALL) USING (variant_id)),
 lb AS (SELECT *, NOT native AND ((least(t, b) >= 0.08 AND t + b >= 0.18) OR (least(l, r) >= 0.08 AND l + r >= 0.18)) AS letterbox FROM j),
 pen AS (SELECT *, outside_canvas * 12 + sev * 18 + md * 6 + tight_margins * 3 + CASE WHEN products = 0 THEN 0 WHEN cover < 0.06 THEN 10 WHEN cover > 0.68 THEN 7 ELSE 0 END
  + CASE WHEN logo < 0.055 THEN 8 ELSE 0 END + small_text * 6 + low_contrast_text * 7 + CASE WHEN elements < 3 THEN 10 * (3 - elements) ELSE 0 END
  + CASE WHEN text_elements = 0 AND k % 5 <> 0 THEN 12 ELSE 0 END + CASE WHEN k % 6 = 0 AND k % 12 <> 0 THEN 8 ELSE 0 END
  + CASE WHEN k % 2 = 0 THEN CASE WHEN NOT list_contains(present, 'logo') THEN 6 ELSE 0 END + CASE WHEN NOT list_contains(present, 'cta') THEN 6 ELSE 0 END ELSE CASE WHEN NOT list_contains(present, 'legal') THEN 6 ELSE 0 END END
  + distorted_layers * 15 + CASE WHEN content = 0 THEN 0 WHEN f < 0.12 THEN 30 WHEN f < 0.34 AND NOT (native AND all_pinned) THEN CAST(round_even(4 + 14 * least(1.0, (0.34 - f) / (0.34 - 0.12)), 0) AS INT) WHEN f >= 0.34 AND f > 0.95 THEN 6 ELSE 0 END
  + CASE WHEN letterbox THEN 20 ELSE 0 END + CASE WHEN nc > 0 THEN 22 + 8 * (nc - 1) ELSE 0 END + CASE WHEN k % 10 = 0 THEN 4 WHEN k % 10 = 5 THEN CASE WHEN list_contains(present, 'legal') THEN 4 ELSE 2 END ELSE 0 END AS p FROM lb)
"""


@query("quality_scores", "AGG-08 AGG-10 SET-06", big(ctes("placements") + _SCORE + """SELECT variant_id, CAST(greatest(0, least(100, 100 - p)) AS INT) AS score, CAST(p AS BIGINT) AS penalties, sev AS severe_overlaps, md AS moderate_overlaps, nc AS product_scale_conflicts,
round_even(f, 4) AS fill_ratio, CAST(letterbox AS INT) AS letterbox, CAST(content > 0 AND f < 0.12 AS INT) AS empty_composition, distorted_layers, outside_canvas FROM pen""", "severe_overlaps", "moderate_overlaps", "distorted_layers", "outside_canvas"))
def _(t: Tables):
    s = Q.score_variants(t.bind("placements"), _variants(t))
    return s.select("variant_id", "score", F.col("penalties").cast("bigint").alias("penalties"), "severe_overlaps", "moderate_overlaps", "product_scale_conflicts",
                    "fill_ratio", "letterbox", "empty_composition", "distorted_layers", "outside_canvas")


@query("blocking_defects", "PRJ-13", ctes("placements") + _SCORE + """SELECT variant_id, array_to_string(list_filter([CASE WHEN nc > 0 THEN 'proporciones irreales entre los productos' END, CASE WHEN sev > 0 THEN 'solapamientos graves' END,
 CASE WHEN outside_canvas > 0 THEN 'elementos fuera del lienzo' END, CASE WHEN distorted_layers > 0 THEN 'capas deformadas' END, CASE WHEN content > 0 AND f < 0.12 THEN 'la pieza es casi todo fondo' END,
 CASE WHEN letterbox THEN 'el arte flota en una franja del lienzo' END], lambda y: y IS NOT NULL), ';') AS defects FROM pen""")
def _(t: Tables):
    s = Q.score_variants(t.bind("placements"), _variants(t))
    return s.select("variant_id", F.array_join(Q.blocking_defects(), ";").alias("defects"))


@query("missing_elements", "AGG-10", ctes("placements") + """SELECT variant_id, array_to_string(list_filter(['logo', 'cta', 'legal'], lambda c: list_contains(CASE WHEN variant_id % 2 = 0 THEN ['logo', 'cta', 'product'] ELSE ['legal'] END, c) AND NOT list_contains(cats, c)), ',') AS missing
 FROM (SELECT variant_id, list(category) AS cats FROM placements GROUP BY ALL)""")
def _(t: Tables):
    m = Q.missing_elements(t.bind("placements"), _variants(t), V)
    return m.select("variant_id", F.array_join("missing", ",").alias("missing"))


def _pct(c: str) -> str:
    return f"CAST(CAST(round_even({c} * 100, 0) AS INT) AS VARCHAR)"


_FLAGGED = f"""SELECT *, type = 'text' AND font_size / canvas_h < CASE WHEN category = 'headline' THEN 0.022 ELSE 0.008 END AS f_small, coalesce(type = 'text' AND contrast < 4.5, false) AS f_low,
 NOT (pinned AND {_BLEED}) AND (x < 0 OR y < 0 OR x + width > canvas_w OR y + height > canvas_h) AS f_out, NOT pinned AND least(x, y, canvas_w - (x + width), canvas_h - (y + height)) < round_even(least(canvas_w, canvas_h) * 0.035, 0) * 0.6 AS f_tight,
 type = 'image' AND preserve_aspect AND NOT stretch AND layer_h > 0 AND height > 0 AND abs(want - width / height) / greatest(want, 0.0001) > greatest(0.02, 1.5 / greatest(1, least(width, height))) AS f_dist
 FROM (SELECT *, CASE WHEN rotation <> 0 AND NOT pixel_critical THEN (layer_w * abs(cos(radians(rotation))) + layer_h * abs(sin(radians(rotation)))) / (layer_w * abs(sin(radians(rotation))) + layer_h * abs(cos(radians(rotation)))) ELSE layer_w / layer_h END AS want FROM placements)"""
_PIECE_SQL = {
    "small_product": "products > 0 AND cover < 0.06", "large_product": "products > 0 AND cover > 0.68", "small_logo": "logo < 0.055", "text_in_image": "text_elements = 0 AND k % 5 = 0", "no_text": "text_elements = 0 AND k % 5 <> 0",
    "logo": "k % 2 = 0 AND NOT list_contains(present, 'logo')", "cta": "k % 2 = 0 AND NOT list_contains(present, 'cta')", "legal": "k % 2 = 1 AND NOT list_contains(present, 'legal')", "crowded": "content > 0 AND f >= 0.34 AND f > 0.95"}
_WARN = _SCORE + f""", fl AS ({_FLAGGED}), wr AS (
 SELECT variant_id, 10 AS s, ord AS a, 0::BIGINT AS b, concat('''', name, ''' sale del lienzo.') AS text FROM fl WHERE f_out
 UNION ALL SELECT variant_id, 30, ord, 0, concat('''', name, ''' está demasiado cerca del margen.') FROM fl WHERE f_tight AND category IN ('cta', 'logo')
 UNION ALL SELECT variant_id, 60, ord, 0, concat('''', name, ''' puede ser ilegible (', font_size, 'px en ', canvas_h, 'px).') FROM fl WHERE f_small
 UNION ALL SELECT variant_id, 60, ord, 1, concat('Contraste insuficiente en ''', name, ''' (', CAST(round_even(contrast, 1) AS DOUBLE), ':1, mínimo 4.5:1).') FROM fl WHERE f_low
 UNION ALL SELECT variant_id, 90, ord, 0, concat('''', name, ''' cambió su relación de aspecto (revisar renderer).') FROM fl WHERE f_dist
 UNION ALL SELECT o.variant_id, 20, a_ord, b_ord, CASE WHEN ratio > greatest(0.45, threshold) THEN concat('Solapamiento fuerte entre ''', x.name, ''' y ''', y.name, '''.') ELSE concat('El producto invade ''', CASE WHEN x.category = 'product' THEN y.name ELSE x.name END, '''.') END
  FROM ov o JOIN placements x ON x.variant_id = o.variant_id AND x.ord = a_ord JOIN placements y ON y.variant_id = o.variant_id AND y.ord = b_ord WHERE ratio > greatest(0.45, threshold) OR threshold = 0.08
 UNION ALL SELECT variant_id, 1, a_ord, b_ord, concat('Proporción irreal: ''', big, ''' sale ', CAST(round_even(d, 1) AS DOUBLE), '× el alto de ''', small, ''' y por tamaño real le toca ', CAST(round_even(e, 1) AS DOUBLE), '×.') FROM (
  SELECT c.variant_id, a_ord, b_ord, CASE WHEN a.height / b.height > a.ratio / b.ratio THEN a.name ELSE b.name END AS big, CASE WHEN a.height / b.height > a.ratio / b.ratio THEN b.name ELSE a.name END AS small,
   CASE WHEN a.height / b.height > a.ratio / b.ratio THEN a.height / b.height ELSE 1 / (a.height / b.height) END AS d, CASE WHEN a.height / b.height > a.ratio / b.ratio THEN a.ratio / b.ratio ELSE 1 / (a.ratio / b.ratio) END AS e
  FROM cf c JOIN pr a ON a.variant_id = c.variant_id AND a.ord = a_ord JOIN pr b ON b.variant_id = c.variant_id AND b.ord = b_ord)
 UNION ALL SELECT variant_id, 2, 0, 0, 'El arte flota en una franja del lienzo: el ' || {_pct("greatest(t + b, l + r)")} || '% queda como relleno vacío arriba y abajo (o a los lados). Este formato necesita repartir el diseño, no solo encogerlo.' FROM pen WHERE letterbox
 UNION ALL SELECT variant_id, 3, 0, 0, 'La pieza es casi todo fondo: el contenido cubre el ' || {_pct("f")} || '% del lienzo. Este formato no se puede sacar de este arte.' FROM pen WHERE content > 0 AND f < 0.12
 UNION ALL SELECT variant_id, 70, 0, 0, 'La composición solo tiene ' || elements || ' elemento(s): falta contenido (producto, texto y logo).' FROM pen WHERE elements < 3
 UNION ALL SELECT variant_id, 72, 0, 0, '2 texto(s) reescrito(s) con la tipografía del sistema y no con la de marca: suba el .ttf/.otf y se recalculan solos.' FROM pen WHERE k % 6 = 0 AND k % 12 <> 0
 UNION ALL SELECT variant_id, 100, 0, 0, 'La composición tiene demasiado espacio vacío: el contenido cubre el ' || {_pct("f")} || '% del lienzo.' FROM pen WHERE content > 0 AND f >= 0.12 AND f < 0.34 AND NOT (native AND all_pinned)
 {" ".join(f"UNION ALL SELECT variant_id, {n}, 0, 0, '{text}' FROM pen WHERE {_PIECE_SQL[key]}" for key, (n, text) in Q.PIECE_TEXTS.items())}
 UNION ALL SELECT variant_id, 110, CAST(i AS BIGINT), 0, (['a', 'b', 'a'])[i] FROM pen, unnest(range(1, 4)) AS u(i) WHERE k % 10 = 0
 UNION ALL SELECT variant_id, 110, CAST(i AS BIGINT), 0, (['Falta el texto legal en la variante.', 'c'])[i] FROM pen, unnest(range(1, 3)) AS u(i) WHERE k % 10 = 5),
 wd AS (SELECT variant_id, text, min((s, a, b)) AS place FROM wr GROUP BY ALL), wk AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY place, text) AS rn FROM wd)
 SELECT variant_id, string_agg(text, chr(10) ORDER BY rn) AS warnings FROM wk WHERE rn <= 10 GROUP BY ALL"""


@query("quality_warnings", "AGG-08 SET-06", ctes("placements") + _WARN)
def _(t: Tables):
    return Q.quality_warnings(t.bind("placements"), _variants(t), V).select("variant_id", F.array_join("warnings", "\n").alias("warnings"))


@query("best_attempts", "WIN-13 PRJ-20", """WITH a AS (SELECT l_orderkey AS variant_id, l_linenumber AS attempt, CAST(max(l_quantity) AS INT) AS score, CAST(min(l_suppkey) % 3 AS INT) AS defects FROM lineitem GROUP BY ALL),
 e AS (SELECT variant_id, least(coalesce(min(attempt) FILTER (defects = 0), 3), 3, max(attempt)) AS tried FROM a GROUP BY ALL), r AS (SELECT a.*, tried, row_number() OVER (PARTITION BY variant_id ORDER BY score DESC, attempt) AS rk FROM a JOIN e USING (variant_id) WHERE attempt <= tried)
 SELECT variant_id, attempt, score, defects, tried, 5000 + variant_id + 7919 * attempt AS seed FROM r WHERE rk = 1""")
def _(t: Tables):
    a = t.lineitem.groupBy(F.col("l_orderkey").alias("variant_id"), F.col("l_linenumber").alias("attempt")).agg(
        F.max("l_quantity").cast("int").alias("score"), (F.min("l_suppkey") % 3).cast("int").alias("defects"))
    return Q.best_attempts(a, V).withColumn("seed", C.retry_seed(F.lit(5000) + F.col("variant_id"), F.col("attempt")))


@query("harmonised_products", "WIN-15", ctes("placements") + _RELH + """, q AS (SELECT pr.*, p.x, p.y, p.width, floor(p.y / 200) AS slot_y FROM pr JOIN placements p USING (variant_id, ord)),
 g AS (SELECT *, min(height / ratio) OVER w AS unit, max(y + height) OVER w AS flr, min(slot_y) OVER w AS lo, max(slot_y) OVER w AS hi, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY variant_id)),
 s AS (SELECT *, greatest(8, CAST(round_even(ratio * unit, 0) AS INT)) AS nh FROM g), u AS (SELECT *, greatest(8, CAST(round_even(nh * (width / greatest(1, height)), 0) AS INT)) AS nw FROM s)
 SELECT variant_id, ord, real, CAST(CASE WHEN n < 2 THEN x ELSE x + floor((width - nw) / 2) END AS INT) AS x, CAST(CASE WHEN n < 2 THEN y WHEN lo = hi THEN flr - nh ELSE y + floor((height - nh) / 2) END AS INT) AS y,
 CAST(CASE WHEN n < 2 THEN width ELSE nw END AS INT) AS width, CAST(CASE WHEN n < 2 THEN height ELSE nh END AS INT) AS height FROM u""")
def _(t: Tables):
    p = t.bind("placements").where(F.col("category") == "product").withColumn("slot_y", F.floor(F.col("y") / 200).cast("double"))
    return Q.harmonise_products(p.select("variant_id", "ord", "x", "y", "width", "height", "height_cm", "slot_y"), V)


@query("redistributed_gaps", "WIN-14", ctes("placements") + """, hole AS (SELECT variant_id, min_by({'x': x, 'y': y, 'w': width, 'h': height}, ord) AS h FROM placements WHERE ln = 3 GROUP BY ALL),
 c AS (SELECT p.*, h, lag(y + height) OVER (PARTITION BY variant_id ORDER BY y, x, ord) AS prev FROM (SELECT p.*, h, least(h.x + h.w, x + width) - greatest(h.x, x) AS common FROM placements p JOIN hole USING (variant_id) WHERE ln <> 3) p
  WHERE common > 0 AND common / greatest(1, least(h.w, width)) >= 0.25),
 g AS (SELECT *, CASE WHEN prev IS NULL THEN 0.0 ELSE greatest(1.0, y - prev - CASE WHEN h.y >= prev - 1 AND h.y + h.h <= y + 1 THEN h.h ELSE 0 END) END AS w FROM c),
 t AS (SELECT *, count(*) OVER v AS n, min(y) OVER v AS top, sum(height) OVER v AS heights, sum(w) OVER v AS total, last_value(y + height) OVER (PARTITION BY variant_id ORDER BY y, x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS bottom,
  coalesce(sum(height) OVER (PARTITION BY variant_id ORDER BY y, x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hs, sum(w) OVER (PARTITION BY variant_id ORDER BY y, x, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ws
  FROM g WINDOW v AS (PARTITION BY variant_id))
 SELECT variant_id, ord, y AS old_y, CAST(round_even(CAST(top + hs + (bottom - top - heights) * ws / total AS DOUBLE), 0) AS INT) AS new_y FROM t WHERE n >= 2 AND bottom - top - heights > 0""")
def _(t: Tables):
    p = t.bind("placements").withColumn("pinned", F.lit(True))
    holes = p.where(F.col("ln") == 3).groupBy("variant_id").agg(F.min_by(F.struct("x", "y", "width", "height"), "ord").alias("h")).select("variant_id", "h.*")
    return Q.redistribute_gaps(p.where(F.col("ln") != 3), holes, V)


@query("reading_order", "WIN-03", ctes("placements") + """, b AS (SELECT *, floor(y / greatest(24, floor(min(height) OVER (PARTITION BY variant_id) / 2))) AS band FROM placements)
 SELECT variant_id, ord, row_number() OVER (PARTITION BY variant_id ORDER BY band, x, ord) AS rank FROM b""")
def _(t: Tables):
    return S2.reading_order(t.bind("placements"), V).select("variant_id", "ord", "rank")


@query("reading_axis", "AGG-34", ctes("placements") + """SELECT variant_id, CASE WHEN w / h >= 1.8 THEN 'x' WHEN w / h <= 0.6 THEN 'y' WHEN sx >= sy THEN 'x' ELSE 'y' END AS axis FROM (SELECT variant_id, max(canvas_w) AS w, max(canvas_h) AS h,
 max((x + width / 2) / canvas_w) - min((x + width / 2) / canvas_w) AS sx, max((y + height / 2) / canvas_h) - min((y + height / 2) / canvas_h) AS sy FROM placements GROUP BY ALL)""")
def _(t: Tables):
    return S2.reading_axis(t.bind("placements"), V)


_CL = """SELECT p.variant_id AS image_id, ord, CAST(CASE WHEN axis = 'x' THEN x ELSE y END AS DOUBLE) AS s0, CAST(CASE WHEN axis = 'x' THEN x + width ELSE y + height END AS DOUBLE) AS e0, CASE WHEN axis = 'x' THEN y + height / 2 ELSE x + width / 2 END AS m FROM placements p JOIN
 (SELECT variant_id, CASE WHEN w / h >= 1.8 THEN 'x' WHEN w / h <= 0.6 THEN 'y' WHEN sx >= sy THEN 'x' ELSE 'y' END AS axis FROM (SELECT variant_id, max(canvas_w) AS w, max(canvas_h) AS h,
 max((x + width / 2) / canvas_w) - min((x + width / 2) / canvas_w) AS sx, max((y + height / 2) / canvas_h) - min((y + height / 2) / canvas_h) AS sy FROM placements GROUP BY ALL)) a USING (variant_id)"""
_CL_HIT = "len(list_filter(st, lambda k: k.c = list_max(list_transform(st, lambda z: z.c)) AND least(s.e0, k.e0) - greatest(s.s0, k.s0) > 0 AND (least(s.e0, k.e0) - greatest(s.s0, k.s0)) / least(s.e0 - s.s0, k.e0 - k.s0) >= 0.5)) > 0"


def _steps(source: str, order: str, init: str, step: str, out: str) -> str:
    """A fold over the boxes of each image in order, for the check engine."""
    return f""", src AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS n FROM ({source})),
 f AS (SELECT image_id, n, {init} AS st FROM src WHERE n = 1 UNION ALL SELECT s.image_id, s.n, {step} FROM f JOIN src s ON s.image_id = f.image_id AND s.n = f.n + 1),
 fin AS (SELECT f.image_id, st FROM f JOIN (SELECT image_id, max(n) AS n FROM src GROUP BY ALL) USING (image_id, n)) {out}"""


@query("axis_clusters", "WIN-16", (ctes("placements") + _steps(
    _CL, "s0, m, ord", "[{'ord': ord, 's0': s0, 'e0': e0, 'c': 0}]",
    "list_append(st, {'ord': s.ord, 's0': s.s0, 'e0': s.e0, 'c': list_max(list_transform(st, lambda z: z.c)) + CASE WHEN " + _CL_HIT + " THEN 0 ELSE 1 END})",
    "SELECT image_id AS variant_id, k.ord, k.c AS cluster FROM (SELECT image_id, unnest(st) AS k FROM fin)")).replace("WITH ", "WITH RECURSIVE ", 1))
def _(t: Tables):
    p = staged(t.bind("placements").select("variant_id", "ord", "canvas_w", "canvas_h", "x", "y", "width", "height"), "axis-boxes")
    return S2.axis_clusters(p.join(S2.reading_axis(p, V), V).select("variant_id", "ord", "axis", "x", "y", "width", "height"), V).select("variant_id", "ord", "cluster")


@query("union_boxes", "AGG-29", ctes("placements") + """SELECT variant_id, min(x) AS x, min(y) AS y, greatest(1, max(x + width) - min(x)) AS width, greatest(1, max(y + height) - min(y)) AS height FROM placements WHERE category = 'product' GROUP BY ALL""")
def _(t: Tables):
    return S2.union_box(t.bind("placements").where(F.col("category") == "product"), V)


_BOXES = "SELECT variant_id AS image_id, ord, x, y, width, height FROM placements WHERE type = 'image'"


@query("text_share", "JOI-27", ctes("placements") + f"""SELECT a.variant_id AS image_id, a.ord, round(least(1.0, sum(CASE WHEN b.ord IS NULL THEN 0 ELSE {_IX} END) / any_value(greatest(1, a.width::BIGINT * a.height))), 6) AS text_share
 FROM placements a LEFT JOIN placements b ON b.variant_id = a.variant_id AND b.type = 'text' WHERE a.type = 'image' GROUP BY a.variant_id, a.ord""")
def _(t: Tables):
    p = t.bind("placements").withColumnRenamed("variant_id", "image_id")
    cols = ["image_id", "ord", "x", "y", "width", "height"]
    return S2.text_share(p.where(F.col("type") == "image").select(*cols), p.where(F.col("type") == "text").select(*cols), ["image_id"]).select(
        "image_id", "ord", F.round("text_share", 6).alias("text_share"))


def _keep_sql(source: str, order: str, cond: str) -> str:
    box = "{'ord': %sord, 'x': %sx, 'y': %sy, 'width': %swidth, 'height': %sheight}"
    step = f"CASE WHEN len(list_filter(st, lambda k: {cond})) > 0 THEN st ELSE list_append(st, {box % (('s.',) * 5)}) END"
    sql = ctes("placements") + _steps(source, order, f"[{box % (('',) * 5)}]", step, "SELECT image_id, k.ord, k.x, k.y, k.width, k.height FROM (SELECT image_id, unnest(st) AS k FROM fin)")
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


_IN = "greatest(0, least(s.x + s.width, k.x + k.width) - greatest(s.x, k.x))::BIGINT * greatest(0, least(s.y + s.height, k.y + k.height) - greatest(s.y, k.y))"


_NO_PLATES = f"""SELECT a.variant_id AS image_id, a.ord, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.width) AS width, any_value(a.height) AS height FROM placements a
 LEFT JOIN placements b ON b.variant_id = a.variant_id AND b.type = 'text' WHERE a.type = 'image' AND a.width >= 20 AND a.height >= 20 GROUP BY a.variant_id, a.ord
 HAVING least(1.0, sum(CASE WHEN b.ord IS NULL THEN 0 ELSE {_IX} END) / any_value(greatest(1, a.width::BIGINT * a.height))) < {K.TEXT_PLATE_RATIO}"""


@query("containment_suppression", "JOI-26", _keep_sql(_NO_PLATES, "-width::BIGINT * height, ord", f"{_IN} > 0.6 * greatest(1, s.width::BIGINT * s.height)"))
def _(t: Tables):
    cols = ["image_id", "ord", "x", "y", "width", "height"]
    p = staged(t.bind("placements").withColumnRenamed("variant_id", "image_id").select(*cols, "type"), "image-boxes")
    images = p.where((F.col("type") == "image") & (F.col("width") >= 20) & (F.col("height") >= 20)).select(*cols)
    area = -F.col("width").cast("bigint") * F.col("height")
    return S2.greedy_keep(S2.without_plates(images, p.where(F.col("type") == "text").select(*cols), ["image_id"]), ["image_id"], [area], 0.6)


@query("iou_deduplication", "JOI-25", _keep_sql("SELECT variant_id AS image_id, ord, CAST(floor(x / 200) AS INT) AS x, CAST(floor(y / 200) AS INT) AS y, 2 AS width, 2 AS height FROM placements",
                                                "ord", f"{_IN} > 0.7 * (s.width * s.height + k.width * k.height - {_IN})"))
def _(t: Tables):
    p = t.bind("placements").withColumnRenamed("variant_id", "image_id").select("image_id", "ord", F.floor(F.col("x") / 200).cast("int").alias("x"), F.floor(F.col("y") / 200).cast("int").alias("y"), F.lit(2).alias("width"), F.lit(2).alias("height"))
    return S2.greedy_keep(p, ["image_id"], [F.col("ord")], 0.7, "iou")


@query("largest_regions", "TOP-06", ctes("placements") + """SELECT image_id, ord, rn FROM (SELECT variant_id AS image_id, ord, CAST(row_number() OVER (PARTITION BY variant_id ORDER BY width::BIGINT * height DESC, ord) AS INT) AS rn FROM placements
 WHERE width::BIGINT * height / (canvas_w::BIGINT * canvas_h) BETWEEN 0.004 AND 0.85 AND width >= 16 AND height >= 16) WHERE rn <= 3""")
def _(t: Tables):
    from ..operators.skew import top_per_group

    share = F.col("width").cast("bigint") * F.col("height") / (F.col("canvas_w").cast("bigint") * F.col("canvas_h"))
    p = t.bind("placements").where(share.between(0.004, 0.85) & (F.col("width") >= 16) & (F.col("height") >= 16)).withColumnRenamed("variant_id", "image_id")
    return top_per_group(p, ["image_id"], [(F.col("width").cast("bigint") * F.col("height")).desc(), F.col("ord")], 3).select("image_id", "ord", "rn")


_FACE = ", det AS (SELECT * FROM placements WHERE ln <= 4), fc AS (SELECT variant_id, x + width / 2 AS cx, y + height / 2 AS cy FROM placements WHERE ln > 4)"


@query("visual_classes", "JOI-28", ctes("placements") + _FACE + """, d AS (SELECT *, EXISTS (SELECT 1 FROM fc WHERE fc.variant_id = det.variant_id AND cx BETWEEN x AND x + width AND cy BETWEEN y AND y + height) AS face, width * height / (canvas_w * canvas_h) AS sh,
  (x + width / 2) / canvas_w AS px, (y + height / 2) / canvas_h AS py, width / height AS ar FROM det),
 e AS (SELECT *, min(ord) FILTER (NOT face AND (py < 0.18 OR py > 0.88) AND (px < 0.3 OR px > 0.7) AND sh < 0.06 AND ar BETWEEN 0.25 AND 6) OVER (PARTITION BY variant_id) AS lg FROM d),
 f AS (SELECT *, min(ord) FILTER (NOT face AND sh >= 0.05 AND ord IS DISTINCT FROM lg) OVER (PARTITION BY variant_id) AS pd FROM e)
 SELECT variant_id, ord, CASE WHEN face THEN 'person' WHEN ord = lg THEN 'logo' WHEN ord = pd THEN 'product' ELSE 'decoration' END AS visual FROM f""")
def _(t: Tables):
    p = t.bind("placements")
    return P.classify_visual(p.where(F.col("ln") <= 4), p.where(F.col("ln") > 4), V).select("variant_id", "ord", "visual")


@query("layers_under_zone", "JOI-29", ctes("layers") + """SELECT project_id, ord, name FROM (SELECT *, greatest(0, least(canvas_w * 0.1 + canvas_w * 0.5, x + width) - greatest(canvas_w * 0.1, x)) * greatest(0, least(canvas_h * 0.2 + canvas_h * 0.6, y + height) - greatest(canvas_h * 0.2, y)) / greatest(1, width * height) AS s
 FROM layers WHERE visible AND category NOT IN ('background', 'product', 'decoration')) WHERE s >= 0.35""")
def _(t: Tables):
    l = t.bind("layers")
    z = l.select("project_id").distinct().select("project_id", F.lit(0.1).alias("zx"), F.lit(0.2).alias("zy"), F.lit(0.5).alias("zw"), F.lit(0.6).alias("zh"))
    return P.under_zone(l, z, PJ)


@query("product_neighbours", "JOI-30", ctes("layers") + """, lv AS (SELECT * FROM layers WHERE visible AND NOT external), g AS (SELECT *, greatest(12, CAST(floor(least(canvas_w, canvas_h) * 0.04) AS INT)) AS reach FROM lv WHERE type = 'image' AND category = 'decoration'
  AND regexp_matches(lower(name), '^(capa|layer)\\s*\\d+') AND width / height BETWEEN 0.45 AND 2.4 AND width * height / (canvas_w * canvas_h) BETWEEN 0.015 AND 0.25)
 SELECT DISTINCT g.project_id, g.layer_id FROM g JOIN lv a ON a.project_id = g.project_id AND a.category = 'product'
 AND greatest(g.x - (a.x + a.width), a.x - (g.x + g.width), 0) <= reach AND greatest(g.y - (a.y + a.height), a.y - (g.y + g.height), 0) <= reach""")
def _(t: Tables):
    return P.product_neighbours(t.bind("layers"), PJ)


@query("usable_layers", "PRJ-09 PRJ-10", ctes("layers") + """SELECT project_id, ord, (type = 'text' AND trim(coalesce(content, '')) <> '') OR (type = 'image' AND coalesce(src, '') <> '') AS usable, z_index FROM layers
 WHERE visible AND category <> 'background' AND (type = 'image' OR trim(coalesce(content, '')) <> '')""")
def _(t: Tables):
    l = P.template_layers(t.bind("layers"))
    ok = P.usable(t.bind("layers")).select("project_id", "ord").withColumn("usable", F.lit(True))
    return l.join(ok, ["project_id", "ord"], "left").select("project_id", "ord", F.coalesce("usable", F.lit(False)).alias("usable"), "z_index")


@query("planning_labels", "PRJ-11", ctes("layers") + """SELECT project_id, ord, CASE WHEN category = 'background' THEN NULL WHEN ln = 2 OR NOT visible THEN CASE WHEN coalesce(src, '') <> '' OR trim(coalesce(content, '')) <> '' THEN 'removed' END
 WHEN type = 'image' AND coalesce(src, '') = '' THEN 'no_image' WHEN type = 'text' AND trim(coalesce(content, '')) = '' THEN 'empty_text' ELSE 'working' END AS label FROM layers""")
def _(t: Tables):
    l = t.bind("layers").withColumn("hidden", F.when(F.col("ln") == 2, F.array("layer_id")).otherwise(F.array().cast("array<string>")))
    return l.select("project_id", "ord", P.planning_label().alias("label"))


@query("erasable_boxes", "PRJ-14", ctes("layers") + """, c AS (SELECT *, greatest(0, least(canvas_w, x)) AS l, greatest(0, least(canvas_h, y)) AS t, greatest(0, least(canvas_w, x + width)) AS r, greatest(0, least(canvas_h, y + height)) AS b FROM layers l0
  WHERE visible AND NOT EXISTS (SELECT 1 FROM layers f WHERE f.project_id = l0.project_id AND f.name = l0.name AND f.category = 'background'))
 SELECT project_id, ord, CAST(l AS INT) AS x0, CAST(t AS INT) AS y0, CAST(r AS INT) AS x1, CAST(b AS INT) AS y1 FROM c WHERE r > l AND b > t AND NOT ((r - l) / canvas_w >= 0.85 AND (b - t) / canvas_h >= 0.85) AND (r - l)::BIGINT * (b - t) <= canvas_w::BIGINT * canvas_h * 0.45""")
def _(t: Tables):
    l = t.bind("layers")
    m = l.select("project_id", "ord", "name", "visible", "canvas_w", "canvas_h", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    return P.erasable_boxes(m, l.where(F.col("category") == "background"), PJ)


@query("clipped_boxes", "PRJ-15", ctes("placements") + """SELECT variant_id, ord, greatest(0, x) AS x, greatest(0, y) AS y, least(canvas_w, x + width) - greatest(0, x) AS width, least(canvas_h, y + height) - greatest(0, y) AS height FROM placements
 WHERE least(canvas_w, x + width) - greatest(0, x) >= 120 AND least(canvas_h, y + height) - greatest(0, y) >= 120""")
def _(t: Tables):
    b = t.bind("placements").select("variant_id", "ord", "canvas_w", "canvas_h", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    return P.clip_to_canvas(b).select("variant_id", "ord", "x", "y", "width", "height")


@query("geometry_classes", "FN-11", ctes("placements") + """, s AS (SELECT *, (width * height) / (canvas_w * canvas_h) AS sh, (x + width / 2) / canvas_w AS cx, (y + height / 2) / canvas_h AS cy, width / height AS ar, height / canvas_h AS hr FROM placements),
 c AS (SELECT *, CASE WHEN sh >= 0.92 THEN 'background' WHEN ar >= 2.5 AND hr < 0.22 THEN 'strip' WHEN sh < 0.05 AND (cy < 0.22 OR cy > 0.85) AND (cx < 0.32 OR cx > 0.68) THEN 'corner' WHEN ar BETWEEN 0.35 AND 2.4 AND hr >= 0.3 AND sh <= 0.6 THEN 'product' ELSE 'decoration' END AS k FROM s),
 f AS (SELECT *, min(ord) FILTER (k = 'corner') OVER (PARTITION BY variant_id) AS lg FROM c)
 SELECT variant_id, ord, CASE WHEN k = 'background' THEN 'background' WHEN k = 'corner' AND ord = lg THEN 'logo' WHEN k = 'product' THEN 'product' ELSE 'decoration' END AS geo_category,
 CAST(CASE WHEN k = 'background' THEN 0.6 WHEN k = 'strip' THEN 0.45 WHEN k = 'corner' AND ord = lg THEN 0.45 WHEN k = 'corner' THEN 0.4 WHEN k = 'product' THEN 0.5 ELSE 0.35 END AS DOUBLE) AS geo_confidence FROM f""")
def _(t: Tables):
    return P.classify_by_geometry(t.bind("placements").withColumn("opaque", F.lit(1.0)), V).select("variant_id", "ord", "geo_category", "geo_confidence")


@query("layer_name_classes", "FN-11 FN-12", ctes("layers") + """SELECT project_id, ord, CASE pk % 8 WHEN 2 THEN 'logo' WHEN 3 THEN 'price' WHEN 6 THEN 'cta' END AS category, pk % 8 IN (0, 7) AS generic,
 CASE WHEN type = 'text' THEN NULL WHEN pk % 8 = 2 THEN 'logo' WHEN pk % 8 = 5 THEN 'fixed_decoration' END AS role FROM layers""")
def _(t: Tables):
    l = t.bind("layers")
    kind = F.when(F.col("type") == "text", "type").otherwise("pixel")
    return l.select("project_id", "ord", L.category_by_name(F.col("name"), F.lit("art/capas"))["category"].alias("category"), L.generic_name(F.col("name")).alias("generic"),
                    L.asset_role(F.col("name"), kind, F.lit(False)).alias("role"))


@query("product_sizes", "FN-05 FN-06 FN-07 AGG-18", ctes("layers") + """, txt AS (SELECT project_id, count_if(content LIKE 'Refri%') > 0 AS refri FROM layers WHERE type = 'text' GROUP BY ALL), one AS (SELECT project_id, count(*) AS n FROM layers WHERE category = 'product' AND visible GROUP BY ALL)
 SELECT l.project_id, l.ord, CASE WHEN pk % 8 = 1 THEN 'cocina' WHEN pk % 8 = 4 THEN 'televisor' WHEN n = 1 AND refri THEN 'refrigeradora' END AS family_key,
 CASE WHEN pk % 8 IN (1, 4) THEN 'nombre' WHEN n = 1 AND refri THEN 'arte' END AS source,
 CAST(CASE WHEN pk % 8 = 1 THEN 90.0 WHEN pk % 8 = 4 THEN round_even(55 * 9 / sqrt(337) * 2.54 * 1.08, 1) WHEN n = 1 AND refri THEN 170.0 END AS DOUBLE) AS height_cm FROM layers l LEFT JOIN txt USING (project_id) LEFT JOIN one USING (project_id) WHERE category = 'product'""")
def _(t: Tables):
    l = t.bind("layers").withColumn("replaced_from", F.lit(None).cast("string")).withColumn("source_name", F.lit(None).cast("string"))
    return P.worth_measuring(l, PJ).select("project_id", "ord", "family_key", "source", "height_cm")


@query("artwork_text", "AGG-18", ctes("layers") + """SELECT project_id, string_agg(trim(content), ' · ' ORDER BY ord) AS art_text FROM layers WHERE type = 'text' AND trim(coalesce(content, '')) <> '' GROUP BY ALL""")
def _(t: Tables):
    return P.artwork_text(t.bind("layers"), PJ)


@query("replacement_target", "TOP-03", ctes("layers") + """SELECT project_id, layer_id, category FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY category <> 'product', -width::BIGINT * height, ord) AS rk FROM layers WHERE type = 'image' AND category <> 'background' AND replaceable) WHERE rk = 1""")
def _(t: Tables):
    return P.replacement_target(t.bind("layers"), PJ)


@query("layer_twins", "JOI-32", ctes("layers") + """, r AS (SELECT *, row_number() OVER (PARTITION BY project_id, category ORDER BY z_index, ord) AS rank FROM layers)
 SELECT a.project_id, a.category, a.layer_id AS source_layer, b.layer_id AS target_layer FROM r a LEFT JOIN r b ON b.project_id = a.project_id + 1 AND b.category = a.category AND b.rank = a.rank""")
def _(t: Tables):
    l = t.bind("layers")
    return P.twins(l, l.withColumn("project_id", F.col("project_id") - 1), PJ).select("project_id", "category", "source_layer", "target_layer")


_ROLES = ", ro AS (SELECT DISTINCT project_id, CASE WHEN pk % 2 = 0 THEN name ELSE name || ' copia' END AS name, 'r' || CAST(length(name) AS STRING) AS role FROM layers WHERE ln % 2 = 0)"


@query("propagated_roles", "JOI-33 FN-31", ctes("layers") + _ROLES + """, nr AS (SELECT *, lower(trim(regexp_replace(name, '(\\s+cop(y|ia))+(\\s+\\d+)*$', '', 'i'))) AS n FROM ro), one AS (SELECT project_id, n, min(role) AS role FROM nr GROUP BY ALL HAVING count(DISTINCT name) = 1)
 SELECT l.project_id, l.ord, coalesce(e.role, o.role) AS role FROM layers l LEFT JOIN ro e ON e.project_id = l.project_id AND e.name = l.name
 LEFT JOIN one o ON o.project_id = l.project_id AND o.n = lower(trim(regexp_replace(l.name, '(\\s+cop(y|ia))+(\\s+\\d+)*$', '', 'i')))""")
def _(t: Tables):
    l = t.bind("layers")
    roles = l.where(F.col("ln") % 2 == 0).select("project_id", F.when(F.col("pk") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" copia"))).alias("name"),
                                                 F.concat(F.lit("r"), F.length("name").cast("string")).alias("role")).distinct()
    return P.propagate_roles(l, roles, PJ).select("project_id", "ord", "role")


@query("override_actions", "JOI-34", ctes("layers") + """, w AS (SELECT project_id, CASE WHEN ln = 5 THEN layer_id || 'x' ELSE layer_id END AS layer_id, CASE WHEN pk % 3 = 0 THEN ' ' WHEN pk % 3 = 1 THEN ' Texto 3' ELSE 'nuevo' END AS new_text FROM layers),
 v AS (SELECT * FROM w WHERE trim(new_text) <> '') SELECT coalesce(l.project_id, v.project_id) AS project_id, coalesce(l.layer_id, v.layer_id) AS layer_id, CASE WHEN l.layer_id IS NULL THEN 'unknown' WHEN v.layer_id IS NULL THEN 'restore' ELSE 'apply' END AS action, new_text
 FROM layers l FULL JOIN v ON v.project_id = l.project_id AND v.layer_id = l.layer_id WHERE l.layer_id IS NULL OR (v.layer_id IS NULL AND l.pk % 4 = 0) OR (v.layer_id IS NOT NULL AND coalesce(l.content, '') <> trim(new_text))""")
def _(t: Tables):
    l = t.bind("layers")
    w = l.select("project_id", F.when(F.col("ln") == 5, F.concat("layer_id", F.lit("x"))).otherwise(F.col("layer_id")).alias("layer_id"),
                                               F.when(F.col("pk") % 3 == 0, " ").when(F.col("pk") % 3 == 1, " Texto 3").otherwise("nuevo").alias("new_text"))
    cur = l.select("project_id", "layer_id", F.coalesce("content", F.lit("")).alias("current"), (F.col("pk") % 4 == 0).alias("rewritten"))
    return P.override_actions(cur, w, PJ)


@query("snapshot_rebuild", "JOI-36", ctes("layers") + """SELECT l.project_id, l.layer_id, CASE WHEN s.pk % 2 = 0 THEN 'guardado' ELSE l.content END AS content, CASE WHEN s.pk % 3 = 0 THEN '#111111' ELSE '#222222' END AS color, s.pk % 3 <> 0 AS auto_contrast FROM layers s JOIN layers l ON l.project_id = s.project_id AND l.layer_id = s.layer_id WHERE l.ln <> 4""")
def _(t: Tables):
    l = t.bind("layers")
    saved = l.select("project_id", "layer_id", F.when(F.col("pk") % 2 == 0, "guardado").alias("content"), F.when(F.col("pk") % 3 == 0, "#111111").otherwise("").alias("color"), F.lit("").alias("font"))
    live = l.where(F.col("ln") != 4).select("project_id", "layer_id", "content", F.lit("#222222").alias("color"), F.lit("f").alias("font"))
    return P.snapshot(saved, live, PJ).select("project_id", "layer_id", "content", "color", "auto_contrast")


@query("unique_slot_names", "WIN-02", ctes("layers") + """SELECT project_id, ord, CASE WHEN n = 1 THEN category ELSE category || '_' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY project_id, category ORDER BY ord) AS n FROM layers)""")
def _(t: Tables):
    return P.numbered_names(t.bind("layers"), PJ, "category", [F.col("ord")], F.floor(F.col("ord") / 1e12), "_").select("project_id", "ord", "unique_name")


_LINES = "SELECT l_suppkey AS art, CAST(ord AS BIGINT) AS ord, CAST(top AS INT) AS top, CAST(top + 9 + l_partkey % 3 AS INT) AS bottom, CAST(80 + l_partkey % 25 AS INT) AS span FROM (SELECT *, l_orderkey * 10 + l_linenumber AS ord, l_orderkey * 12 AS top FROM lineitem WHERE l_linenumber = 1)"


@query("ink_runs", "WIN-05", """WITH y AS (SELECT DISTINCT l_suppkey AS art, l_partkey AS y FROM lineitem), g AS (SELECT *, y - row_number() OVER (PARTITION BY art ORDER BY y) AS isl FROM y)
 SELECT art, min(y) AS start, max(y) AS stop FROM g GROUP BY art, isl""")
def _(t: Tables):
    rows = t.lineitem.select(F.col("l_suppkey").alias("art"), F.col("l_partkey").alias("y")).distinct().withColumn("ink", F.lit(True))
    return P.runs(rows, ["art"]).select("art", "start", "stop")


@query("paragraph_blocks", "WIN-18", """WITH l AS (SELECT l_suppkey AS art, l_orderkey AS ord, CAST(l_orderkey * 12 AS INT) AS top, CAST(l_orderkey * 12 + 9 + l_partkey % 3 AS INT) AS bottom, CAST(80 + l_partkey % 25 AS INT) AS span, CAST(l_partkey % 5 * 10 AS INT) AS c, CAST(10 + l_partkey % 3 AS INT) AS h FROM lineitem),
 p AS (SELECT *, lag(bottom) OVER w AS pb, lag(h) OVER w AS ph, lag(c) OVER w AS pc FROM l WINDOW w AS (PARTITION BY art ORDER BY top, ord, bottom, span)),
 b AS (SELECT *, CAST(sum(CASE WHEN ph IS NULL OR top - pb - 1 > greatest(ph, h) * 0.9 OR greatest(ph, h) / greatest(1, least(ph, h)) > 1.3 OR sqrt(3 * (pc - c) * (pc - c)) > 70 THEN 1 ELSE 0 END) OVER (PARTITION BY art ORDER BY top, ord, bottom, span ROWS UNBOUNDED PRECEDING) AS INT) AS block FROM p),
 g AS (SELECT art, block, count(*) AS lines, max(h) AS hi, min(h) AS lo, max(span) AS wide, max((top, ord)) AS ending FROM b GROUP BY ALL),
 r AS (SELECT b.art, b.block, min(span / wide) AS fill FROM b JOIN g USING (art, block) WHERE (top, ord) < ending GROUP BY ALL)
 SELECT art, block, lines, lines < 2 OR (hi <= lo * 1.15 AND coalesce(fill >= 0.85, true)) AS is_paragraph FROM g LEFT JOIN r USING (art, block)""")
def _(t: Tables):
    l = t.lineitem.select(F.col("l_suppkey").alias("art"), F.col("l_orderkey").alias("ord"), (F.col("l_orderkey") * 12).cast("int").alias("top"), (F.col("l_orderkey") * 12 + 9 + F.col("l_partkey") % 3).cast("int").alias("bottom"),
                          (F.lit(80) + F.col("l_partkey") % 25).cast("int").alias("span"), *[(F.col("l_partkey") % 5 * 10).cast("int").alias(c) for c in "rgb"])
    return P.paragraphs(l, ["art"])


@query("free_bands", "WIN-04", ctes("reads") + """, s AS (SELECT DISTINCT art_id, canvas_h AS h, greatest(0, y0) AS a, least(canvas_h, y1) AS e FROM reads WHERE greatest(0, y0) < least(canvas_h, y1)),
 g AS (SELECT art_id, h, coalesce(max(e) OVER (PARTITION BY art_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0, a AS g1 FROM s UNION ALL SELECT art_id, any_value(canvas_h), coalesce(max(least(canvas_h, y1)) FILTER (greatest(0, y0) < least(canvas_h, y1)), 0), any_value(canvas_h) FROM reads GROUP BY art_id),
 b AS (SELECT *, row_number() OVER (PARTITION BY art_id ORDER BY g1 - g0 DESC, g0) AS rk FROM g WHERE g1 > g0)
 SELECT art_id, CAST(64 AS INT) AS x0, CAST(g0 + floor((g1 - g0) * 0.06) AS INT) AS y0, CAST(1015 AS INT) AS x1, CAST(g1 - floor((g1 - g0) * 0.06) AS INT) AS y1 FROM b WHERE rk = 1 AND g1 - g0 >= h * 0.18""")
def _(t: Tables):
    return S2.free_band(t.bind("reads").select("art_id", "canvas_w", "canvas_h", "y0", "y1"), ["art_id"])


def _slots_sql() -> str:
    """Slots in chain order, each with its best line that no slot before it took, for the check engine."""
    def m(pattern):
        return f"regexp_matches(t, '{pattern}')"

    price = f"({m(chr(92) + 'd')} AND ({m(K.ART_MONEY)} OR {m(K.ART_BEFORE)} OR {m(K.ART_ONLY_FIGURE)}))"
    rules = {"logo": ("role = 'brand'", "0"), "legal": (f"{m(K.ART_LEGAL)} OR (y0 / canvas_h > 0.88 AND h / canvas_h < 0.035)", "h"), "validity": (f"h / canvas_h <= 0.05 AND {m(K.ART_VALIDITY)}", "0"),
             "discount": (m(K.ART_PERCENT), "0"), "installment": (m(K.ART_INSTALLMENT), "0"), "previous_price": (f"{price} AND {m(K.ART_BEFORE)}", "-h"), "price": (price, "-h"),
             "cta": (f"{m(K.ART_CTA)} AND length(t) <= 40", "0"), "headline": ("true", "-h")}
    out = ctes("reads") + f""", live AS (SELECT *, replace(text, 'é', 'e' || chr(769)) AS t, y1 - y0 AS h FROM reads WHERE confidence >= {K.ART_MIN_CONFIDENCE} AND x1 > x0 AND y1 > y0 AND (x1 - x0)::BIGINT * (y1 - y0) <= canvas_w::BIGINT * canvas_h * {K.ART_MAX_FIELD}),
 s0 AS (SELECT art_id, '' AS slot, ord FROM live WHERE false)"""
    for i, (slot, (cond, rank)) in enumerate(rules.items()):
        out += f""", s{i + 1} AS (SELECT * FROM s{i} UNION ALL SELECT art_id, '{slot}', arg_min(ord, ({rank}, ord)) FROM live l WHERE ({cond}) AND NOT EXISTS (SELECT 1 FROM s{i} u WHERE u.art_id = l.art_id AND u.ord = l.ord) GROUP BY art_id)"""
    return out + f""", flat AS (SELECT s.art_id, s.slot, s.ord, x0, y0, x1, y1 FROM s{len(rules)} s JOIN live USING (art_id, ord)),
 sub AS (SELECT l.art_id, arg_min(l.ord, (l.y0, l.ord)) AS ord FROM live l JOIN flat f ON f.art_id = l.art_id AND f.slot = 'headline' WHERE l.y0 >= f.y1 AND l.y0 - f.y1 < l.canvas_h * 0.10 AND NOT EXISTS (SELECT 1 FROM flat u WHERE u.art_id = l.art_id AND u.ord = l.ord) GROUP BY l.art_id),
 slots AS (SELECT * FROM flat UNION ALL SELECT art_id, 'subheadline', ord, x0, y0, x1, y1 FROM sub JOIN live USING (art_id, ord))
"""


@query("art_slots", "FN-08", _slots_sql() + "SELECT * FROM slots")
def _(t: Tables):
    return A.assign_slots(t.bind("reads"), ["art_id"])


@query("art_slot_colours", "FN-09", _slots_sql() + """, last AS (SELECT art_id, x0, y0, x1, y1, arg_max(color, ord) AS color FROM reads GROUP BY ALL)
 SELECT art_id, slot, upper(color) AS color FROM slots JOIN last USING (art_id, x0, y0, x1, y1) WHERE regexp_matches(color, '^#[0-9a-fA-F]{6}$')""")
def _(t: Tables):
    return A.slot_colours(t.bind("reads"), ["art_id"])


_UW = "(1::DOUBLE - %s::DOUBLE - %s::DOUBLE)"


def _safe_sql() -> str:
    left, top, right, bottom = K.DEFAULT_SAFE
    uw, uh = _UW % (left, right), _UW % (top, bottom)
    return f""", n AS (SELECT *, round_even(greatest(0::DOUBLE, least(0.99::DOUBLE, (x0 / canvas_w - {left}::DOUBLE) / {uw})), 4) AS x, round_even(greatest(0::DOUBLE, least(0.99::DOUBLE, (y0 / canvas_h - {top}::DOUBLE) / {uh})), 4) AS y FROM every),
 b AS (SELECT *, least(round_even((x1 - x0) / canvas_w / {uw}, 4), round_even(1::DOUBLE - x, 4)) AS width, least(round_even((y1 - y0) / canvas_h / {uh}, 4), round_even(1::DOUBLE - y, 4)) AS height FROM n)"""


@query("art_placements", "FN-23", _slots_sql() + """, sp AS (SELECT DISTINCT art_id, canvas_h AS h, greatest(0, y0) AS a, least(canvas_h, y1) AS e FROM reads WHERE x1 > x0 AND y1 > y0 AND greatest(0, y0) < least(canvas_h, y1)),
 gp AS (SELECT art_id, h, coalesce(max(e) OVER (PARTITION BY art_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g0, a AS g1 FROM sp UNION ALL SELECT art_id, h, max(e), h FROM sp GROUP BY art_id, h),
 bp AS (SELECT *, row_number() OVER (PARTITION BY art_id ORDER BY g1 - g0 DESC, g0) AS rk FROM gp WHERE g1 > g0),
 band AS (SELECT art_id, 'product' AS slot, CAST(trunc(1080 * 0.06) AS INT) AS x0, CAST(g0 + trunc((g1 - g0) * 0.06) AS INT) AS y0, CAST(trunc(1080 * 0.94) AS INT) AS x1, CAST(g1 - trunc((g1 - g0) * 0.06) AS INT) AS y1 FROM bp WHERE rk = 1 AND g1 - g0 >= h * """ + str(K.MIN_PRODUCT_BAND) + """),
 every AS (SELECT e.*, canvas_w, canvas_h FROM (SELECT art_id, slot, x0, y0, x1, y1 FROM slots UNION ALL SELECT * FROM band WHERE y1 > y0) e JOIN (SELECT DISTINCT art_id, canvas_w, canvas_h FROM reads) USING (art_id))""" + _safe_sql() + """
 SELECT art_id, CASE WHEN canvas_h = 1350 THEN 'portrait' ELSE 'square' END AS aspect, slot, x, y, width, height FROM b WHERE width > 0 AND height > 0""")
def _(t: Tables):
    safe = F.struct(*[F.lit(v).alias(n) for n, v in zip(("left", "top", "right", "bottom"), K.DEFAULT_SAFE)])
    return A.art_placements(t.bind("reads"), ["art_id"], safe)


# ------------------------------------------------------------------- formats
_ARTS = ", arts AS (SELECT p_partkey AS art_id, CAST(p_size * 40 AS INT) AS width, CAST(200 + p_partkey % 1500 AS INT) AS height, CAST(p_partkey % 6 AS INT) AS layers FROM part)"


def _arts(t: Tables):
    return t.part.select(F.col("p_partkey").alias("art_id"), (F.col("p_size") * 40).cast("int").alias("width"), (F.lit(200) + F.col("p_partkey") % 1500).cast("int").alias("height"), (F.col("p_partkey") % 6).cast("int").alias("layers"))


_COV = "(width * least(f.width / a.width, f.height / a.height)) * (a.height * least(f.width / a.width, f.height / a.height)) / (f.width::DOUBLE * f.height)".replace("(width *", "(a.width *")


@query("art_format_coverage", "JOI-14 FN-25", ctes("formats") + _ARTS + f"""SELECT art_id, f.id AS format_id, floor({_COV} * 1000000) / 1000000 AS coverage, layers >= 3 OR {_COV} >= 0.45 AS viable, round(greatest(f.width / a.width, f.height / a.height), 6) AS upscale,
 floor(abs((f.width / f.height) / (a.width / a.height) - 1) * 1000000) / 1000000 AS delta FROM arts a CROSS JOIN formats f""")
def _(t: Tables):
    d = C.art_formats(_arts(t), "layers")
    w = [F.col(c) for c in ("width", "height", "fw", "fh")]
    return d.select("art_id", "format_id", (F.floor(F.col("coverage") * 1000000) / 1000000).alias("coverage"), "viable", F.round(G.cover_upscale(*w), 6).alias("upscale"), (F.floor(G.aspect_delta(*w) * 1000000) / 1000000).alias("delta"))


@query("worst_format_fit", "AGG-30 TOP-07", ctes("formats") + _ARTS + f""", c AS (SELECT f.id AS format_id, a.art_id, a.layers, {_COV} AS coverage, CAST(3 + a.art_id % 5 AS INT) AS total, CAST(a.art_id % 3 AS INT) AS fits FROM arts a CROSS JOIN formats f)
 SELECT format_id, arg_min(total, (fits - total, art_id)) AS total, arg_min(fits, (fits - total, art_id)) AS fits, floor(min(coverage) * 1000000) / 1000000 AS coverage, min(coverage) >= 0.45 AS recommended, min(coverage) < 0.45 AND bool_or(layers < 3) AS needs_split FROM c GROUP BY ALL""")
def _(t: Tables):
    d = C.art_formats(_arts(t), "layers").withColumn("art_ord", F.col("art_id")).withColumn("total", (F.lit(3) + F.col("art_id") % 5).cast("int")).withColumn("fits", (F.col("art_id") % 3).cast("int"))
    return C.worst_fit(d).select("format_id", "total", "fits", (F.floor(F.col("coverage") * 1000000) / 1000000).alias("coverage"), "recommended", "needs_split")


@query("native_formats", "TOP-04", ctes("formats") + _ARTS + """SELECT art_id, native FROM (SELECT a.art_id, f.id AS native, row_number() OVER (PARTITION BY a.art_id ORDER BY NOT (f.width = a.width AND f.height = a.height), abs(f.width / f.height - a.width / a.height), abs(f.width - a.width) + abs(f.height - a.height), f.ord) AS rk
 FROM arts a CROSS JOIN formats f WHERE f.platform = 'Personalizado') WHERE rk = 1""")
def _(t: Tables):
    return C.nearest_native(_arts(t), ["art_id"])


@query("auto_formats", "TOP-04", ctes("formats") + _ARTS + f""", n AS (SELECT * FROM (SELECT a.*, f.id AS native, row_number() OVER (PARTITION BY a.art_id ORDER BY abs(f.width / f.height - a.width / a.height), f.ord) AS rk FROM arts a CROSS JOIN formats f WHERE f.platform = 'Personalizado') WHERE rk = 1)
 SELECT art_id, native || coalesce(string_agg(',' || f.id, '' ORDER BY f.ord), '') AS formats FROM n a LEFT JOIN formats f ON f.id IN ('1080x1080', '1080x1350') AND f.id <> native AND (layers >= 3 OR {_COV} >= 0.45) GROUP BY art_id, native""")
def _(t: Tables):
    return C.auto_formats(_arts(t), ["art_id"], "layers").select("art_id", F.array_join("formats", ",").alias("formats"))


@query("nearest_ratio", "TOP-05", "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', CAST({r!r} AS DOUBLE))" for i, (n, r) in enumerate(K.NAMED_RATIOS)) + ") AS v(o, name, ratio))" + _ARTS + """
 SELECT art_id, name FROM (SELECT art_id, name, row_number() OVER (PARTITION BY art_id ORDER BY abs(ratio - width / greatest(1, height)), o) AS rk FROM arts CROSS JOIN r) WHERE rk = 1""")
def _(t: Tables):
    return C.nearest_ratio(_arts(t), ["art_id"])


@query("pinned_fanout", "JOI-15", ctes("placements", "formats") + """SELECT format_id, count(*) AS boxes, CAST(sum(round_even(ox + x * s, 0)) AS BIGINT) AS x, CAST(sum(round_even(oy + y * s, 0)) AS BIGINT) AS y, CAST(sum(greatest(1, round_even(width * s, 0))) AS BIGINT) AS w, CAST(sum(greatest(1, round_even(height * s, 0))) AS BIGINT) AS h FROM (
 SELECT f.id AS format_id, p.*, least(f.width / canvas_w, f.height / canvas_h) AS s, (f.width - canvas_w * least(f.width / canvas_w, f.height / canvas_h)) / 2 AS ox, (f.height - canvas_h * least(f.width / canvas_w, f.height / canvas_h)) / 2 AS oy FROM placements p CROSS JOIN formats f) GROUP BY ALL""")
def _(t: Tables):
    d = C.pinned_fanout(t.bind("placements"))
    return d.groupBy("format_id").agg(F.count(F.lit(1)).alias("boxes"), *[F.sum(f"placed.{c}").alias(a) for c, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"))])


@query("variant_plans", "PRJ-20", """SELECT o_orderkey AS project_id, CAST(i AS INT) AS "index", (['feed', 'story', 'reel'])[CAST(i % 3 AS INT) + 1] AS format_id, CAST(floor(i / 3) AS INT) AS within, o_custkey * 1000 + i AS seed FROM orders, unnest(range(0, 4 + o_orderkey % 5)) AS u(i)""")
def _(t: Tables):
    r = t.orders.select(F.col("o_orderkey").alias("project_id"), F.array(F.lit("feed"), F.lit("story"), F.lit("reel")).alias("formats"), (F.lit(4) + F.col("o_orderkey") % 5).cast("int").alias("n_variants"), F.col("o_custkey").alias("seed"))
    return C.variant_plans(r)


@query("layout_pools", "PRJ-21", ctes("formats") + _ARTS + f"""SELECT art_id, f.id AS format_id, concat_ws(',', CASE WHEN abs((f.width / f.height) / (a.width / a.height) - 1) <= 0.18 THEN 'source_faithful' END, CASE WHEN (f.width / f.height >= 2.4 OR {_COV} < 0.45) AND layers > 1 THEN 'source_flow' END) AS pool FROM arts a CROSS JOIN formats f""")
def _(t: Tables):
    d = C.art_formats(_arts(t), "layers")
    return d.select("art_id", "format_id", F.array_join(C.layout_pool(F.col("width"), F.col("height"), F.col("fw"), F.col("fh"), F.col("layers") > 1), ",").alias("pool"))


@query("format_metadata", "JOI-13", ctes("formats") + """SELECT k AS p_partkey, coalesce(f.platform, 'Personalizado') AS platform, coalesce(f.family, 'Formato heredado') AS family, coalesce(f.st, 0.035) AS top, coalesce(f.recommended, false) AS recommended
 FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'meta_reels' WHEN 1 THEN '900x660' WHEN 2 THEN '500x500' ELSE 'youtube_thumbnail' END AS fid FROM part) LEFT JOIN formats f ON f.id = fid""")
def _(t: Tables):
    fid = F.element_at(F.array(*[F.lit(x) for x in ("meta_reels", "900x660", "500x500", "youtube_thumbnail")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return C.with_format(t.part.select("p_partkey", fid.alias("format_id"))).select("p_partkey", "platform", "family", F.col("safe.top").alias("top"), "recommended")


@query("safe_area_boxes", "FN-22 FN-23", ctes("placements") + """SELECT variant_id, ord, CASE WHEN canvas_h / canvas_w >= 1.62 THEN 'story' WHEN canvas_h / canvas_w > 1.2 THEN 'portrait' WHEN canvas_w / canvas_h > 1.35 THEN 'landscape' ELSE 'square' END AS aspect,
 round(abs(cos(radians(rotation))) * width + abs(sin(radians(rotation))) * height, 4) AS turned_w, greatest(1, CAST(round_even(width * least(100 / width, 80 / height), 0) AS INT)) AS fit_w FROM placements""")
def _(t: Tables):
    rw, _rh = G.rotated_bounds(F.col("width"), F.col("height"), F.col("rotation"))
    fit = G.fit_contain(F.col("width"), F.col("height"), F.lit(100), F.lit(80))
    return t.bind("placements").select("variant_id", "ord", G.aspect_family(F.col("canvas_w"), F.col("canvas_h")).alias("aspect"), F.round(rw, 4).alias("turned_w"), fit["width"].alias("fit_w"))


@query("split_zones", "FN-24 AGG-35", """SELECT p_partkey, CAST(i AS INT) AS i, round(0.1 + i * ((0.8 - 0.012 * (n - 1)) / n + 0.012), 6) AS x, round((0.8 - 0.012 * (n - 1)) / n, 6) AS width FROM (SELECT p_partkey, 2 + p_partkey % 3 AS n FROM part), unnest(range(0, n)) AS u(i)""")
def _(t: Tables):
    n = (F.lit(2) + F.col("p_partkey") % 3).cast("int")
    z = G.split_zone((F.lit(0.1), F.lit(0.2), F.lit(0.8), F.lit(0.5)), n, F.lit(1080), F.lit(1080), F.lit(1.0), F.lit("horizontal"))
    return t.part.select("p_partkey", F.posexplode(z).alias("i", "z")).select("p_partkey", "i", F.round("z.x", 6).alias("x"), F.round("z.width", 6).alias("width"))


@query("box_geometry", "FN-22 FN-32", ctes("placements") + """, a AS (SELECT *, 40 AS m, CASE WHEN width > canvas_w - 80 THEN greatest(1, CAST(trunc(width * ((canvas_w - 80) / width)) AS INT)) ELSE width END AS w1, CASE WHEN width > canvas_w - 80 THEN greatest(1, CAST(trunc(height * ((canvas_w - 80) / width)) AS INT)) ELSE height END AS h1 FROM placements),
 b AS (SELECT *, CASE WHEN h1 > canvas_h - 80 THEN greatest(1, CAST(trunc(w1 * ((canvas_h - 80) / h1)) AS INT)) ELSE w1 END AS w2, CASE WHEN h1 > canvas_h - 80 THEN greatest(1, CAST(trunc(h1 * ((canvas_h - 80) / h1)) AS INT)) ELSE h1 END AS h2 FROM a)
 SELECT variant_id, ord, CAST(greatest(m, least(x, canvas_w - m - w2)) AS INT) AS x, CAST(greatest(m, least(y, canvas_h - m - h2)) AS INT) AS y, w2 AS width, h2 AS height, CAST(round_even(canvas_h * 0.14, 0) AS INT) AS safe_top, CAST(canvas_w - round_even(canvas_w * 0.06, 0) AS INT) AS safe_right,
 CASE WHEN least(width / 1080, 1 - 0.7) >= 0.05 AND least(height / 1080, 1 - 0.5) >= 0.05 THEN least(width / 1080, 1 - 0.7) END AS zone_width FROM b""")
def _(t: Tables):
    w, h = F.col("canvas_w"), F.col("canvas_h")
    safe = F.struct(*[F.lit(v).alias(n) for n, v in (("left", 0.06), ("top", 0.14), ("right", 0.06), ("bottom", 0.35))])
    zone = G.inside_canvas((F.lit(0.7), F.lit(0.5), F.col("width") / 1080, F.col("height") / 1080), K.MIN_PRODUCT_ZONE)
    return t.bind("placements").select("variant_id", "ord", G.clamp_into_margin(G.box(), w, h, F.lit(40)).alias("b"), G.safe_bounds(w, h, safe).alias("s"), zone.alias("z")).select(
        "variant_id", "ord", "b.*", F.col("s.y0").alias("safe_top"), F.col("s.x1").alias("safe_right"), F.col("z.width").alias("zone_width"))


# --------------------------------------------------- rules without a query of their own above
@query("combo_aspects", "AGG-35", ctes("placements") + """, i AS (SELECT variant_id, width / height AS a, row_number() OVER (PARTITION BY variant_id ORDER BY ord) - 1 AS i FROM placements WHERE category = 'product' AND width > 0 AND height > 0)
 SELECT variant_id, round(sum(CASE WHEN i = 0 THEN a ELSE a * greatest(0.5, 0.8 - 0.08 * floor((i - 1) / 2)) * 0.82 END), 6) AS aspect FROM i GROUP BY ALL""")
def _(t: Tables):
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "width", "height"))), lambda s: s.dropFields("ord"))
    return t.bind("placements").where(F.col("category") == "product").groupBy("variant_id").agg(sizes.alias("sizes")).select(
        "variant_id", F.round(G.combo_aspect(F.col("sizes")), 6).alias("aspect"))


@query("picker_formats", "TOP-07", ctes("formats") + _ARTS + f"""SELECT art_id, format_id, CAST(rn AS INT) AS rn FROM (SELECT art_id, f.id AS format_id, row_number() OVER (PARTITION BY art_id ORDER BY {_COV} < 0.45, f.recommended DESC, f.ord) AS rn FROM arts a CROSS JOIN formats f) WHERE rn <= 5""")
def _(t: Tables):
    from ..operators.skew import top_per_group

    d = C.art_formats(_arts(t), "layers", 5).withColumnsRenamed({"needs_split": "crowded", "format_ord": "ord"})
    # Numbers are ranked; the ids of the formats are put to the ranked rows.
    ranked = top_per_group(d.select("art_id", "crowded", "recommended", "ord"), ["art_id"], C.picker_order(), 5)
    return C.with_format_ids(ranked).select("art_id", "format_id", "rn")


@query("first_reports", "TOP-08", ctes("orderlines") + """SELECT k, array_to_string(n[1:2], ',') AS shown, CAST(greatest(0, len(n) - 2) AS INT) AS more FROM (SELECT k, string_split(names, '|') AS n FROM orderlines)""")
def _(t: Tables):
    from ..operators.lifecycle import first_few

    shown, more = first_few(F.split("names", r"\|"), 2)
    return t.bind("orderlines").select("k", F.array_join(shown, ",").alias("shown"), more.cast("int").alias("more"))


@query("capped_warnings", "SET-06", ctes("placements") + """, w AS (SELECT variant_id, list(category ORDER BY ord) AS w FROM placements GROUP BY ALL)
 SELECT variant_id, array_to_string(list_filter(w, lambda v, i: list_position(w, v) = i)[1:3], ',') AS warnings FROM w""")
def _(t: Tables):
    from ..operators.lifecycle import distinct_warnings
    from ..operators.skew import ordered_list

    w = t.bind("placements").groupBy("variant_id").agg(ordered_list(F.col("category"), F.col("ord")).alias("w"))
    return w.select("variant_id", F.array_join(distinct_warnings(F.col("w"), 3), ",").alias("warnings"))


@query("layer_measures", "FN-07", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN 90.0 WHEN 2 THEN 58.0 WHEN 3 THEN 30.0 END AS height_cm,
 CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'cafetera' ELSE 'producto' END WHEN 1 THEN 'cocina de 20"' WHEN 2 THEN 'cilindro de gas' WHEN 3 THEN 'microondas' END AS family FROM part""")
def _(t: Tables):
    k = F.col("p_partkey") % 5
    stored = F.when(k == 0, F.col("p_size").cast("double")).when(k == 1, 0.0)
    family = F.when(F.col("p_partkey") % 2 == 0, "cafetera").otherwise("")
    file = F.when(k <= 1, "cocina-indurama-4q-20p-croma.png").otherwise("producto.png")
    name = F.when(k == 2, "Cilindro de gas 15kg").when(k == 3, "Capa 15").otherwise("")
    source = F.when(k.isin(2, 3), "horno microondas 20 litros.png").otherwise("aspiradora.png")
    return t.part.select("p_partkey", S.measure_layer(stored, family, file, name, source).alias("m")).select("p_partkey", "m.height_cm", "m.family")


@query("plate_reads", "PRJ-25", ctes("placements") + """SELECT variant_id, ord, left(name, 200) AS text, CAST(round_even((x - 50) * 0.5, 0) AS INT) AS x0, CAST(round_even((y - 40) * 0.5, 0) AS INT) AS y0, CAST(round_even((x + width - 50) * 0.5, 0) AS INT) AS x1,
 CAST(round_even((y + height - 40) * 0.5, 0) AS INT) AS y1, CAST(round_even(font_size * 0.5, 1) AS DOUBLE) AS size, 1.0::DOUBLE AS confidence FROM placements WHERE type = 'text'""")
def _(t: Tables):
    from ..operators import documents as D

    p = t.bind("placements")
    frame = p.select("variant_id").distinct().select("variant_id", F.lit(50).alias("fx0"), F.lit(40).alias("fy0"), F.lit(0.5).alias("scale"))
    texts = p.where(F.col("type") == "text").select("variant_id", "ord", F.col("name").alias("text"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"), F.col("font_size").cast("double").alias("size"))
    return D.scaled_reads(texts, frame, V)


_SAFE = "least(0.99::DOUBLE, greatest(0::DOUBLE, (%s / %s - 0.05::DOUBLE) / (1::DOUBLE - 0.05::DOUBLE - 0.05::DOUBLE)))"


@query("safe_coordinates", "FN-23", ctes("placements") + f""", n AS (SELECT *, round_even({_SAFE % ('x', 'canvas_w')}, 4) AS sx, round_even({_SAFE % ('y', 'canvas_h')}, 4) AS sy FROM placements),
 b AS (SELECT *, least(round_even(width / canvas_w / (1::DOUBLE - 0.05::DOUBLE - 0.05::DOUBLE), 4), round_even(1::DOUBLE - sx, 4)) AS sw, least(round_even(height / canvas_h / (1::DOUBLE - 0.05::DOUBLE - 0.05::DOUBLE), 4), round_even(1::DOUBLE - sy, 4)) AS sh FROM n)
 SELECT variant_id, ord, CAST(sx AS DOUBLE) AS x, CAST(sy AS DOUBLE) AS y, CAST(sw AS DOUBLE) AS width, CAST(sh AS DOUBLE) AS height FROM b WHERE sw > 0 AND sh > 0
 UNION ALL SELECT variant_id, -ord, NULL, NULL, NULL, NULL FROM placements WHERE ln = 1""")
def _(t: Tables):
    """Boxes in safe coordinates; a canvas without width has none."""
    p = t.bind("placements")
    both = p.select("variant_id", "ord", "x", "y", "width", "height", "canvas_w", "canvas_h").unionByName(
        p.where("ln = 1").select("variant_id", (-F.col("ord")).alias("ord"), "x", "y", "width", "height", F.lit(0).alias("canvas_w"), "canvas_h"))
    safe = F.struct(*[F.lit(0.05).alias(n) for n in ("left", "top", "right", "bottom")])
    s = G.normalise_to_safe(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"), F.col("canvas_w"), F.col("canvas_h"), safe)
    return both.select("variant_id", "ord", s.alias("s")).where((F.col("ord") < 0) | F.col("s").isNotNull()).select("variant_id", "ord", *[F.col(f"s.{c}").alias(c) for c in ("x", "y", "width", "height")])
