"""Registry of queries and the inputs they derive from the given tables.

Inputs are written in SQL that both Spark and the check engine read, so that
both sides start from the same rows; the operators under test come after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import staged

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}

# Inputs in the common dialect: name -> (needs, text). ``{table}`` names a given table.
BIND: dict[str, tuple[tuple[str, ...], str]] = {}
# Inputs only the check engine needs.
DUCK: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        COVERS[name] = tuple(covers.split())
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def _order(names, source) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in source[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def ctes(*names: str) -> str:
    """``WITH`` clause for the check engine."""
    source = {**BIND, **DUCK}
    parts = [f"{n} AS ({source[n][1].format(**{t: t for t in TABLES}) if n in BIND else source[n][1]})" for n in _order(names, source)]
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """Given tables and derived inputs of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def kept(self, make: Callable[[Tables], DataFrame]) -> DataFrame:
        if make not in self.made:
            self.made[make] = staged(make(self), make.__name__)
        return self.made[make]

    def bind(self, name: str) -> DataFrame:
        order = _order([name], BIND)
        body = "WITH " + ",\n".join(f"{n} AS ({BIND[n][1]})" for n in order) + f"\nSELECT * FROM {name}"
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in body}
        return self.spark.sql(body, **used)


def once(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Rows that a query uses several times, computed once for it."""
    return lambda t: t.kept(make)


# ---------------------------------------------------------------- common inputs
BIND["lines"] = ((), """
SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk,
       CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord,
       CAST(floor(l_quantity) AS BIGINT) AS qty, CAST(floor(l_extendedprice) AS BIGINT) AS price,
       l_returnflag AS rf, l_linestatus AS ls, l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101 AS h
FROM {lineitem}""")

BIND["orderlines"] = ((), """
SELECT l_orderkey AS k,
       concat_ws('|', max(CASE WHEN l_linenumber = 1 THEN p_name END), max(CASE WHEN l_linenumber = 2 THEN p_name END),
                 max(CASE WHEN l_linenumber = 3 THEN p_name END), max(CASE WHEN l_linenumber = 4 THEN p_name END), max(CASE WHEN l_linenumber = 5 THEN p_name END),
                 max(CASE WHEN l_linenumber = 6 THEN p_name END), max(CASE WHEN l_linenumber = 7 THEN p_name END)) AS names,
       min(l_returnflag) AS rf, min(p_type) AS ptype, max(CAST(floor(l_extendedprice) AS BIGINT)) AS price, min(l_partkey) AS pk
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_orderkey""")

# One matrix row per order; two hundred rows per matrix, 25 clients.
BIND["fields"] = (("orderlines",), """
SELECT 'c' || CAST(CAST(floor(k / 200) AS BIGINT) % 25 AS STRING) AS client_id,
       'm' || CAST(CAST(floor(k / 200) AS BIGINT) AS STRING) AS matrix_id, CAST(2 + k % 200 AS INT) AS row_number,
       CASE WHEN k % 11 = 0 THEN 'no poner' WHEN k % 13 = 0 THEN '' ELSE names END AS producto,
       CASE WHEN k % 3 = 0 AND names <> '' THEN replace(replace(names, ' ', '-'), '|', '.png | ') || '.png' ELSE '' END AS imagen,
       CASE WHEN k % 4 = 0 THEN 'Oferta ' || ptype WHEN k % 4 = 1 THEN 'No Poner' ELSE '' END AS titular,
       CASE WHEN k % 6 = 0 THEN 'Línea ' || ptype ELSE '' END AS subtitulo,
       CASE WHEN k % 5 = 0 THEN '$' || CAST(price + 20 AS STRING) ELSE '' END AS precio_anterior,
       CASE WHEN k % 2 = 0 THEN CASE WHEN rf = 'A' THEN '$1 | $2 | $3' ELSE '$' || CAST(price AS STRING) END ELSE '' END AS precio_actual,
       CASE WHEN k % 9 = 0 THEN '12x' ELSE '' END AS cuota,
       CASE WHEN k % 10 = 0 THEN 'Omitir' WHEN k % 10 = 1 THEN '20%' ELSE '' END AS descuento,
       CASE WHEN k % 3 = 1 THEN 'Compra ya' ELSE '' END AS cta,
       CASE WHEN k % 8 = 0 THEN 'Aplican condiciones' ELSE '' END AS legal,
       CASE WHEN k % 14 = 0 THEN 'Hasta el 30' ELSE '' END AS vigencia,
       CASE WHEN k % 6 = 0 THEN 'feed;story' WHEN k % 6 = 1 THEN 'Feed|feed | STORY' WHEN k % 6 = 2 THEN '1080x1350'
            WHEN k % 6 = 3 THEN '' WHEN k % 6 = 4 THEN 'meta_reels;9000x200;reel' ELSE CASE WHEN k % 5 = 0 THEN ';;' ELSE 'Cuadrado' END END AS formatos,
       CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 = 8 THEN '7' WHEN k % 9 = 7 THEN 'dos' ELSE CAST(k % 9 AS STRING) END AS cantidad_propuestas,
       CASE WHEN k % 17 = 0 THEN 'Combo Base' WHEN k % 19 = 0 THEN 'otra' ELSE '' END AS plantilla,
       CASE WHEN rf = 'A' THEN 'Un arte por producto' WHEN rf = 'N' AND k % 2 = 0 THEN 'Sí' ELSE 'junto' END AS modo,
       CASE WHEN k % 23 = 0 THEN 'urgente' ELSE '' END AS notas
FROM orderlines""")

# Templates: seven archetypes per client, in catalogue order.
BIND["template_base"] = ((), """
SELECT 'c' || CAST(n_nationkey AS STRING) AS client_id, a.ord, a.name, a.category, a.range_min, a.range_max,
       'c' || CAST(n_nationkey AS STRING) || '-t' || CAST(a.ord AS STRING) AS candidate_id,
       NOT (n_nationkey % 7 = 3 AND a.ord < 6) AND n_nationkey % 11 <> 5 AS approved
FROM {nation} CROSS JOIN (VALUES
  (1, 'Producto Base', 'single_product', 1, 1), (2, 'Oferta Base', 'price_promotion', 1, 1),
  (3, 'Combo Base', 'combo', 2, 4), (4, 'Institucional', 'institutional', 0, 0),
  (5, 'Beneficio', 'product_benefit', 1, 2), (6, 'Todo Terreno', 'price_promotion', 0, 6),
  (7, 'Mensaje', 'institutional', 0, 1)) AS a(ord, name, category, range_min, range_max)""")

BIND["template_slots"] = (("template_base",), """
SELECT b.client_id, b.candidate_id, s.key, s.category, s.kind, s.required, s.repeatable, s.generate_if_missing, s.pos
FROM template_base b JOIN (VALUES
  (1, 1, 'producto', 'product', 'image', true, false, false), (1, 2, 'titular', 'headline', 'text', false, false, true),
  (1, 3, 'cta', 'cta', 'text', false, false, true), (1, 4, 'logo', 'logo', 'image', false, false, false),
  (2, 1, 'producto', 'product', 'image', true, false, false), (2, 2, 'titular', 'headline', 'text', false, false, true),
  (2, 3, 'precio', 'price', 'money', true, false, false), (2, 4, 'precio_anterior', 'previous_price', 'money', false, false, false),
  (2, 5, 'descuento', 'discount', 'badge', false, false, false), (2, 6, 'cta', 'cta', 'text', false, false, true), (2, 7, 'legal', 'legal', 'text', false, false, false),
  (3, 1, 'productos', 'product', 'image', true, true, false), (3, 2, 'titular', 'headline', 'text', false, false, false),
  (3, 3, 'precio', 'price', 'money', false, false, false), (3, 4, 'cta', 'cta', 'text', false, false, false), (3, 5, 'subtitle', 'subheadline', 'text', false, false, true),
  (4, 1, 'titular', 'headline', 'text', true, false, true), (4, 2, 'subtitulo', 'subheadline', 'text', false, false, true), (4, 3, 'legal', 'legal', 'text', false, false, false),
  (5, 1, 'producto', 'product', 'image', true, false, false), (5, 2, 'producto_2', 'product', 'image', false, false, false),
  (5, 3, 'headline', 'headline', 'text', false, false, true), (5, 4, 'titular', 'headline', 'text', false, false, false),
  (6, 1, 'productos', 'product', 'image', false, true, false), (6, 2, 'titular', 'headline', 'text', false, false, true),
  (6, 3, 'subtitulo', 'subheadline', 'text', false, false, true), (6, 4, 'precio', 'price', 'money', false, false, false),
  (6, 5, 'precio_anterior', 'previous_price', 'money', false, false, false), (6, 6, 'cuota', 'installment', 'money', false, false, false),
  (6, 7, 'descuento', 'discount', 'badge', false, false, false), (6, 8, 'cta', 'cta', 'text', false, false, true), (6, 9, 'legal', 'legal', 'text', false, false, false),
  (7, 1, 'titular', 'headline', 'text', false, false, true), (7, 2, 'vigencia', 'validity', 'date', true, false, false)
) AS s(tord, pos, key, category, kind, required, repeatable, generate_if_missing) ON b.ord = s.tord""")

# Product photos of a client.
BIND["assets"] = ((), """
SELECT 'c' || CAST(p_partkey % 25 AS STRING) AS client_id, 'a' || CAST(p_partkey AS STRING) AS asset_id, CAST(p_partkey AS INT) AS ord,
       CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, ' ', '-') || '.png'
            WHEN p_partkey % 4 = 1 THEN replace(p_name, ' ', '_') || '_' || replace(p_brand, '#', '') || '.jpg'
            WHEN p_partkey % 4 = 2 THEN upper(replace(p_name, ' ', '')) || '.png'
            ELSE 'foto-' || p_name || '-' || CAST(p_size AS STRING) || '.webp' END AS filename,
       CAST(200 + p_size * 40 AS INT) AS width, CAST(150 + p_partkey % 3000 AS INT) AS height,
       CAST(p_size * 1000 AS BIGINT) AS size_bytes
FROM {part}""")

# Placed layers of composed pieces: one variant per order, one layer per line.
BIND["placements"] = (("lines",), """
SELECT k AS variant_id, ord, ln, pk, sk, canvas_w, canvas_h, category, category || ' ' || CAST(ln AS STRING) AS name,
       CASE WHEN category IN ('headline', 'subheadline', 'price', 'cta', 'legal') THEN 'text' ELSE 'image' END AS type,
       CAST(CASE WHEN pk % 29 = 0 THEN 0 ELSE h % canvas_w - 40 END AS INT) AS x,
       CAST(CASE WHEN pk % 29 = 0 THEN 0 ELSE (h * 7) % canvas_h - 30 END AS INT) AS y,
       CAST(CASE WHEN pk % 29 = 0 THEN canvas_w ELSE 40 + (pk * 13) % 460 END AS INT) AS width,
       CAST(CASE WHEN pk % 29 = 0 THEN canvas_h ELSE 30 + (sk * 17 + pk) % 380 END AS INT) AS height,
       rf = 'R' AS pinned, pk % 31 = 0 AS stretch, CASE WHEN pk % 12 = 0 THEN 15.0E0 ELSE 0.0E0 END AS rotation,
       CAST(8 + sk % 40 AS INT) AS font_size, CAST(40 + (pk * 13) % 460 + pk % 9 AS INT) AS layer_w, CAST(30 + (sk * 17 + pk) % 380 AS INT) AS layer_h,
       pk % 3 <> 0 AS preserve_aspect, pk % 4 = 0 AS pixel_critical,
       CASE WHEN pk % 2 = 0 THEN 1.0E0 + sk % 10 END AS contrast,
       CASE WHEN pk % 3 = 0 THEN 170.0E0 WHEN pk % 3 = 1 THEN 58.0E0 END AS height_cm,
       CAST(pk % 10 AS INT) AS z_index, pk % 13 <> 0 AS visible
FROM (SELECT *, CAST(CASE WHEN k % 3 = 2 THEN 1200 ELSE 1080 END AS INT) AS canvas_w,
             CAST(CASE WHEN k % 3 = 0 THEN 1080 WHEN k % 3 = 1 THEN 1920 ELSE 628 END AS INT) AS canvas_h,
             CASE (pk + ln) % 9 WHEN 0 THEN 'product' WHEN 1 THEN 'logo' WHEN 2 THEN 'headline' WHEN 3 THEN 'subheadline' WHEN 4 THEN 'price'
                  WHEN 5 THEN 'cta' WHEN 6 THEN 'legal' WHEN 7 THEN 'decoration' ELSE 'product' END AS category FROM lines) s""")

# Layers of art projects.
BIND["layers"] = (("placements",), """
SELECT variant_id AS project_id, ord, 'L' || CAST(ord AS STRING) AS layer_id, ln, pk, sk, canvas_w, canvas_h, type, x, y, width, height, z_index, visible,
       CASE WHEN pk % 37 = 0 THEN 'background' ELSE category END AS category,
       CASE pk % 8 WHEN 0 THEN 'Capa ' || CAST(sk AS STRING) WHEN 1 THEN 'Cocina 20P' WHEN 2 THEN 'Logo copy ' || CAST(ln AS STRING)
            WHEN 3 THEN 'Precio Hasta 50%' WHEN 4 THEN 'Smart TV 55"' WHEN 5 THEN 'Decoración ' || CAST(ln AS STRING) || ' copia'
            WHEN 6 THEN 'Botón compra' ELSE 'layer ' || CAST(ln AS STRING) END AS name,
       CASE WHEN type = 'text' THEN CASE WHEN pk % 6 = 0 THEN '   ' WHEN pk % 6 = 1 THEN 'Refrigeradora Croma' ELSE 'Texto ' || CAST(ln AS STRING) END END AS content,
       CASE WHEN type = 'image' AND pk % 5 <> 0 THEN 'layers/' || CAST(pk AS STRING) || '.png' END AS src,
       pk % 7 <> 0 AS replaceable, pk % 41 = 0 AS external
FROM placements""")

# Lines read from existing art.
BIND["reads"] = (("lines",), """
SELECT k AS art_id, ord, CAST(1080 AS INT) AS canvas_w, CAST(CASE WHEN k % 2 = 0 THEN 1350 ELSE 1080 END AS INT) AS canvas_h,
       CASE (pk + ln * 3) % 12 WHEN 0 THEN 'Antes $' || CAST(price AS STRING) WHEN 1 THEN '$' || CAST(price AS STRING) WHEN 2 THEN '20% OFF'
            WHEN 3 THEN 'desde 12 cuotas' WHEN 4 THEN 'Aplican restricciones y condiciones' WHEN 5 THEN 'Compra ahora'
            WHEN 6 THEN 'Valido hasta el 30' WHEN 7 THEN 'Gran titular del mes' WHEN 8 THEN 'Subtitulo de apoyo' WHEN 9 THEN 'MARCA'
            WHEN 10 THEN CAST(price AS STRING) ELSE 'Términos del sitio' END AS text,
       CASE WHEN (pk + ln * 3) % 12 = 9 THEN 'brand' ELSE 'content' END AS role,
       CAST((h * 3) % 700 AS INT) AS x0, CAST((h * 5) % 1000 AS INT) AS y0,
       CAST((h * 3) % 700 + 60 + pk % 300 AS INT) AS x1, CAST((h * 5) % 1000 + 10 + sk % 90 AS INT) AS y1,
       CASE WHEN pk % 10 = 0 THEN 0.5E0 ELSE 0.9E0 END AS confidence, CASE WHEN pk % 3 = 0 THEN '#ff8800' WHEN pk % 3 = 1 THEN 'rojo' ELSE '#112233' END AS color,
       CASE WHEN pk % 9 = 0 THEN 10.0E0 ELSE 1.0E0 END AS angle
FROM lines""")

# Campaign sources: fifty documents per campaign.
BIND["sources"] = ((), """
SELECT 'c' || CAST(CAST(floor(doc_id / 50) AS BIGINT) % 25 AS STRING) AS client_id, 'k' || CAST(CAST(floor(doc_id / 50) AS BIGINT) AS STRING) AS campaign_id,
       'd' || CAST(doc_id AS STRING) AS source_id, doc_id AS ord, doc_id % 50 AS pos, text,
       CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'layered_design' WHEN 3 THEN 'presentation' WHEN 4 THEN 'font' ELSE 'document' END AS kind,
       CASE doc_id % 6 WHEN 0 THEN 'Manual de marca ' WHEN 1 THEN 'brief-' WHEN 2 THEN 'Key Visual ' WHEN 3 THEN 'logo_' WHEN 4 THEN 'catalogo ' ELSE 'arte ' END
         || lang || CAST(doc_id AS STRING) || CASE WHEN doc_id % 7 = 0 THEN '.PDF' WHEN doc_id % 7 = 2 THEN '.ai' ELSE '.docx' END AS filename,
       CAST(doc_id % 4 AS INT) AS page_count, CAST(600 + doc_id % 900 AS INT) AS width, CAST(400 + doc_id % 1100 AS INT) AS height,
       CASE WHEN doc_id % 3 = 0 THEN CAST(7 AS INT) WHEN doc_id % 3 = 1 THEN CAST(6 AS INT) END AS vector_version, lang, source, n_chars
FROM {documents}""")

# Touches, jobs and posts come from the events.
BIND["touches"] = ((), """
SELECT 'p' || CAST(user_id * 3 + event_id % 3 AS STRING) AS project_id, 's' || CAST(user_id % 20 AS STRING) AS session_id, event_id AS touch_id, ts,
       CAST(floor(value * 1000) AS BIGINT) AS bytes FROM {events}""")
BIND["jobs"] = ((), """
SELECT 't' || CAST(user_id * 7 + event_id % 7 AS STRING) AS task_id, 'k' || CAST(user_id % 30 AS STRING) AS campaign_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'STARTED' WHEN 'click' THEN 'PROGRESS' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS state,
       CAST(event_id % 101 AS INT) AS progress FROM {events}""")
BIND["posts"] = ((), """
SELECT user_id AS account, event_id AS post_id, ts,
       'https://cdn.example.com/' || CAST((user_id * 31 + event_id) % 400 AS STRING) || '.jpg' AS media, event_type AS kind FROM {events}""")


def big(sql: str, *columns: str) -> str:
    """The same rows with counts as 64-bit integers (the check engine widens some)."""
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns) + f") FROM ({sql})"


def dslug(c: str) -> str:
    """Slug of an expression for the check engine."""
    return f"trim(regexp_replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '[^a-z0-9]+', '_', 'g'), '_')"


def dstem(c: str) -> str:
    return f"regexp_replace({c}, '(.)\\.[^.]+$', '\\1')"


def dlist(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '[|;]'), lambda y: trim(y)), lambda y: y <> '')"


_OPT = ("imagen", "titular", "subtitulo", "precio_anterior", "precio_actual", "cuota", "descuento", "cta", "legal", "vigencia", "plantilla", "notas")
_SUP = "('no_poner','no_mostrar','no_usar','omitir','suprimir','sin_contenido')"
_SUPP_LIST = ("list_filter([" + ", ".join(f"CASE WHEN {dslug(f)} IN {_SUP} THEN '{f}' END" for f in (*_OPT, "producto")) + "], lambda y: y IS NOT NULL)")

# Typed rows with their rule, as the check engine computes them.
DUCK["typed_all"] = (("fields",), f"""
SELECT client_id, matrix_id, row_number, CASE WHEN {dslug('producto')} IN {_SUP} THEN '' ELSE producto END AS producto,
 {', '.join(f"CASE WHEN {f} <> '' AND {dslug(f)} NOT IN {_SUP} THEN {f} END AS {f}" for f in _OPT)},
 list_filter({dlist('formatos')}, lambda y, i: list_position(list_transform({dlist('formatos')}, lambda z: lower(z)), lower(y)) = i) AS formatos,
 CASE WHEN cantidad_propuestas = '' THEN 1 WHEN try_cast(cantidad_propuestas AS INT) BETWEEN 1 AND 6 THEN try_cast(cantidad_propuestas AS INT) END AS cantidad_propuestas,
 {_SUPP_LIST} AS suppressed_fields,
 CASE WHEN {dslug('modo')} IN ('individual','individuales','uno_por_producto','un_arte_por_producto','por_producto','separado','separados','si') THEN 'individual' ELSE 'combo' END AS modo,
 CASE WHEN formatos <> '' AND len({dlist('formatos')}) = 0 THEN 'formats'
      WHEN cantidad_propuestas <> '' AND coalesce(try_cast(cantidad_propuestas AS INT), 0) NOT BETWEEN 1 AND 6 THEN 'quantity' END AS rule
FROM fields""")
DUCK["typed"] = (("typed_all",), f"""
SELECT * EXCLUDE (rule), greatest(len({dlist('producto')}), len({dlist('imagen')})) AS products FROM typed_all WHERE rule IS NULL AND (producto <> '' OR
 coalesce({', '.join(f for f in _OPT if f != 'plantilla')}) IS NOT NULL OR len(formatos) > 0 OR len(suppressed_fields) > 0)""")
DUCK["expanded"] = (("typed",), f"""
SELECT t.* EXCLUDE (row_number, producto, imagen, precio_actual, precio_anterior, cuota, descuento, modo),
  CASE WHEN i = 0 THEN t.row_number ELSE top + coalesce(bef, 0) + i END AS row_number, CASE WHEN n > 1 THEN t.row_number END AS fila_origen,
  CASE WHEN n > 1 THEN coalesce({dlist('producto')}[i + 1], CASE WHEN {dlist('imagen')}[i + 1] IS NOT NULL THEN
       upper(substr(trim(regexp_replace({dstem(dlist('imagen') + '[i + 1]')}, '[_-]+', ' ', 'g')), 1, 1)) || substr(trim(regexp_replace({dstem(dlist('imagen') + '[i + 1]')}, '[_-]+', ' ', 'g')), 2) END, '') ELSE producto END AS producto,
  CASE WHEN n > 1 THEN {dlist('imagen')}[i + 1] ELSE imagen END AS imagen,
  {', '.join(f"CASE WHEN n > 1 AND len({dlist(f)}) > 1 THEN {dlist(f)}[i + 1] ELSE {f} END AS {f}" for f in ('precio_actual', 'precio_anterior', 'cuota', 'descuento'))},
  CASE WHEN n > 1 THEN 'combo' ELSE modo END AS modo
FROM (SELECT *, max(row_number) OVER (PARTITION BY matrix_id) AS top,
        sum(n - 1) OVER (PARTITION BY matrix_id ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef
      FROM (SELECT *, CASE WHEN modo = 'individual' AND products >= 2 THEN products ELSE 1 END AS n FROM typed)) t, unnest(range(0, n)) AS u(i)""")


def formats_values() -> str:
    """The catalogue as rows for the check engine."""
    from .. import constants as K

    rows = [f"({i}, '{p[0]}', '{p[1]}', '{p[2]}', {p[4]}, {p[5]}, {p[8]}, {p[7][0]}, {p[7][1]}, {p[7][2]}, {p[7][3]})" for i, p in enumerate(K.FORMAT_PRESETS)]
    rows += [f"({len(rows) + i}, '{n}', 'Personalizado', 'Formato heredado', {w}, {h}, false, 0.035, 0.035, 0.035, 0.035)" for i, (n, w, h) in enumerate(K.LEGACY_SIZES)]
    return ("SELECT ord, id, platform, family, width, height, recommended, CAST(sl AS DOUBLE) sl, CAST(st AS DOUBLE) st, CAST(sr AS DOUBLE) sr, CAST(sb AS DOUBLE) sb FROM (VALUES "
            + ", ".join(rows) + ") AS f(ord, id, platform, family, width, height, recommended, sl, st, sr, sb)")


def alias_values() -> str:
    from .. import constants as K

    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{i}')" for a, i in K.FORMAT_ALIASES.items()) + ") AS a(alias, id)"


DUCK["formats"] = ((), formats_values())
DUCK["aliases"] = ((), alias_values())


def resolve_sql(source: str, cols: str) -> str:
    """Format tokens of ``source(token, cols)`` resolved, for the check engine."""
    m = "regexp_extract(trim(token), '^(\\d{2,5})\\s*[xX×]\\s*(\\d{2,5})$', %d)"
    return f"""SELECT {cols}, token, CASE WHEN rule IS NULL THEN coalesce(fid, w || 'x' || h) END AS format_id,
 CASE WHEN rule IS NULL THEN w END AS width, CASE WHEN rule IS NULL THEN h END AS height, rule FROM (
 SELECT *, CASE WHEN w IS NULL THEN 'unknown_format' WHEN fid IS NULL AND (least(w, h) < 100 OR greatest(w, h) > 8000) THEN 'out_of_range'
   WHEN w::BIGINT * h > 16000000 THEN 'too_many_pixels' END AS rule FROM (
 SELECT s.*, coalesce(f.id, a.id) AS fid, coalesce(f.width, g.width, try_cast({m % 1} AS INT)) AS w, coalesce(f.height, g.height, try_cast({m % 2} AS INT)) AS h
 FROM {source} s LEFT JOIN formats f ON f.id = trim(token) LEFT JOIN aliases a ON f.id IS NULL AND a.alias = {dslug('token')}
 LEFT JOIN formats g ON g.id = a.id))"""
