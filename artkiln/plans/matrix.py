"""Queries over production matrices: scan rules, rows, expansion, formats, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..operators import catalog as C
from ..operators import matching as P
from ..operators import matrix as M
from ..operators import templates as T
from ..sources import files as S
from ..sources import matrix_files as MF
from ..sources import sinks as O
from .base import Tables, big, ctes, dlist, dslug, dstem, once, query, resolve_sql

HEADERS = tuple(K.HEADER_ALIASES)


def typed_all(t: Tables):
    return M.normalise_rows(t.bind("fields"))


def typed(t: Tables):
    return M.split_errors(typed_all(t))[0]


typed_once = once(typed)


def expanded(t: Tables):
    return M.expand_rows(typed_once(t), ["client_id", "matrix_id"])


expanded_once = once(expanded)


def nested_templates(t: Tables):
    slots = t.bind("template_slots").groupBy("client_id", "candidate_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "category", "kind", "required", "repeatable", "generate_if_missing"))),
                    lambda s: s.dropFields("pos")).alias("slots"))
    return t.bind("template_base").join(slots, ["client_id", "candidate_id"])


_RAW = """SELECT k AS matrix_id, 'SKU' || s || CASE WHEN k % 3 = 0 THEN 'headline' ELSE 'Precio Oferta' END || s || CASE WHEN k % 4 = 0 THEN 'Extra' ELSE 'Términos' END || s ||
  CASE WHEN k % 5 = 0 THEN 'sku' ELSE 'count' END AS l1, names || s || 'uno' || s || 'dos' || s || CAST(k % 8 AS STRING) AS l2,
  'x' || s || 'y' || s || 'z' AS l3 FROM (SELECT *, CASE k % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '!' END AS s FROM orderlines) o"""


def _raw(t: Tables):
    o = t.bind("orderlines").withColumn("s", F.expr("CASE k % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '!' END"))
    return o.selectExpr(
        "k AS matrix_id",
        "concat('SKU', s, CASE WHEN k % 3 = 0 THEN 'headline' ELSE 'Precio Oferta' END, s, CASE WHEN k % 4 = 0 THEN 'Extra' ELSE 'Términos' END, s, CASE WHEN k % 5 = 0 THEN 'sku' ELSE 'count' END) AS l1",
        "concat(names, s, 'uno', s, 'dos', s, CAST(k % 8 AS STRING)) AS l2", "concat('x', s, 'y', s, 'z') AS l3")


_KNOWN = "('" + "','".join(sorted(K.ALIAS_TO_COLUMN)) + "')"


def _score_sql(sep):
    h = f"string_split(l1, '{sep}')"
    return (f"{{'known': len(list_filter({h}, lambda c: {dslug('c')} IN {_KNOWN})), 'same': (len(string_split(l2, '{sep}')) = len({h}))::INT + (len(string_split(l3, '{sep}')) = len({h}))::INT, "
            f"'width': len({h})}}")


@query("matrix_separator", "SRC-02", ctes("orderlines") + f"""SELECT matrix_id, CASE WHEN greatest(a.known, b.known, c.known) = 0 THEN NULL
 WHEN a >= b AND a >= c THEN ',' WHEN b >= c THEN 'tab' ELSE ';' END AS separator FROM (SELECT matrix_id, {_score_sql(',')} AS a, {_score_sql(chr(9))} AS b, {_score_sql(';')} AS c FROM ({_RAW}))""")
def _(t: Tables):
    sep = M.infer_separator(F.array("l1", "l2", "l3"))
    return _raw(t).select("matrix_id", F.when(sep == "\t", "tab").otherwise(sep).alias("separator"))


@query("matrix_header_aliases", "PRJ-01 FN-01", ctes("orderlines") + f"""SELECT matrix_id, canonical, min(pos) AS pos, count(*) AS uses FROM (
 SELECT matrix_id, i - 1 AS pos, CASE {' '.join(f"WHEN s IN ({','.join(chr(39) + a + chr(39) for a in al)}) THEN '{n}'" for n, al in K.HEADER_ALIASES.items())} END AS canonical
 FROM (SELECT matrix_id, CAST(i AS INT) AS i, {dslug('h[i]')} AS s FROM (SELECT matrix_id, string_split(replace(replace(l1, ';', ','), '!', ','), ',') AS h FROM ({_RAW})), unnest(range(1, len(h) + 1)) AS u(i)))
 WHERE canonical IS NOT NULL GROUP BY ALL""")
def _(t: Tables):
    heads = _raw(t).select("matrix_id", F.split(F.translate("l1", ";!", ",,"), ",").alias("cells"))
    return M.header_columns(heads)


@query("matrix_header_errors", "PRJ-01", ctes("orderlines") + """SELECT k AS matrix_id, 1 AS row_number, 'duplicate_column' AS rule, 'producto' AS detail FROM orderlines WHERE k % 5 = 0""")
def _(t: Tables):
    heads = _raw(t).select("matrix_id", F.split(F.translate("l1", ";!", ",,"), ",").alias("cells"))
    return M.header_errors(M.header_columns(heads))


@query("matrix_cells_to_rows", "SRC-01 PRJ-02 PRJ-03 PRJ-05 PRJ-06", ctes("typed") + """SELECT client_id || '/' || matrix_id AS matrix_id, row_number, producto, titular, precio_actual, cta,
  array_to_string(formatos, ',') AS formatos, cantidad_propuestas, array_to_string(suppressed_fields, ',') AS suppressed, modo FROM typed""")
def _(t: Tables):
    f = t.bind("fields").withColumn("matrix_id", F.concat_ws("/", "client_id", "matrix_id"))
    data = f.select("matrix_id", F.col("row_number").alias("record_no"), F.array(*HEADERS).alias("cells"))
    head = f.select("matrix_id").distinct().select("matrix_id", F.lit(1).alias("record_no"), F.array(*[F.lit(h.title()) for h in HEADERS]).alias("cells"))
    good, _bad = M.parse_matrix_cells(data.unionByName(head))
    return good.select("matrix_id", "row_number", "producto", "titular", "precio_actual", "cta", F.array_join("formatos", ",").alias("formatos"),
                       "cantidad_propuestas", F.array_join("suppressed_fields", ",").alias("suppressed"), "modo")


@query("matrix_row_errors", "PRJ-04 PRJ-05", ctes("typed_all") + "SELECT client_id, matrix_id, row_number, rule FROM typed_all WHERE rule IS NOT NULL")
def _(t: Tables):
    return typed_all(t).where(F.col("rule").isNotNull()).select("client_id", "matrix_id", "row_number", "rule")


@query("matrix_typed_rows", "PRJ-02 PRJ-03 PRJ-04 PRJ-05 PRJ-06 FN-03 SET-05", ctes("typed") + """SELECT client_id, matrix_id, row_number, producto, imagen, titular, subtitulo, descuento, plantilla, notas,
  array_to_string(formatos, ',') AS formatos, cantidad_propuestas, array_to_string(suppressed_fields, ',') AS suppressed, modo FROM typed""")
def _(t: Tables):
    return typed(t).select("client_id", "matrix_id", "row_number", "producto", "imagen", "titular", "subtitulo", "descuento", "plantilla", "notas",
                           F.array_join("formatos", ",").alias("formatos"), "cantidad_propuestas", F.array_join("suppressed_fields", ",").alias("suppressed"), "modo")


@query("matrix_expand_rows", "WIN-01 FN-04", ctes("expanded") + """SELECT client_id, matrix_id, CAST(row_number AS INT) AS row_number, fila_origen, producto, imagen, precio_actual, precio_anterior, modo FROM expanded""")
def _(t: Tables):
    return expanded(t).select("client_id", "matrix_id", "row_number", "fila_origen", "producto", "imagen", "precio_actual", "precio_anterior", "modo")


@query("matrix_requested_pieces", "AGG-01", ctes("expanded") + """SELECT client_id, matrix_id, CAST(sum(greatest(1, len(formatos)) * cantidad_propuestas) AS BIGINT) AS pieces, count(*) AS rows FROM expanded GROUP BY ALL""")
def _(t: Tables):
    return M.requested_pieces(expanded(t), ["client_id", "matrix_id"])


@query("matrix_product_count", "AGG-03", ctes("typed") + "SELECT client_id, products, count(*) AS rows FROM typed GROUP BY ALL")
def _(t: Tables):
    return typed(t).groupBy("client_id", M.product_count(F.col("producto"), F.col("imagen")).cast("bigint").alias("products")).agg(F.count(F.lit(1)).alias("rows"))


_REQ = ("list_filter([CASE WHEN products > 0 THEN 'producto' END, " + ", ".join(
    f"CASE WHEN {f} <> '' THEN '{'precio' if f == 'precio_actual' else f}' END" for f in K.CONTENT_FIELDS) + "], lambda y: y IS NOT NULL)")


@query("matrix_requested_fields", "PRJ-07", ctes("typed") + f"SELECT client_id, matrix_id, row_number, array_to_string({_REQ}, ',') AS fields FROM typed")
def _(t: Tables):
    return typed(t).select("client_id", "matrix_id", "row_number", F.array_join(M.requested_fields(), ",").alias("fields"))


_TOK = ctes("typed", "formats", "aliases") + """, tokens AS (SELECT client_id, matrix_id, row_number, cantidad_propuestas AS n, CAST(i AS INT) AS pos, tk[i] AS token FROM
 (SELECT *, CASE WHEN len(formatos) > 0 THEN formatos ELSE ['meta_feed_4_5'] END AS tk FROM typed), unnest(range(1, len(tk) + 1)) AS u(i))
"""


@query("format_resolution", "JOI-12", _TOK + resolve_sql("tokens", "client_id, matrix_id, row_number, pos"))
def _(t: Tables):
    tokens = F.when(F.size("formatos") > 0, F.col("formatos")).otherwise(F.array(F.lit(K.DEFAULT_FORMAT)))
    long = typed(t).select("client_id", "matrix_id", "row_number", F.posexplode(tokens).alias("p", "token"))
    return C.resolve_formats(long.select("client_id", "matrix_id", "row_number", (F.col("p") + 1).alias("pos"), "token")).drop("safe")


@query("format_rejects", "JOI-12", _TOK + f"SELECT token, rule, count(*) AS uses FROM ({resolve_sql('tokens', 'client_id')}) WHERE rule IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    long = typed(t).select(F.explode("formatos").alias("token"))
    return C.resolve_formats(long).where(F.col("rule").isNotNull()).groupBy("token", "rule").agg(F.count(F.lit(1)).alias("uses"))


@query("planned_pieces", "AGG-02 SET-05 AGG-04", _TOK + f"""SELECT client_id, matrix_id, CAST(sum(n) AS BIGINT) AS pieces, CAST(sum(width::BIGINT * height * n) AS BIGINT) AS pixels,
 CASE WHEN sum(n) > 120 THEN 'too_many_pieces' WHEN sum(width::BIGINT * height * n) > 240000000 THEN 'too_many_pixels' END AS rule FROM (
 SELECT DISTINCT client_id, matrix_id, row_number, n, format_id, width, height FROM ({resolve_sql('tokens', 'client_id, matrix_id, row_number, n')}) WHERE rule IS NULL) GROUP BY client_id, matrix_id""")
def _(t: Tables):
    p = C.planned_pieces(typed(t), ["client_id", "matrix_id"], "row_number")
    return p.withColumn("rule", F.when(F.col("pieces") > K.MAX_PIECES, "too_many_pieces").when(F.col("pixels") > K.MAX_BATCH_PIXELS, "too_many_pixels"))


_CAND = """, feats AS (SELECT b.client_id, b.candidate_id, b.ord, b.name, b.category, b.range_min, b.range_max,
   list(s.key) AS ids, count_if(starts_with(s.key, 'producto') OR s.category = 'product') AS np, bool_or(s.repeatable) AS rep,
   list(CASE WHEN s.required AND NOT starts_with(s.key, 'producto') THEN s.key END) AS need
  FROM template_base b JOIN template_slots s USING (client_id, candidate_id) WHERE b.approved GROUP BY ALL),
 caps AS (SELECT *, CASE WHEN range_max = 0 THEN np ELSE range_max END AS top, CASE WHEN rep THEN greatest(np, CASE WHEN range_max = 0 THEN np ELSE range_max END) ELSE np END AS cap FROM feats)
"""


def _score_cases():
    fit = " AND ".join(
        f"({f} IS NULL OR list_contains(ids, '{f}')" + (" OR list_contains(ids, 'precio')" if f == "precio_actual" else "") + ")" for f in K.CONTENT_FIELDS)
    present = " + ".join(f"CASE WHEN {f} IS NOT NULL THEN 3.0 ELSE 0 END" for f in K.CONTENT_FIELDS)
    quiet = " + ".join(
        f"CASE WHEN {f} IS NULL AND list_contains(suppressed_fields, '{f}') AND (list_contains(ids, '{f}')" + (" OR list_contains(ids, 'precio')" if f == "precio_actual" else "") + ") THEN 0.25 ELSE 0 END"
        for f in K.CONTENT_FIELDS)
    named = {"precio": "precio_actual", "titular": "titular", "vigencia": "vigencia"}
    lack = " + ".join(f"CASE WHEN list_contains(need, '{k}') AND coalesce({c}, '') = '' THEN 25.0 ELSE 0 END" for k, c in named.items())
    return fit, f"""CAST(CASE WHEN products > 0 AND cap = products THEN 20.0 ELSE 0 END
  + CASE WHEN products >= 2 AND category = 'combo' THEN 8.0 WHEN products = 1 AND coalesce(precio_anterior, precio_actual, cuota, descuento) IS NOT NULL AND category = 'price_promotion' THEN 6.0
         WHEN products = 0 AND category = 'institutional' THEN 6.0 ELSE 0 END + {present} - ({quiet}) - ({lack}) AS DOUBLE)"""


def selection_sql(source: str, forced: str = "plantilla") -> str:
    """Best template per row of ``source``; ``selected(..., candidate_id, score)``."""
    fit, points = _score_cases()
    keep = f"(coalesce({forced}, '') = '' OR lower({forced}) IN (lower(c.name), lower(c.candidate_id)))"
    return f"""SELECT * FROM (SELECT r.*, c.candidate_id, c.name AS template_name, c.score, row_number() OVER (PARTITION BY r.client_id, r.matrix_id, r.row_number ORDER BY c.score DESC NULLS LAST, c.ord) AS rk
 FROM {source} r LEFT JOIN (SELECT r.client_id AS cid, r.matrix_id AS mid, r.row_number AS rno, c.candidate_id, c.name, c.ord, {points} AS score FROM {source} r JOIN caps c ON c.client_id = r.client_id
   WHERE {keep} AND products BETWEEN c.range_min AND c.top AND c.cap >= products AND {fit}) c ON c.cid = r.client_id AND c.mid = r.matrix_id AND c.rno = r.row_number) WHERE rk = 1"""


_EXP = ctes("expanded", "template_base", "template_slots", "formats", "aliases") + _CAND
_EXPROWS = f", erows AS (SELECT * REPLACE (CAST(row_number AS INT) AS row_number), greatest(len({dlist('producto')}), len({dlist('imagen')})) AS products2 FROM expanded), rows AS (SELECT * EXCLUDE (products, products2), products2 AS products FROM erows)\n"


@query("template_selection", "JOI-05 JOI-06", _EXP + _EXPROWS + f"SELECT client_id, matrix_id, row_number, candidate_id, score FROM ({selection_sql('rows')})")
def _(t: Tables):
    return T.select_templates(expanded_once(t), nested_templates(t), ["client_id"]).select("client_id", "matrix_id", "row_number", "candidate_id", "score")


@query("template_scores", "JOI-05", _EXP + _EXPROWS + f"""SELECT client_id, candidate_id, score, count(*) AS rows FROM (SELECT r.client_id, c.candidate_id, {_score_cases()[1]} AS score
  FROM rows r JOIN caps c USING (client_id) WHERE (coalesce(plantilla, '') = '' OR lower(plantilla) IN (lower(c.name), lower(c.candidate_id)))
  AND products BETWEEN c.range_min AND c.top AND c.cap >= products AND {_score_cases()[0]}) GROUP BY ALL""")
def _(t: Tables):
    return T.scores(expanded_once(t), nested_templates(t), ["client_id"]).groupBy("client_id", "candidate_id", "score").agg(F.sum("rows").alias("rows"))


def _pieces(t: Tables):
    """Rows with template x formats x proposals."""
    keys = ["client_id", "matrix_id", "row_number"]
    rows = T.select_templates(expanded_once(t), nested_templates(t), ["client_id"]).where(F.col("candidate_id").isNotNull())
    formats = C.row_formats(rows.select(*keys, "formatos", "producto", "candidate_id", "template_name", "cantidad_propuestas"),
                            [*keys, "producto", "candidate_id", "template_name", "cantidad_propuestas"])
    return formats.select("*", F.explode_outer(F.sequence(F.lit(1), F.col("cantidad_propuestas"))).alias("proposal"))


_PIECES = f""", chosen AS ({selection_sql('rows')}), tokens AS (SELECT client_id, matrix_id, row_number, producto, candidate_id, template_name, cantidad_propuestas AS n, CAST(i AS INT) AS pos, tk[i] AS token FROM
 (SELECT *, CASE WHEN len(formatos) > 0 THEN formatos ELSE ['meta_feed_4_5'] END AS tk FROM chosen WHERE candidate_id IS NOT NULL), unnest(range(1, len(tk) + 1)) AS u(i)),
 pieces AS (SELECT * FROM (SELECT DISTINCT client_id, matrix_id, row_number, producto, candidate_id, template_name, n, format_id, width, height FROM
  ({resolve_sql('tokens', 'client_id, matrix_id, row_number, producto, candidate_id, template_name, n')}) WHERE rule IS NULL) d, unnest(range(1, n + 1)) AS u(proposal))
"""


@query("production_orders", "JOI-06 JOI-12 AGG-02 AGG-04 WIN-01", _EXP + _EXPROWS + _PIECES + """SELECT client_id, matrix_id, template_name, count(*) AS pieces, count(DISTINCT row_number) AS rows,
  CAST(sum(width::BIGINT * height) AS BIGINT) AS pixels FROM pieces GROUP BY ALL""")
def _(t: Tables):
    return _pieces(t).groupBy("client_id", "matrix_id", "template_name").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("row_number").alias("rows"), F.sum(F.col("width").cast("bigint") * F.col("height")).alias("pixels"))


def _manifest_source(t: Tables):
    p = _pieces(t)
    path = {e: O.piece_path(F.col("producto"), F.col("row_number"), F.col("format_id"), F.col("proposal"), e) for e in ("png", "jpg", "psd")}
    return p.select("client_id", "matrix_id", "row_number", F.col("producto").alias("product"), "template_name", "format_id", "proposal", F.lit("ready").alias("status"),
                    *[c.alias(e) for e, c in path.items()],
                    F.array(F.lit("uno"), F.col("format_id")).alias("warnings"))


_SLUGP = "coalesce(nullif(substr(regexp_replace(regexp_replace(strip_accents(coalesce(nullif(producto, ''), 'fila-' || row_number)), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 60), ''), 'producto')"
_PATH = f"{_SLUGP} || '/' || format_id || '/' || printf('fila-%03d_propuesta-%02d', CAST(row_number AS INT), CAST(proposal AS INT))"


@query("piece_manifest", "SNK-01 SNK-03", _EXP + _EXPROWS + _PIECES + f"""SELECT row_number AS fila, producto, template_name AS plantilla, format_id AS formato, CAST(proposal AS INT) AS propuesta, 'ready' AS estado,
  {_PATH} || '.png' AS png, {_PATH} || '.jpg' AS jpg, {_PATH} || '.psd' AS psd, 'uno | ' || format_id AS avisos FROM pieces""")
def _(t: Tables):
    return O.manifest(_manifest_source(t))


@query("matrix_export_lines", "SNK-04", ctes("typed") + """SELECT matrix_id, row_number, concat_ws(',', """ + ", ".join(
    "'\"' || replace(" + {"formatos": "array_to_string(formatos, '|')", "cantidad_propuestas": "CAST(cantidad_propuestas AS VARCHAR)", "modo": "CASE WHEN modo = 'individual' THEN modo ELSE '' END"}.get(h, f"coalesce({h}, '')") + ", '\"', '\"\"') || '\"'"
    for h in O.MATRIX_HEADERS) + ") AS line FROM typed")
def _(t: Tables):
    return O.matrix_lines(typed(t))


# ------------------------------------------------------------------ workbooks
_CELLS = """SELECT 'w' || CAST(CAST(floor(k / 40) AS BIGINT) AS STRING) AS workbook, CAST(CAST(floor(k / 10) AS BIGINT) % 4 AS INT) AS sheet_ord, CAST(1 + k % 10 AS INT) AS row_no, CAST(c.col AS INT) AS col,
 CASE WHEN k % 10 = 2 THEN CASE WHEN c.col < CAST(floor(k / 10) AS BIGINT) % 5 THEN c.head ELSE 'x' END ELSE names END AS value
 FROM orderlines CROSS JOIN (VALUES (0, 'Producto'), (1, 'Imagen'), (2, 'Titular'), (3, 'Precio')) AS c(col, head)"""


def _cells(t: Tables):
    heads = F.array(*[F.lit(h) for h in ("Producto", "Imagen", "Titular", "Precio")])
    o = t.bind("orderlines").select("k", "names", F.posexplode(heads).alias("col", "head"))
    return o.select(
        F.concat(F.lit("w"), F.floor(F.col("k") / 40).cast("string")).alias("workbook"), (F.floor(F.col("k") / 10) % 4).cast("int").alias("sheet_ord"),
        (F.lit(1) + F.col("k") % 10).cast("int").alias("row"), "col",
        F.when(F.col("k") % 10 == 2, F.when(F.col("col") < F.floor(F.col("k") / 10) % 5, F.col("head")).otherwise("x")).otherwise(F.col("names")).alias("value"))


@query("workbook_sheet_pick", "SRC-04", big(ctes("orderlines") + f""", cells AS ({_CELLS}), r AS (SELECT workbook, sheet_ord, row_no, count_if({dslug('value')} IN {_KNOWN}) AS known FROM cells GROUP BY ALL),
 f AS (SELECT workbook, sheet_ord, coalesce(min(row_no) FILTER (known > 0 AND row_no <= 20), min(row_no)) AS header_row FROM r GROUP BY ALL),
 s AS (SELECT f.*, r.known AS score, row_number() OVER (PARTITION BY f.workbook ORDER BY r.known DESC, f.sheet_ord) AS rk FROM f JOIN r ON r.workbook = f.workbook AND r.sheet_ord = f.sheet_ord AND r.row_no = f.header_row)
 SELECT workbook, sheet_ord, header_row, score FROM s WHERE rk = 1 AND score > 0""", "score"))
def _(t: Tables):
    return M.pick_sheet(_cells(t))


@query("workbook_records", "SRC-04", ctes("orderlines") + f""", cells AS ({_CELLS}), r AS (SELECT workbook, sheet_ord, row_no, count_if({dslug('value')} IN {_KNOWN}) AS known FROM cells GROUP BY ALL),
 f AS (SELECT workbook, sheet_ord, coalesce(min(row_no) FILTER (known > 0 AND row_no <= 20), min(row_no)) AS header_row FROM r GROUP BY ALL),
 s AS (SELECT f.*, r.known AS score, row_number() OVER (PARTITION BY f.workbook ORDER BY r.known DESC, f.sheet_ord) AS rk FROM f JOIN r ON r.workbook = f.workbook AND r.sheet_ord = f.sheet_ord AND r.row_no = f.header_row)
 SELECT c.workbook AS matrix_id, CAST(row_no - header_row + 1 AS INT) AS record_no, string_agg(value, '~' ORDER BY col) AS cells FROM cells c JOIN s ON s.workbook = c.workbook AND s.sheet_ord = c.sheet_ord AND rk = 1 AND score > 0
 WHERE row_no >= header_row GROUP BY ALL""")
def _(t: Tables):
    cells = _cells(t)
    return M.sheet_records(cells, M.pick_sheet(cells)).withColumn("cells", F.array_join("cells", "~"))


_SHARED = """SELECT 'w' || CAST(l_orderkey % 50 AS STRING) AS workbook, l_linenumber AS row_no, CASE WHEN l_partkey % 2 = 0 THEN 's' ELSE '' END AS kind, CAST(l_partkey % 120 AS STRING) AS value FROM lineitem"""


@query("workbook_shared_strings", "SRC-05", f"""WITH cells AS ({_SHARED}), strings AS (SELECT DISTINCT 'w' || CAST(p_partkey % 50 AS STRING) AS workbook, CAST(floor(p_partkey / 50) AS INT) AS idx, p_name AS value FROM part)
 SELECT c.workbook, CASE WHEN kind = 's' THEN s.value ELSE c.value END AS value, count(*) AS cells, false AS missing FROM cells c LEFT JOIN strings s ON s.workbook = c.workbook AND kind = 's' AND s.idx = CAST(c.value AS INT)
 WHERE kind = '' OR s.value IS NOT NULL GROUP BY ALL
 UNION ALL SELECT c.workbook, c.value, count(*) AS cells, true FROM cells c LEFT JOIN strings s ON s.workbook = c.workbook AND s.idx = CAST(c.value AS INT) WHERE kind = 's' AND s.value IS NULL GROUP BY ALL""")
def _(t: Tables):
    cells = t.lineitem.select(F.concat(F.lit("w"), (F.col("l_orderkey") % 50).cast("string")).alias("workbook"), F.col("l_linenumber").alias("row_no"),
                              F.when(F.col("l_partkey") % 2 == 0, "s").otherwise("").alias("kind"), (F.col("l_partkey") % 120).cast("string").alias("value"))
    strings = t.part.select(F.concat(F.lit("w"), (F.col("p_partkey") % 50).cast("string")).alias("workbook"), F.floor(F.col("p_partkey") / 50).cast("int").alias("idx"), F.col("p_name").alias("value")).distinct()
    good, bad = M.shared_strings(cells, strings)
    both = good.withColumn("missing", F.lit(False)).unionByName(bad.withColumn("missing", F.lit(True)))
    return both.groupBy("workbook", "value", "missing").agg(F.count(F.lit(1)).alias("cells"))


@query("workbook_column_index", "SRC-06", """SELECT p_partkey, CAST(CASE WHEN p_size < 26 THEN p_size ELSE 26 + (p_size - 26) END AS INT) AS idx FROM (SELECT p_partkey, p_size % 52 AS p_size FROM part)""")
def _(t: Tables):
    n = F.col("p_size") % 52
    letter = F.char(F.lit(65) + n % 26)
    ref = F.concat(F.when(n >= 26, F.lit("A")).otherwise(""), letter, F.lit("12"))
    return t.part.select("p_partkey", M.column_index(ref).alias("idx"))


@query("matrix_encoding", "SRC-03", """SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN '€ 99 – ' || regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') WHEN doc_id % 5 = 4 THEN NULL ELSE text END AS text FROM documents""")
def _(t: Tables):
    k, plain = F.col("doc_id") % 5, F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "UTF-8")
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).when(
        k == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(
        k == 3, F.concat(F.unhex(F.lit("80203939209620")), plain)).otherwise(F.concat(F.unhex(F.lit("8180")), plain))
    return t.documents.select("doc_id", MF.decoded(content).alias("text"))


@query("matrix_quoted_separator", "SRC-02", ctes("orderlines") + "SELECT k AS matrix_id, CASE WHEN k % 2 = 0 THEN ',' ELSE ';' END AS separator FROM orderlines")
def _(t: Tables):
    head = F.when(F.col("k") % 2 == 0, '"Notas; varias",titular,"SKU"').otherwise('SKU;"headline";"notas, ""varias"", count"')
    line = F.when(F.col("k") % 2 == 0, F.concat(F.lit('"a; b; c",'), "names", F.lit(',"uno, dos"'))).otherwise(F.concat(F.lit('x,y;"uno; dos";'), "names"))
    return t.bind("orderlines").select(F.col("k").alias("matrix_id"), M.infer_separator(F.array(head, line, line)).alias("separator"))


@query("source_dispatch", "SRC-07 SRC-11", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'workbook' WHEN 1 THEN 'csv' WHEN 2 THEN 'csv' WHEN 3 THEN 'csv' END AS kind,
 CASE p_partkey % 5 WHEN 0 THEN 'document' WHEN 1 THEN 'document' WHEN 2 THEN 'document' WHEN 3 THEN NULL ELSE 'layered_design' END AS accepted FROM part""")
def _(t: Tables):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".XLSX", ".csv", ".TSV", "", ".psd")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("carpeta.x/"), F.col("p_name"), ext)
    return t.part.select("p_partkey", MF.source_kind(name).alias("kind"), S.extension_kind(name).alias("accepted"))


# -------------------------------------------------------------- product photos
_MATCH = ctes("typed", "assets") + f""", tok AS (SELECT client_id, matrix_id, row_number, products, CAST(i AS INT) AS pos, tk[i] AS token, {dslug('tk[i]')} AS key, {dslug(dstem('tk[i]'))} AS stem FROM
  (SELECT *, CASE WHEN coalesce(imagen, '') <> '' THEN {dlist('imagen')} ELSE {dlist('producto')} END AS tk FROM typed), unnest(range(1, len(tk) + 1)) AS u(i)),
 mk AS (SELECT client_id, asset_id, unnest(list_distinct([{dslug('filename')}, {dslug(dstem('filename'))}])) AS marker FROM assets),
 dt AS (SELECT DISTINCT client_id, key, stem FROM tok),
 ex AS (SELECT DISTINCT d.client_id, d.key, d.stem, m.asset_id FROM dt d JOIN mk m ON m.client_id = d.client_id AND m.marker <> '' AND m.marker IN (d.key, d.stem)),
 fz AS (SELECT DISTINCT d.client_id, d.key, d.stem, m.asset_id FROM dt d JOIN mk m ON m.client_id = d.client_id AND m.marker <> '' AND length(d.key) >= 3 AND (contains(d.key, m.marker) OR contains(m.marker, d.key))
   WHERE NOT EXISTS (SELECT 1 FROM ex e WHERE e.client_id = d.client_id AND e.key = d.key AND e.stem = d.stem)),
 cand AS (SELECT t.*, a.asset_id FROM tok t JOIN (SELECT * FROM ex UNION ALL SELECT * FROM fz) a ON a.client_id = t.client_id AND a.key = t.key AND a.stem = t.stem),
 pt AS (SELECT client_id, matrix_id, row_number, pos, any_value(token) AS token, count(DISTINCT asset_id) AS photos, min(asset_id) AS asset_id FROM cand GROUP BY client_id, matrix_id, row_number, pos),
 found0 AS (SELECT client_id, matrix_id, row_number, asset_id, min(pos) AS pos FROM pt WHERE photos = 1 GROUP BY ALL),
 lone AS (SELECT client_id, min(asset_id) AS asset_id FROM assets GROUP BY client_id HAVING count(*) = 1),
 fb AS (SELECT t.client_id, t.matrix_id, t.row_number, l.asset_id, 1 AS pos FROM typed t JOIN lone l USING (client_id) WHERE t.products > 0 AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.client_id = t.client_id AND c.matrix_id = t.matrix_id AND c.row_number = t.row_number)),
 found AS (SELECT * FROM found0 UNION ALL SELECT * FROM fb)
"""
_K3 = ["client_id", "matrix_id", "row_number"]


@query("product_matches", "JOI-01", _MATCH + "SELECT client_id, matrix_id, row_number, asset_id, CAST(pos - 1 AS INT) AS pos FROM found")
def _(t: Tables):
    return P.matches(typed_once(t), t.bind("assets"), _K3, ["client_id"])


@query("ambiguous_tokens", "JOI-02", _MATCH + "SELECT client_id, matrix_id, row_number, CAST(pos - 1 AS INT) AS pos, token, photos FROM pt WHERE photos > 1")
def _(t: Tables):
    return P.ambiguous(P.token_hits(P.tokens(typed_once(t), _K3), t.bind("assets"), _K3, ["client_id"]), _K3)


@query("asset_usage", "JOI-03", _MATCH + """SELECT a.client_id, a.asset_id, count(DISTINCT CASE WHEN c.row_number IS NOT NULL THEN c.matrix_id || '/' || c.row_number END) AS rows FROM assets a LEFT JOIN cand c ON c.client_id = a.client_id AND c.asset_id = a.asset_id GROUP BY ALL""")
def _(t: Tables):
    return P.rows_of_assets(typed_once(t), t.bind("assets"), _K3, ["client_id"])


@query("missing_products", "JOI-04 TOP-08", _MATCH + """SELECT t.client_id, t.matrix_id, t.row_number, CAST(products AS INT) AS expected, coalesce(f.n, 0) AS found FROM typed t LEFT JOIN (SELECT client_id, matrix_id, row_number, count(*) AS n FROM found GROUP BY ALL) f
 USING (client_id, matrix_id, row_number) WHERE coalesce(f.n, 0) < products""")
def _(t: Tables):
    return P.missing(typed_once(t), t.bind("assets"), _K3, ["client_id"])


@query("row_readiness", "PRJ-18", _MATCH + """SELECT t.client_id, t.matrix_id, t.row_number, CAST(products AS INT) AS expected, coalesce(f.n, 0) AS found, coalesce(a.n, 0) AS unclear,
  coalesce(f.n, 0) >= products AND coalesce(a.n, 0) = 0 AS ready FROM typed t LEFT JOIN (SELECT client_id, matrix_id, row_number, count(*) AS n FROM found GROUP BY ALL) f USING (client_id, matrix_id, row_number)
 LEFT JOIN (SELECT client_id, matrix_id, row_number, count(*) AS n FROM pt WHERE photos > 1 GROUP BY ALL) a USING (client_id, matrix_id, row_number)""")
def _(t: Tables):
    return P.readiness(typed_once(t), t.bind("assets"), _K3, ["client_id"])


@query("render_budgets", "AGG-05", _MATCH + """SELECT client_id, matrix_id, row_number, products, largest, CAST(pixels AS BIGINT) AS pixels, CASE WHEN products > 2 THEN 'too_many_products' WHEN largest > 5000000 THEN 'photo_too_large' WHEN pixels > 6000000 THEN 'too_many_pixels' END AS rule FROM (
 SELECT f.client_id, matrix_id, row_number, count(*) AS products, max(width::BIGINT * height) AS largest, sum(width::BIGINT * height) AS pixels FROM found f JOIN assets a ON a.client_id = f.client_id AND a.asset_id = f.asset_id GROUP BY ALL)""")
def _(t: Tables):
    a = t.bind("assets")
    m = P.matches(typed_once(t), a, _K3, ["client_id"]).join(a.select("client_id", "asset_id", "width", "height"), ["client_id", "asset_id"])
    return P.render_budget(m, _K3, (2, 5_000_000, 6_000_000))


@query("default_budgets", "AGG-05", _MATCH + f"""SELECT client_id, matrix_id, row_number, products, largest, CAST(pixels AS BIGINT) AS pixels, CASE WHEN products > {P.BUDGET[0]} THEN 'too_many_products' WHEN largest > {P.BUDGET[1]} THEN 'photo_too_large' WHEN pixels > {P.BUDGET[2]} THEN 'too_many_pixels' END AS rule FROM (
 SELECT f.client_id, matrix_id, row_number, count(*) AS products, max(width::BIGINT * height * 9) AS largest, sum(width::BIGINT * height * 9) AS pixels FROM found f JOIN assets a ON a.client_id = f.client_id AND a.asset_id = f.asset_id GROUP BY ALL)""")
def _(t: Tables):
    """Photos at three times their size, against the limits of a production."""
    a = t.bind("assets")
    size = a.select("client_id", "asset_id", *[(F.col(c) * 3).alias(c) for c in ("width", "height")])
    return P.render_budget(P.matches(typed_once(t), a, _K3, ["client_id"]).join(size, ["client_id", "asset_id"]), _K3)


@query("chosen_products", "WIN-17", ctes("typed") + f"""SELECT client_id, matrix_id, row_number, array_to_string(imgs, ' | ') AS imagen,
  array_to_string(list_transform(imgs, lambda f: coalesce(nullif(nm[list_position(files, f)], ''), upper(substr(st(f), 1, 1)) || substr(st(f), 2))), ' | ') AS producto
 FROM (SELECT *, list_reverse(files) AS imgs, list_transform(string_split(producto, '|'), lambda x: trim(x)) AS nm FROM (SELECT *, {dlist('imagen')} AS files FROM typed WHERE coalesce(imagen, '') <> '' AND len(list_distinct({dlist('imagen')})) = len({dlist('imagen')})))""".replace(
    "st(f)", "trim(regexp_replace(" + dstem("f") + ", '[_-]+', ' ', 'g'))"))
def _(t: Tables):
    files = X.list_cell(F.col("imagen"))
    rows = typed_once(t).where((F.coalesce("imagen", F.lit("")) != "") & (F.size(F.array_distinct(files)) == F.size(files)))
    return M.chosen_products(rows, F.reverse(files)).select("client_id", "matrix_id", "row_number", "imagen", "producto")
