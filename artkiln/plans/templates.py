"""Queries over templates: plans, values, decisions, memory, overlays, proposals."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import documents as D
from ..operators import templates as T
from .base import Tables, ctes, query
from .matrix import _EXP, _EXPROWS, _REQ, expanded_once, nested_templates, selection_sql, typed
from .quality import _IN, _steps

K3 = ["client_id", "matrix_id", "row_number"]
_FILL = """, fillable AS (SELECT client_id, candidate_id, array_to_string(list_sort(list_distinct(list(f) FILTER (f IS NOT NULL))), ',') AS fillable FROM (SELECT client_id, candidate_id, CASE WHEN NOT generate_if_missing THEN NULL WHEN key IN ('headline', 'title', 'titular') THEN 'titular'
 WHEN key IN ('subheadline', 'subtitle', 'subtitulo') THEN 'subtitulo' WHEN key IN ('call_to_action', 'cta') THEN 'cta' END AS f FROM template_slots) GROUP BY ALL)
"""


@query("fillable_fields", "JOI-07", ctes("template_base", "template_slots") + _FILL + "SELECT client_id, candidate_id, coalesce(fillable, '') AS fillable FROM fillable")
def _(t: Tables):
    return nested_templates(t).select("client_id", "candidate_id", F.array_join(T.fillable_fields(F.col("slots")), ",").alias("fillable"))


_HOME = f""", homes AS (SELECT DISTINCT b.client_id, s.key FROM template_base b JOIN template_slots s USING (client_id, candidate_id) WHERE b.approved),
 hl AS (SELECT client_id, matrix_id, row_number, f AS field FROM (SELECT *, unnest({_REQ}) AS f FROM rows) r WHERE f <> 'producto' AND NOT EXISTS (SELECT 1 FROM homes h WHERE h.client_id = r.client_id AND h.key = r.f))
"""


@query("fields_without_slot", "JOI-08", _EXP + _EXPROWS + _HOME + "SELECT * FROM hl")
def _(t: Tables):
    return T.fields_without_slot(expanded_once(t), nested_templates(t), K3, ["client_id"]).select(*K3, "field")


_PLAN = _EXP + _EXPROWS + _HOME + _FILL + f""", free AS (SELECT * REPLACE ('' AS plantilla) FROM rows WHERE coalesce(plantilla, '') <> ''), sug AS ({selection_sql('free')}), sel AS ({selection_sql('rows')}),
 plan AS (SELECT s.client_id, s.matrix_id, s.row_number, s.fila_origen, CAST(s.products AS INT) AS products, s.candidate_id AS template, CASE WHEN s.candidate_id IS NOT NULL THEN 'ready' WHEN ap.client_id IS NULL THEN 'needs_approval' ELSE 'incompatible' END AS status,
  CASE WHEN s.candidate_id IS NOT NULL THEN 'uses_template' WHEN ap.client_id IS NULL THEN 'nothing_approved' WHEN coalesce(s.plantilla, '') <> '' AND g.candidate_id IS NOT NULL THEN 'forced_but_other_fits'
   WHEN b.blocking IS NOT NULL THEN 'fields_without_slot' WHEN coalesce(s.plantilla, '') <> '' THEN 'forced_and_none_fits' ELSE 'no_combination' END AS reason,
  CASE WHEN s.candidate_id IS NULL THEN g.candidate_id END AS suggested, CASE WHEN s.candidate_id IS NULL THEN coalesce(b.blocking, '') ELSE '' END AS blocking, CASE WHEN s.candidate_id IS NULL THEN '' ELSE coalesce(f.fillable, '') END AS fillable
  FROM sel s LEFT JOIN (SELECT DISTINCT client_id FROM template_base WHERE approved) ap USING (client_id) LEFT JOIN sug g USING (client_id, matrix_id, row_number)
  LEFT JOIN (SELECT client_id, matrix_id, row_number, string_agg(field, ',' ORDER BY field) AS blocking FROM hl GROUP BY ALL) b USING (client_id, matrix_id, row_number) LEFT JOIN fillable f ON f.client_id = s.client_id AND f.candidate_id = s.candidate_id)
"""


def _plans(t: Tables):
    return T.plan_rows(expanded_once(t), nested_templates(t), K3, ["client_id"])


@query("row_plans", "JOI-09 JOI-10", _PLAN + "SELECT client_id, matrix_id, row_number, products, template, status, reason, suggested, blocking, fillable FROM plan")
def _(t: Tables):
    p = _plans(t)
    return p.select(*K3, "products", "template", "status", "reason", "suggested", F.array_join("blocking", ",").alias("blocking"), F.array_join("fillable", ",").alias("fillable"))


@query("plans_by_origin", "JOI-11", _PLAN + """SELECT client_id, matrix_id, CAST(coalesce(fila_origen, row_number) AS INT) AS source_row, arg_min(status, (CAST(status = 'ready' AS INT), row_number)) AS status, arg_min(reason, (CAST(status = 'ready' AS INT), row_number)) AS reason, count(*) AS arts FROM plan GROUP BY ALL""")
def _(t: Tables):
    return T.plans_by_origin(_plans(t), ["client_id", "matrix_id"]).select("client_id", "matrix_id", "source_row", "status", "reason", "arts")


_SEL = _EXP + _EXPROWS + f", sel AS ({selection_sql('rows')})"


@query("drawn_values", "PRJ-08", _SEL + _FILL + """, ks AS (SELECT client_id, candidate_id, list(key) AS keys FROM template_slots GROUP BY ALL) SELECT s.client_id, matrix_id, row_number,
 CASE WHEN list_contains(keys, 'titular') THEN CASE WHEN coalesce(titular, '') = '' AND NOT list_contains(suppressed_fields, 'titular') AND contains(fillable, 'titular') THEN 'Mensaje' ELSE coalesce(titular, '') END ELSE '' END AS headline,
 CASE WHEN list_contains(keys, 'precio') THEN coalesce(precio_actual, '') ELSE '' END AS price, coalesce(cta, '') AS drawn_cta,
 CASE WHEN coalesce(legal, '') = '' AND NOT list_contains(suppressed_fields, 'legal') THEN 'Uno · Dos' ELSE coalesce(legal, '') END AS drawn_legal
 FROM sel s JOIN ks USING (client_id, candidate_id) JOIN fillable f USING (client_id, candidate_id)""")
def _(t: Tables):
    tp = nested_templates(t)
    rows = T.select_templates(expanded_once(t), tp, ["client_id"]).join(tp.select("client_id", "candidate_id", "slots"), ["client_id", "candidate_id"])
    brief = rows.withColumns({"primary_message": F.lit("Mensaje"), "objective": F.lit("Objetivo"), "creative_concept": F.lit("Concepto"),
                              "legal_requirements": F.array(F.lit(" Uno "), F.lit("Conservar los legales del arte"), F.lit(""), F.lit("Dos"))})
    return T.drawn_values(brief).select(*K3, "headline", "price", "drawn_cta", "drawn_legal")


@query("copy_fill_in", "JOI-37", ctes("typed") + """SELECT client_id, matrix_id, row_number, coalesce(titular, CASE WHEN NOT list_contains(suppressed_fields, 'titular') AND row_number % 3 <> 0 THEN 'Titular ' || row_number END) AS titular,
 coalesce(cta, CASE WHEN NOT list_contains(suppressed_fields, 'cta') AND row_number % 3 = 1 THEN 'Pide' END) AS cta,
 concat_ws(',', CASE WHEN titular IS NULL AND NOT list_contains(suppressed_fields, 'titular') AND row_number % 3 <> 0 THEN 'titular' END, CASE WHEN cta IS NULL AND NOT list_contains(suppressed_fields, 'cta') AND row_number % 3 = 1 THEN 'cta' END) AS ai FROM typed
 WHERE (titular IS NULL AND NOT list_contains(suppressed_fields, 'titular')) OR (cta IS NULL AND NOT list_contains(suppressed_fields, 'cta'))""")
def _(t: Tables):
    rows = typed(t).withColumn("fillable", F.array(F.lit("titular"), F.lit("cta")))
    pend = T.pending_copy(rows)
    up = pend.where(F.col("row_number") % 3 != 0).select(
        *K3, F.concat(F.lit("Titular "), F.col("row_number").cast("string")).alias("new_titular"), F.lit("no").alias("new_subtitulo"), F.when(F.col("row_number") % 3 == 1, "Pide").otherwise("").alias("new_cta"))
    return T.fill_copy(pend, up, K3).select(*K3, "titular", "cta", F.array_join("ai_fields", ",").alias("ai"))


@query("brief_overrides", "PRJ-23", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 <> 0 THEN 'corregido' ELSE c_name END AS objective, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 10 <> 0 THEN 'otro' ELSE c_mktsegment END AS tone FROM customer""")
def _(t: Tables):
    base = t.customer.select("c_custkey", F.col("c_name").alias("objective"), F.col("c_mktsegment").alias("tone"))
    ch = t.customer.where((F.col("c_custkey") % 5 == 0) | (F.col("c_custkey") % 3 == 0)).select(
        "c_custkey", F.when((F.col("c_custkey") % 5 == 0) & (F.col("c_custkey") % 3 != 0), "corregido").alias("objective"), F.when((F.col("c_custkey") % 3 == 0) & (F.col("c_custkey") % 10 != 0), "otro").alias("tone"))
    return T.overrides(base, ch, ["c_custkey"], ["objective", "tone"])


_PROP = """SELECT o_custkey AS client, o_orderpriority AS category, o_orderkey AS ord, 'p' || o_orderkey AS candidate_id, 'h' || (o_orderkey % 3) AS revision_hash, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'proposed' END AS status FROM orders"""


@query("kept_decisions", "JOI-18", f"""WITH o AS ({_PROP}), l AS (SELECT client, category, arg_max(revision_hash, ord) AS h, arg_max(status, ord) AS st, arg_max(candidate_id, ord) AS cid FROM o WHERE ord % 2 = 0 GROUP BY ALL)
 SELECT o.client, o.category, ord, CASE WHEN st <> 'proposed' AND h = revision_hash THEN cid ELSE candidate_id END AS candidate_id, CASE WHEN st <> 'proposed' AND h = revision_hash THEN st ELSE 'proposed' END AS status FROM o LEFT JOIN l USING (client, category) WHERE ord % 2 = 1""")
def _(t: Tables):
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("proposed")
    o = t.orders.select(F.col("o_custkey").alias("client"), F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("candidate_id"),
                        F.concat(F.lit("h"), (F.col("o_orderkey") % 3).cast("string")).alias("revision_hash"), status.alias("status"), (status == "approved").alias("approved"), F.col("o_orderdate").alias("approved_at"), F.lit("").alias("decision_notes"))
    fresh = o.where(F.col("ord") % 2 == 1).withColumn("status", F.lit("proposed")).withColumn("approved", F.lit(False))
    return T.keep_decisions(fresh, o.where(F.col("ord") % 2 == 0), ["client"]).select("client", "category", "ord", "candidate_id", "status")


@query("client_memory", "JOI-19", """WITH m AS (SELECT o_custkey AS client, o_orderpriority AS category, arg_max(o_orderkey, o_orderdate * 1) AS k FROM (SELECT o_custkey, o_orderpriority, o_orderkey, epoch_us(o_orderdate) + o_orderkey AS o_orderdate FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL)
 SELECT c_custkey AS client, p.category, CASE WHEN k % 3 = 0 OR k IS NULL THEN 'propia' ELSE 'capas ' || k END AS layout_intent, CAST(CASE WHEN k IS NULL THEN 1 ELSE 1 + k % 4 END AS INT) AS range_min, 'c' || k AS learned_from
 FROM customer CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) AS p(category) LEFT JOIN m ON m.client = c_custkey AND m.category = p.category""")
def _(t: Tables):
    k = F.col("o_orderkey")
    mem = t.orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("client"), F.col("o_orderpriority").alias("category"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("capas "), k.cast("string"))).alias("layout_intent"), F.lit("r").alias("rationale"),
        (F.lit(1) + k % 4).cast("int").alias("range_min"), F.lit(9).alias("range_max"), F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) + k).alias("approved_at"))
    props = t.customer.select(F.col("c_custkey").alias("client"), F.explode(F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])).alias("category"), F.lit("propia").alias("layout_intent"), F.lit("").alias("rationale"),
                              F.lit(1).alias("range_min"), F.lit(1).alias("range_max"), F.lit("proposed").alias("status"), F.lit(False).alias("approved"))
    return T.with_memory(props, mem, ["client"]).select("client", "category", "layout_intent", "range_min", "learned_from")


@query("placement_overlay", "JOI-20", """WITH s AS (SELECT l_suppkey AS campaign, CASE l_linenumber % 3 WHEN 0 THEN 'square' WHEN 1 THEN 'story' ELSE 'portrait' END AS aspect, l_orderkey * 10 + l_linenumber AS ord, 'b' || l_partkey AS boxes,
  CASE l_partkey % 40 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS rk FROM lineitem), m AS (SELECT campaign, aspect, arg_min(boxes, (rk, ord, boxes)) AS boxes FROM s GROUP BY ALL), v AS (SELECT campaign, min(rk) = 0 AS vec FROM s GROUP BY ALL),
 c AS (SELECT s_suppkey AS campaign, 'own' || s_suppkey AS boxes, 'story' AS aspect FROM supplier)
 SELECT coalesce(c.campaign, m.campaign) AS campaign, coalesce(c.aspect, m.aspect) AS aspect, CASE WHEN vec THEN coalesce(m.boxes, c.boxes) ELSE coalesce(c.boxes, m.boxes) END AS boxes FROM c FULL JOIN m USING (campaign, aspect) LEFT JOIN v ON v.campaign = coalesce(c.campaign, m.campaign)""")
def _(t: Tables):
    o = F.col("l_partkey") % 40
    s = t.lineitem.select(
        F.col("l_suppkey").alias("campaign"), F.when(F.col("l_linenumber") % 3 == 0, "square").when(F.col("l_linenumber") % 3 == 1, "story").otherwise("portrait").alias("aspect"),
        F.concat((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).cast("bigint").alias("o0"), F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("boxes"),
        F.when(o == 0, "vector").when(o.isin(1, 2), "psd").otherwise("ocr").alias("origin"))
    s = s.withColumn("ord", F.struct("o0", "boxes")).drop("o0")
    c = t.supplier.select(F.col("s_suppkey").alias("campaign"), F.lit("x").alias("candidate_id"), F.lit("story").alias("aspect"), F.concat(F.lit("own"), F.col("s_suppkey").cast("string")).alias("boxes"))
    return T.overlay_placements(c, s, ["campaign"]).select("campaign", "aspect", "boxes")


_STYLES = """WITH s AS (SELECT l_suppkey AS campaign, l_orderkey * 10 + l_linenumber AS ord, 'k' || l_partkey AS tie, CASE l_partkey % 40 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS rk, l_suppkey % 5 > 0 AND l_linenumber = 3 AS measured,
   CASE WHEN l_linenumber % 2 = 0 THEN ['cta', 'slot' || l_partkey % 4] ELSE [] END AS slots, '#' || l_partkey AS color, CASE WHEN l_partkey % 3 > 0 THEN 'upper' END AS tcase FROM lineitem WHERE l_suppkey % 7 > 0),
 f AS (SELECT campaign, bool_or(measured) AS measured, min(rk) = 0 AS vec, arg_min([tcase], (rk, ord, tie))[1] AS tcase FROM s GROUP BY ALL HAVING bool_or(measured)),
 c AS (SELECT campaign, slot, arg_min(color, (rk, ord, tie)) AS color FROM (SELECT *, unnest(list_distinct(slots)) AS slot FROM s) GROUP BY ALL),
 g AS (SELECT campaign, string_agg(slot || '=' || color, ',' ORDER BY slot) AS colors FROM c GROUP BY ALL),
 own AS (SELECT s_suppkey AS campaign, k AS candidate_id, CASE WHEN k = 'b' THEN 'cta=#own' ELSE '' END AS colors FROM supplier, (VALUES ('a'), ('b')) AS v(k))
 SELECT campaign, candidate_id, CASE WHEN f.measured AND g.colors IS NOT NULL AND (vec OR own.colors = '') THEN g.colors ELSE own.colors END AS text_colors,
  CASE WHEN vec THEN CASE WHEN tcase IS NULL THEN '' ELSE 'cta=' || tcase END END AS text_case, coalesce(vec, false) AS plate_measured FROM own LEFT JOIN f USING (campaign) LEFT JOIN g USING (campaign)"""


@query("placement_styles", "JOI-20", _STYLES)
def _(t: Tables):
    pk, none = F.col("l_partkey"), F.create_map().cast("map<string,string>")
    o, colour = pk % 40, F.concat(F.lit("#"), pk.cast("string"))
    s = t.lineitem.where(F.col("l_suppkey") % 7 > 0).select(
        F.col("l_suppkey").alias("campaign"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.concat(F.lit("k"), pk.cast("string")).alias("tie")).alias("ord"),
        F.when(o == 0, "vector").when(o.isin(1, 2), "psd").when(o == 3, "none").otherwise("ocr").alias("origin"), ((F.col("l_suppkey") % 5 > 0) & (F.col("l_linenumber") == 3)).alias("measured"),
        F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("cta"), colour, F.concat(F.lit("slot"), (pk % 4).cast("string")), colour)).otherwise(none).alias("text_colors"),
        F.when(pk % 3 > 0, F.create_map(F.lit("cta"), F.lit("upper"))).alias("text_case"))
    c = t.supplier.select(F.col("s_suppkey").alias("campaign"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("candidate_id"))
    c = c.withColumn("text_colors", F.when(F.col("candidate_id") == "b", F.create_map(F.lit("cta"), F.lit("#own"))).otherwise(none))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return T.overlay_styles(c, s, ["campaign"]).select("campaign", "candidate_id", flat("text_colors").alias("text_colors"), flat("text_case").alias("text_case"), "plate_measured")


@query("plate_choice", "JOI-40", """WITH p AS (SELECT l_suppkey AS campaign, 's' || (l_partkey % 5) AS source_id, CASE l_partkey % 50 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS rk, (300 + l_partkey % 9 * 100) / (300 + l_orderkey % 7 * 100) AS ar, l_orderkey * 10 + l_linenumber AS ord,
  CASE WHEN l_partkey % 3 = 0 THEN 'bare' || l_partkey ELSE 'pl' || l_partkey END AS plate FROM lineitem), o AS (SELECT s_suppkey AS campaign, 'k' AS candidate_id, f AS format_id, w / h AS ar FROM supplier CROSS JOIN (VALUES ('a', 1080, 1080), ('b', 1080, 1920)) AS v(f, w, h))
 SELECT o.campaign, o.format_id, arg_min(plate, (rk, CASE WHEN source_id IN ('s1', 's3') THEN 0 ELSE 1 END, abs(p.ar - o.ar), ord, plate)) AS plate FROM o JOIN p USING (campaign) GROUP BY ALL""")
def _(t: Tables):
    l = F.col
    p = t.lineitem.select(
        l("l_suppkey").alias("campaign"), F.concat(F.lit("s"), (l("l_partkey") % 5).cast("string")).alias("source_id"), F.when(l("l_partkey") % 50 == 0, "vector").when(l("l_partkey") % 50 == 1, "ocr").otherwise("psd").alias("origin"),
        (F.lit(300) + l("l_partkey") % 9 * 100).cast("int").alias("plate_w"), (F.lit(300) + l("l_orderkey") % 7 * 100).cast("int").alias("plate_h"), F.concat(F.lit("pl"), l("l_partkey").cast("string")).alias("path"),
        F.when(l("l_partkey") % 3 == 0, F.concat(F.lit("bare"), l("l_partkey").cast("string"))).alias("bare_path"), (l("l_orderkey") * 10 + l("l_linenumber")).alias("o0"))
    p = p.withColumn("ord", F.struct("o0", F.coalesce("bare_path", "path").alias("p")))
    out = t.supplier.select(l("s_suppkey").alias("campaign"), F.lit("k").alias("candidate_id"), F.array(F.lit("s1"), F.lit("s3")).alias("source_ids"),
                            F.explode(F.array(F.struct(F.lit("a").alias("format_id"), F.lit(1080).alias("width"), F.lit(1080).alias("height")), F.struct(F.lit("b").alias("format_id"), F.lit(1080).alias("width"), F.lit(1920).alias("height")))).alias("o"))
    return T.choose_plates(out.select("campaign", "candidate_id", "source_ids", "o.*"), p, ["campaign"], bare=True).select("campaign", "format_id", "plate")


@query("template_checks", "PRJ-12 AGG-14", """WITH s AS (SELECT l_orderkey AS template_id, l_linenumber AS n, l_partkey AS pk, l_suppkey AS sk FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))
 SELECT template_id, count(*) AS slots, concat_ws(',', CASE WHEN count_if(pk % 4 = 0) = 0 THEN 'no_product_slot' END, CASE WHEN count(*) < 2 AND any_value(template_id) % 3 > 0 THEN 'few_slots' END, CASE WHEN any_value(template_id) % 5 = 0 THEN 'no_plate' END,
  string_agg('small_box:' || n, ',' ORDER BY n) FILTER (pk % 50 = 0), string_agg('small_font:' || n, ',' ORDER BY n) FILTER (pk % 4 <> 0 AND sk % 30 < 12)) AS warnings FROM s GROUP BY template_id""")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    one = t.lineitem.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    pk = F.col("l_partkey")
    slot = F.struct(F.col("l_linenumber").cast("string").alias("key"), F.when(pk % 4 == 0, "product").otherwise("headline").alias("category"), F.when(pk % 4 == 0, "image").otherwise("text").alias("kind"),
                    F.when(pk % 50 == 0, 0.01).otherwise(0.3).alias("width"), F.lit(0.2).alias("height"), (F.col("l_suppkey") % 30).cast("int").alias("font_size"), F.lit(12).alias("min_font_size"))
    tp = one.groupBy(F.col("l_orderkey").alias("template_id")).agg(F.array_sort(F.collect_list(slot)).alias("slots")).withColumn("fixed_layers", F.col("template_id") % 3).withColumn("has_plate", F.col("template_id") % 5 != 0)
    return T.template_checks(tp).join(tp.select("template_id", F.size("slots").cast("bigint").alias("slots")), "template_id").select("template_id", "slots", F.array_join("warnings", ",").alias("warnings"))


@query("template_summary", "AGG-14", ctes("template_base", "template_slots") + """SELECT candidate_id AS template_id, CAST(count(*) AS INT) AS slots, CAST(count_if(required) AS INT) AS required_slots, CAST(2 AS INT) AS formats_approved, CAST(1 AS INT) AS formats_proposed FROM template_slots GROUP BY ALL""")
def _(t: Tables):
    m = F.array(*[F.struct(F.lit(b).alias("approved")) for b in (True, False, True)])
    return T.template_summary(nested_templates(t).withColumn("template_id", F.col("candidate_id")).withColumn("fixed_layers", F.lit(1)).withColumn("masters", m)).drop("fixed_layers")


@query("valid_sources", "JOI-38", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'a' END, CASE WHEN p_partkey % 5 = 0 THEN 'b' END) ELSE 'f' END AS ids FROM part""")
def _(t: Tables):
    ids = F.array_compact(F.array(F.when(F.col("p_partkey") % 3 == 0, "a"), F.lit("zz"), F.when(F.col("p_partkey") % 5 == 0, "b")))
    return t.part.select("p_partkey", F.array_join(T.valid_sources(ids, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("f"))), ",").alias("ids"))


@query("instruction_bias", "FN-26", """SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1.18 ELSE 1.0 END * CASE WHEN p_partkey % 3 = 0 THEN 0.94 ELSE 1.0 END AS DOUBLE) AS product_scale, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'hero_product_overlay' END, CASE WHEN p_partkey % 5 = 0 THEN 'product_left' END, CASE WHEN p_partkey % 7 = 0 THEN 'product_right' END) AS layouts,
 CASE WHEN p_partkey % 7 = 0 THEN 'right' WHEN p_partkey % 5 = 0 THEN 'left' END AS product_horizontal, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS extra_air, CASE WHEN p_partkey % 11 = 0 THEN 'split_right' WHEN p_partkey % 13 = 0 THEN 'price_focus' END AS archetype FROM part""")
def _(t: Tables):
    k = F.col("p_partkey")
    text = F.concat_ws(" ", F.col("p_type"), *[F.when(k % n == 0, w) for n, w in ((2, "Producto GRANDE"), (3, "más limpio"), (5, "a la Izquierda"), (7, "y derecha"))])
    note = F.concat_ws(" ", F.when(k % 13 == 0, "Precio grande"), F.when(k % 11 == 0, "producto a la derecha"))
    return t.part.select("p_partkey", T.instruction_bias(text).alias("b"), T.feedback_style(note).alias("s")).select(
        "p_partkey", "b.product_scale", F.array_join("b.preferred_layouts", ",").alias("layouts"), "b.product_horizontal", "b.extra_air", "s.archetype")


@query("proposal_canonical", "FN-27", """SELECT p_partkey, category, slots, CAST(greatest(1, lo) AS INT) AS lo, CAST(greatest(greatest(1, lo), hi) AS INT) AS hi FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 2 WHEN p_partkey % 4 = 1 THEN 3 WHEN category = 'combo' THEN 2 ELSE 1 END AS lo, CASE WHEN p_partkey % 4 = 0 THEN 4 WHEN p_partkey % 4 = 1 THEN 3 WHEN category = 'combo' THEN 4 ELSE 1 END AS hi FROM (
 SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'combo' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'combo' ELSE 'price_promotion' END ELSE 'institutional' END AS category, CASE WHEN p_partkey % 2 = 0 THEN 'productos,titular,precio' ELSE 'titular,precio' END AS slots FROM part))""")
def _(t: Tables):
    k = F.col("p_partkey")
    cat = F.when(k % 3 == 0, "Bundle").when(k % 3 == 1, "rara").otherwise("Branding")
    keys = F.array_compact(F.array(F.when(k % 2 == 0, "Products"), F.lit("Main Title"), F.lit("desconocido"), F.lit("headline"), F.lit("Sale price")))
    slots = T.proposal_slots(keys)
    c = T.proposal_category(cat, F.transform(slots, lambda s: s["key"]))
    none = F.lit(None).cast("string")
    free = F.when(k % 4 == 0, "2-4").when(k % 4 == 1, "3 productos")
    return t.part.select("p_partkey", c.alias("category"), F.array_join(F.transform(slots, lambda s: s["key"]), ",").alias("slots"), T.proposal_range(none, none, none, free, c).alias("r")).select(
        "p_partkey", "category", "slots", F.col("r.minimum").alias("lo"), F.col("r.maximum").alias("hi"))


@query("content_fingerprints", "FN-29", """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}') AS revision_hash FROM part""")
def _(t: Tables):
    return t.part.select("p_partkey", T.content_fingerprint(["p_name", "p_brand", "p_size"]).alias("revision_hash"))


# ------------------------------------------------------------------ documents
_P = ctes("lines") + """, pg AS (SELECT DISTINCT CAST(floor(k / 10) AS BIGINT) AS doc, k % 10 AS page FROM lines), im AS (SELECT CAST(floor(k / 10) AS BIGINT) AS doc, k % 10 AS page, ord, CAST(pk AS INT) AS xref, pk % 3 = 0 AS alpha, h % 900 AS x, h % 500 AS y, 100 + pk % 500 AS width, 100 + sk * 4 AS height FROM lines)"""


def _pages(t: Tables):
    l = t.bind("lines").where(F.col("ln") >= 1)
    keys = [F.floor(F.col("k") / 10).alias("doc"), (F.col("k") % 10).alias("page")]
    pages = l.select(*keys).distinct().select("doc", "page", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1200).alias("width"), F.when(F.col("doc") % 4 == 0, 300).otherwise(900).alias("height"))
    images = l.select(*keys, "ord", F.col("pk").cast("int").alias("xref"), (F.col("pk") % 3 == 0).alias("alpha"), (F.col("h") % 900).cast("int").alias("x"), (F.col("h") % 500).cast("int").alias("y"),
                      (F.lit(100) + F.col("pk") % 500).cast("int").alias("width"), (F.lit(100) + F.col("sk") * 4).cast("int").alias("height"))
    return pages, images


_FIT = """SELECT doc || '/' || page AS image_id, doc, page, ord, xref, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(width AS INT) AS width, CAST(height AS INT) AS height FROM (SELECT *, CASE WHEN doc % 4 = 0 THEN 300 ELSE 900 END AS ph FROM im)
 WHERE NOT alpha AND xref > 0 AND x + width <= 1200 AND y + height <= ph AND width * height / (1200 * ph) BETWEEN 0.10 AND 0.85 AND width / height BETWEEN 0.45 AND 2.3"""
_PIECE = "{'doc': %sdoc, 'page': %spage, 'ord': %sord, 'xref': %sxref, 'x': %sx, 'y': %sy, 'width': %swidth, 'height': %sheight}"


@query("document_pieces", "WIN-19", (_P + _steps(
    _FIT, "ord", f"[{_PIECE % (('',) * 8)}]", f"CASE WHEN len(list_filter(st, lambda k: {_IN} > 0.5 * greatest(1, s.width * s.height))) > 0 THEN st ELSE list_append(st, {_PIECE % (('s.',) * 8)}) END",
    """SELECT k.doc, k.page, k.ord, k.xref, k.x, k.y, k.width, k.height, 'frame' AS kind FROM (SELECT unnest(st) AS k FROM fin)
 UNION ALL SELECT doc, page, 0, 0, 0, 0, 1200, CASE WHEN doc % 4 = 0 THEN 300 ELSE 900 END, 'page' FROM pg WHERE doc % 4 <> 0 AND doc NOT IN (SELECT doc FROM src) AND (doc, page) IN (SELECT doc, page FROM im)""")).replace("WITH ", "WITH RECURSIVE ", 1))
def _(t: Tables):
    pages, images = _pages(t)
    return D.frames_or_pages(pages, images, ["doc"])


@query("text_identity", "AGG-28 FN-31", ctes("lines") + """, tx AS (SELECT CAST(floor(k / 8) AS BIGINT) AS doc, k % 8 AS piece_id, ord, CASE pk % 6 WHEN 0 THEN 'Gran Fiesta' WHEN 1 THEN 'GRAN  fiesta' WHEN 2 THEN '$' || price WHEN 3 THEN 'Modelo ' || sk ELSE 'Sello' END AS text, pk % 23 = 0 AS rotated FROM lines),
 kx AS (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS key FROM tx), pc AS (SELECT DISTINCT doc, piece_id, piece_id % 3 AS products FROM tx), pp AS (SELECT doc, piece_id, key, count(*) AS times FROM kx GROUP BY ALL),
 sp AS (SELECT doc, key, count(*) AS n, bool_or(products = 0) AS bare FROM pp JOIN pc USING (doc, piece_id) GROUP BY ALL), mn AS (SELECT doc, count(*) > 1 AS many FROM pc GROUP BY ALL)
 SELECT doc, piece_id, ord, CASE WHEN rotated OR (times >= 3 AND NOT regexp_matches(text, '\\d')) THEN 'decoration' WHEN many AND NOT regexp_matches(text, '\\d') AND (n >= 3 OR (n >= 2 AND bare)) THEN 'fixed' ELSE 'variable' END AS role,
 regexp_matches(text, '\\d') AND contains(text, '$') AS price FROM kx JOIN pp USING (doc, piece_id, key) JOIN sp USING (doc, key) JOIN mn USING (doc)""")
def _(t: Tables):
    p = F.col("pk") % 6
    text = F.when(p == 0, "Gran Fiesta").when(p == 1, "GRAN  fiesta").when(p == 2, F.concat(F.lit("$"), F.col("price").cast("string"))).when(p == 3, F.concat(F.lit("Modelo "), F.col("sk").cast("string"))).otherwise("Sello")
    tx = t.bind("lines").select(F.floor(F.col("k") / 8).alias("doc"), (F.col("k") % 8).alias("piece_id"), "ord", text.alias("text"), (F.col("pk") % 23 == 0).alias("rotated"))
    pc = tx.select("doc", "piece_id").distinct().withColumn("products", F.col("piece_id") % 3)
    return D.text_roles(tx, pc, ["doc"]).select("doc", "piece_id", "ord", "role", D.price_texts(F.col("text")).alias("price"))


@query("best_pieces", "TOP-01", """WITH p AS (SELECT CAST(floor(o_orderkey / 12) AS BIGINT) AS doc, o_orderkey AS piece_id, o_orderkey % 12 AS page, o_custkey % 3 AS products, o_custkey % 2 AS prices, o_orderkey % 15 AS fields, o_custkey % 11 = 0 AS catalog, 100 + o_custkey % 900 AS width, 400 AS height FROM orders),
 a AS (SELECT *, CASE WHEN height / width >= 1.62 THEN 'story' WHEN height / width > 1.2 THEN 'portrait' WHEN width / height > 1.35 THEN 'landscape' ELSE 'square' END AS aspect FROM p WHERE NOT catalog AND (prices > 0 OR (products > 0 AND fields > 0)))
 SELECT doc, aspect, piece_id FROM (SELECT *, row_number() OVER (PARTITION BY doc, aspect ORDER BY products = 0, prices = 0, NOT fields BETWEEN 2 AND 12, page, piece_id) AS rk FROM a) WHERE rk = 1""")
def _(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = t.orders.select(F.floor(k / 12).alias("doc"), k.alias("piece_id"), (k % 12).alias("page"), (c % 3).alias("products"), (c % 2).alias("prices"), (k % 15).alias("fields"), (c % 11 == 0).alias("catalog"), (F.lit(100) + c % 900).alias("width"), F.lit(400).alias("height"), F.lit(0).alias("x"))
    return D.best_pieces(p, ["doc"]).select("doc", "aspect", "piece_id")


@query("piece_product_boxes", "AGG-37", ctes("placements") + """SELECT variant_id, CAST(round_even((min(greatest(x, 50)) - 50) * 0.5, 0) AS INT) AS x0, CAST(round_even((min(greatest(y, 40)) - 40) * 0.5, 0) AS INT) AS y0, CAST(round_even((max(least(x + width, 1000)) - 50) * 0.5, 0) AS INT) AS x1, CAST(round_even((max(least(y + height, 900)) - 40) * 0.5, 0) AS INT) AS y1
 FROM placements WHERE category = 'product' GROUP BY ALL""")
def _(t: Tables):
    p = t.bind("placements")
    pr = p.where(F.col("category") == "product").select("variant_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    frame = p.select("variant_id").distinct().select("variant_id", F.lit(50).alias("fx0"), F.lit(40).alias("fy0"), F.lit(1000).alias("fx1"), F.lit(900).alias("fy1"), F.lit(0.5).alias("scale"))
    return D.product_boxes(pr, frame, ["variant_id"])


@query("manifest_reads", "PRJ-25", ctes("reads") + """SELECT art_id, ord, left(trim(text), 200) AS text, x0 - 5 AS x0, y0 - 7 AS y0, x1 - 5 AS x1, y1 - 7 AS y1 FROM reads WHERE role = 'content'""")
def _(t: Tables):
    from ..operators.projects import manifest_reads

    m = t.bind("reads").withColumn("kind", F.when(F.col("role") == "content", "type").otherwise("pixel")).drop("role", "confidence").withColumn("frame_x", F.lit(5)).withColumn("frame_y", F.lit(7))
    return manifest_reads(m).select("art_id", "ord", "text", "x0", "y0", "x1", "y1")


