"""Queries over touches, jobs, uploads, profiles and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lifecycle as C
from ..operators import projects as P
from ..operators import payloads as PL
from ..operators.plugins import detect_with, score_with
from ..sources import files as S
from ..sources import sinks as O
from ..session import shared_folder
from ..sources import store as ST
from ..streaming import jobs as J
from .base import ORACLE, Tables, big, ctes, query

_NOW = "TIMESTAMP '2024-01-30 12:00:00'"


@query("expired_projects", "WIN-11 STR-03", ctes("touches") + f""", l AS (SELECT project_id, max(ts) AS last FROM touches GROUP BY ALL), s AS (SELECT *, row_number() OVER (ORDER BY last DESC, project_id) AS rk FROM l WHERE last >= {_NOW} - INTERVAL 48 HOUR)
 SELECT project_id, last, 'age' AS reason FROM l WHERE last < {_NOW} - INTERVAL 48 HOUR UNION ALL SELECT project_id, last, 'count' FROM s WHERE rk > 100""")
def _(t: Tables):
    return C.expired_projects(t.bind("touches"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"), 48, 100)


@query("idle_sessions", "STR-03", ctes("touches") + """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project_id ORDER BY ts, touch_id) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS c FROM touches), s AS (SELECT *, sum(c) OVER (PARTITION BY project_id ORDER BY ts, touch_id) AS n FROM g)
 SELECT project_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS "end", count(*) AS touches FROM s GROUP BY project_id, n""")
def _(t: Tables):
    return C.idle_sessions(t.bind("touches"), "project_id").select("project_id", "start", "end", "touches")


@query("learned_rules", "WIN-12", """WITH RECURSIVE e AS (SELECT user_id AS client, event_type || CAST(floor(value / 2) AS BIGINT) AS rule, event_id AS ord, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
 log AS (SELECT client, n, [{'rule': rule, 'ord': ord}] AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.client, e.n, CASE WHEN len(list_filter(kept, lambda x: x.rule = e.rule)) > 0 THEN kept ELSE list_append(kept, {'rule': e.rule, 'ord': e.ord})[-10:] END FROM log JOIN e ON e.client = log.client AND e.n = log.n + 1)
 SELECT client, x.rule AS rule, x.ord AS ord FROM (SELECT client, unnest(kept) AS x FROM log WHERE n = (SELECT max(n) FROM e WHERE e.client = log.client))""")
def _(t: Tables):
    log = t.events.select(F.col("user_id").alias("client"), F.concat("event_type", F.floor(F.col("value") / 2).cast("string")).alias("rule"), F.col("event_id").alias("ord"))
    return C.learned_rules(log, "client", 10)


@query("client_profiles", "AGG-13", """WITH cc AS (SELECT c_nationkey AS client, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT s_nationkey AS client, count(*) AS n FROM supplier GROUP BY ALL), m AS (SELECT c_nationkey AS client, count(*) AS n, max(o_orderdate) AS mx FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY ALL)
 SELECT n_nationkey AS client, n_name AS name, coalesce(cc.n, 0) AS campaigns, coalesce(s.n, 0) + coalesce(m.n, 0) AS templates, coalesce(m.n, 0) AS approved_candidates, coalesce(cc.n, 0) AS learned_rules, greatest(mx, TIMESTAMP '1998-01-01') AS updated_at FROM nation LEFT JOIN cc ON cc.client = n_nationkey LEFT JOIN s ON s.client = n_nationkey LEFT JOIN m ON m.client = n_nationkey""")
def _(t: Tables):
    cl = t.nation.select(F.col("n_nationkey").alias("client"), F.col("n_name").alias("name"), F.lit("1998-01-01").cast("timestamp_ntz").alias("updated_at"))
    camp = t.customer.select(F.col("c_nationkey").alias("client"))
    mem = t.orders.where("o_orderstatus = 'F'").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("client"), F.col("o_orderdate").alias("approved_at"))
    return C.client_profiles(cl, camp, t.supplier.select(F.col("s_nationkey").alias("client")), mem, camp, "client")


@query("delete_impact", "AGG-15", big("""SELECT c_custkey AS campaign, count(o_orderkey) AS batches, count_if(o_orderstatus = 'P') AS active_jobs, count_if(o_orderstatus = 'P') = 0 AS allowed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""", "active_jobs"))
def _(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("campaign"), "o_orderstatus")
    return C.delete_impact(t.customer.select(F.col("c_custkey").alias("campaign")), ["campaign"], batches=o, active_jobs=o.where("o_orderstatus = 'P'"))


@query("unseen_content", "JOI-21 STR-05", """WITH u AS (SELECT doc_id % 10 AS campaign, doc_id AS ord, sha256(text) AS sha256 FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY campaign, sha256 ORDER BY ord) AS rk FROM u WHERE ord % 5 <> 0)
 SELECT campaign, ord, sha256 FROM f WHERE rk = 1 AND NOT EXISTS (SELECT 1 FROM u WHERE u.ord % 5 = 0 AND u.campaign = f.campaign AND u.sha256 = f.sha256)""")
def _(t: Tables):
    u = t.documents.select((F.col("doc_id") % 10).alias("campaign"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("sha256"))
    return C.unseen_content(u.where("ord % 5 <> 0"), u.where("ord % 5 = 0"), ["campaign"])


@query("name_triage", "JOI-22", ctes("assets") + """, u AS (SELECT client_id, ord, CASE WHEN ord % 2 = 0 THEN upper(filename) ELSE 'n' || filename END AS filename, 'h' || (ord % 3) AS sha256 FROM assets), k AS (SELECT client_id, lower(filename) AS n, arg_max('h' || (ord % 2), ord) AS sha FROM assets GROUP BY ALL)
 SELECT u.client_id, ord, CASE WHEN sha IS NULL THEN 'new' WHEN sha = sha256 THEN 'keep' ELSE 'conflict' END AS action FROM u LEFT JOIN k ON k.client_id = u.client_id AND k.n = lower(u.filename)""")
def _(t: Tables):
    a = t.bind("assets")
    u = a.select("client_id", "ord", F.when(F.col("ord") % 2 == 0, F.upper("filename")).otherwise(F.concat(F.lit("n"), F.col("filename"))).alias("filename"), F.concat(F.lit("h"), (F.col("ord") % 3).cast("string")).alias("sha256"))
    return C.triage_names(u, a.withColumn("sha256", F.concat(F.lit("h"), (F.col("ord") % 2).cast("string"))), ["client_id"]).select("client_id", "ord", "action")


@query("selected_assets", "JOI-23 AGG-32", ctes("assets") + """, s AS (SELECT 'c' || (p_partkey % 25) AS client_id, CASE WHEN p_partkey % 9 = 0 THEN 'zz' ELSE 'a' || (p_partkey - p_partkey % 2 * 25) END AS asset_id, p_partkey AS pos FROM part), o AS (SELECT client_id, asset_id, min(pos) AS pos FROM s GROUP BY ALL),
 j AS (SELECT o.*, filename FROM o LEFT JOIN assets a USING (client_id, asset_id)) SELECT client_id, asset_id, pos, CASE WHEN filename IS NULL THEN 'missing' WHEN count(*) OVER (PARTITION BY client_id, lower(filename)) > 1 THEN 'same_name' END AS rule FROM j""")
def _(t: Tables):
    k = F.col("p_partkey")
    s = t.part.select(F.concat(F.lit("c"), (k % 25).cast("string")).alias("client_id"), F.when(k % 9 == 0, "zz").otherwise(F.concat(F.lit("a"), (k - k % 2 * 25).cast("string"))).alias("asset_id"), k.alias("pos"))
    return C.selected_assets(s, t.bind("assets"), ["client_id"]).select("client_id", "asset_id", "pos", "rule")


@query("doubled_names", "AGG-32", ctes("assets") + "SELECT client_id, lower(filename) AS filename, count(*) AS times FROM assets GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables):
    return C.doubled_names(t.bind("assets"), ["client_id"])


@query("stale_sources", "AGG-36", ctes("sources") + "SELECT campaign_id, bool_or(kind IN ('pdf', 'layered_design') AND vector_version IS DISTINCT FROM 7) AS outdated FROM sources GROUP BY ALL")
def _(t: Tables):
    return C.stale_sources(t.bind("sources"), ["campaign_id"])


@query("workflow_steps", "AGG-33", """SELECT c_custkey AS campaign_id, w OR s > 0 AS campaign, CASE WHEN w THEN s % 2 = 0 ELSE false END AS layers, CASE WHEN w THEN s > 8 ELSE false END AS products, CASE WHEN NOT (w OR s > 0) THEN 'campaign' WHEN NOT (w AND s % 2 = 0) THEN 'layers' WHEN NOT (w AND s > 8) THEN 'products' ELSE 'generate' END AS next
 FROM (SELECT c_custkey, c_custkey % 3 > 0 AS w, count(o_orderkey) AS s FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)""")
def _(t: Tables):
    s = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("campaign_id")).agg(F.count("o_orderkey").alias("sources"))
    f = F.lit(False)
    d = s.withColumns({"workspace": F.col("campaign_id") % 3 > 0, "legacy_projects": F.lit(0), "brief_ready": F.lit(True), "brief_reviewed": F.col("sources") % 2 == 0, "legacy_confirmed": f, "approved_templates": F.greatest(F.lit(0), F.col("sources") - 8), "products_ready": f})
    return C.step_state(d)


@query("storage_usage", "AGG-31", ctes("touches") + "SELECT session_id, CAST(round_even(sum(bytes) / 1048576, 1) AS DOUBLE) AS mb, count(*) AS files FROM touches GROUP BY ALL")
def _(t: Tables):
    return C.storage_usage(t.bind("touches"), ["session_id"])


@query("job_states", "STR-01 STR-02", ctes("jobs") + """, d AS (SELECT task_id, arg_max(progress, ts) AS progress, max(ts) AS ts FROM jobs WHERE state = 'COMPLETED' GROUP BY ALL), l AS (SELECT task_id, arg_max(state, (ts, event_id)) AS state, arg_max(progress, (ts, event_id)) AS progress, max(ts) AS ts FROM jobs GROUP BY ALL)
 SELECT l.task_id, CASE WHEN d.task_id IS NOT NULL THEN 'COMPLETED' ELSE l.state END AS state, coalesce(d.progress, l.progress) AS progress, coalesce(d.ts, l.ts) AS ts FROM l LEFT JOIN d USING (task_id)""")
def _(t: Tables):
    return C.latest_jobs(t.bind("jobs"))


@query("job_progress", "PRJ-22 STR-01", ctes("jobs") + """SELECT event_id, least(100, greatest(0, 6 + CAST(floor(90 * progress / greatest(1, 80)) AS INT))) AS progress, CASE WHEN state = 'COMPLETED' AND event_id % 3 <> 0 THEN 'FAILED' ELSE state END AS state, state = 'COMPLETED' AND event_id % 3 <> 0 AS lost_result FROM jobs""")
def _(t: Tables):
    j = t.bind("jobs").withColumn("batch_id", F.col("event_id").cast("string"))
    batches = j.where(F.col("event_id") % 3 == 0).select("batch_id")
    return C.job_status(j, batches).select("event_id", C.progress(F.col("progress"), F.lit(80)).alias("progress"), "state", "lost_result")


@query("posts_per_day", "STR-06", ctes("posts") + "SELECT account, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", count(*) AS posts FROM posts GROUP BY ALL")
def _(t: Tables):
    return J.posts_per_window(t.bind("posts"), "account")


@query("bulk_delete", "SET-03", ctes("touches") + """SELECT 'p' || n AS project_id, CAST(min(n) AS BIGINT) AS pos, CASE WHEN bool_or('p' || n IN (SELECT project_id FROM touches)) THEN 'removed' ELSE 'missing' END AS outcome FROM (SELECT o_orderkey % 700 AS n FROM orders) GROUP BY n""")
def _(t: Tables):
    n = F.col("o_orderkey") % 700
    return C.bulk_delete(t.orders.select(F.concat(F.lit("p"), n.cast("string")).alias("project_id"), n.alias("pos")), t.bind("touches"))


@query("session_delete", "SET-04 PRJ-19", ctes("touches") + "SELECT session_id, count(DISTINCT project_id) AS projects, count(*) AS touches FROM touches WHERE session_id = 's3' GROUP BY ALL")
def _(t: Tables):
    return t.bind("touches").where(F.col("session_id") == "s3").groupBy("session_id").agg(F.count_distinct("project_id").alias("projects"), F.count(F.lit(1)).alias("touches"))


@query("keyed_union", "SET-02", ctes("assets") + """SELECT client_id, filename, arg_min(asset_id, (src, ord)) AS asset_id FROM (SELECT client_id, filename, asset_id, ord, CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END AS src FROM assets) GROUP BY ALL""")
def _(t: Tables):
    a = t.bind("assets").select("client_id", "filename", "asset_id", "ord")
    return C.keyed_union(a.where("ord % 2 = 0"), a.where("ord % 2 = 1"), ["client_id", "filename"]).drop("ord")


@query("path_and_id_guards", "PRJ-16 PRJ-17", """SELECT p_partkey, p_partkey % 3 = 0 AS safe, p_partkey % 2 = 0 AS uuid FROM part WHERE p_partkey % 25 = 3""")
def _(t: Tables):
    k = F.col("p_partkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("a/"), F.col("p_name"))).when(k % 3 == 1, "a\\..\\b").otherwise("/etc/x")
    uid = F.when(k % 2 == 0, F.concat(F.substring(F.md5("p_name"), 1, 8), F.lit("-"), F.substring(F.md5("p_name"), 9, 24))).otherwise("no-uuid")
    d = t.part.withColumn("client_id", (k % 5).cast("string")).withColumn("campaign_id", (k % 25).cast("string"))
    return S.tenant(d, "3", "3").select("p_partkey", path.alias("path"), uid.alias("u")).select("p_partkey", C.safe_path().alias("safe"), C.is_uuid(F.col("u")).alias("uuid"))


@query("image_gate", "SRC-09 SRC-10", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'WEBP' ELSE 'SVG' END AS magic, concat_ws(',', CASE WHEN p_partkey % 4 = 3 THEN 'format' END, CASE WHEN p_partkey % 4 = 2 THEN 'signature' END, CASE WHEN p_size < 10 THEN 'too_small' END, CASE WHEN p_size * p_size * 100 > 160000 THEN 'too_large' END) AS reasons FROM part""")
def _(t: Tables):
    k = F.col("p_partkey") % 4
    content = F.when(k == 0, F.unhex(F.lit("89504E470D0A1A0A0000"))).when(k == 1, F.unhex(F.lit("FFD8FFE000"))).when(k == 2, F.unhex(F.lit("524946460000000057454250"))).otherwise(F.encode(F.lit("  <?xml v><svg/>"), "UTF-8"))
    magic = S.image_format(content)
    real = F.when(k == 2, "PNG").otherwise(magic)
    return t.part.select("p_partkey", magic.alias("magic"), F.array_join(S.image_rejects(real, magic, F.col("p_size") * 10, F.col("p_size") * 10, 100, 160000), ",").alias("reasons"))


@query("drop_folder_inventory", "SRC-08 STR-04", ctes("assets") + """SELECT filename AS name, regexp_extract(lower(filename), '\\.([^.]+)$', 1) AS extension, client_id || '/' || asset_id || '/' || filename AS rel, CAST(round_even(size_bytes / 1048576, 1) AS DOUBLE) AS size_mb FROM assets""")
def _(t: Tables):
    a = t.bind("assets")
    good = a.select(F.concat_ws("/", "client_id", "asset_id", "filename").alias("rel"), F.col("size_bytes").alias("length"))
    bad = a.select(F.concat(F.lit("a/.oculto-"), F.col("filename")).alias("rel"), F.col("size_bytes").alias("length"))
    return S.inventory(good.unionByName(bad))


@query("drop_folder_pictures", "SRC-08", ctes("assets") + """SELECT rel, filename AS name, CAST(round_even(size_bytes / 1048576, 1) AS DOUBLE) AS size_mb, CASE WHEN ord % 11 > 0 THEN CASE ord % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'JPEG' ELSE 'PSD' END END AS format,
  CASE WHEN ord % 11 > 0 THEN width::BIGINT END AS width, CASE WHEN ord % 11 > 0 THEN height::BIGINT END AS height, CASE WHEN ord % 11 = 0 THEN rel || ': no se pudo leer (UnidentifiedImageError).' END AS warning FROM (SELECT *, client_id || '/' || asset_id || '/' || filename AS rel FROM assets)""")
def _(t: Tables):
    k, big = F.col("ord") % 3, lambda c, n: F.unhex(F.lpad(F.hex(c), n, "0"))
    head = lambda h: F.unhex(F.lit(h))
    png = F.concat(head("89504E470D0A1A0A0000000D49484452"), big("width", 8), big("height", 8))
    jpeg = F.concat(head("FFD8FFE000104A46494600010100000100010000FFDB0004FFC0FFC0001108"), big("height", 4), big("width", 4), head("03012200"))
    psd = F.concat(head("3842505300010000000000000003"), big("height", 8), big("width", 8))
    whole = F.when(k == 0, png).when(k == 1, jpeg).otherwise(psd)
    files = t.bind("assets").select(F.concat_ws("/", "client_id", "asset_id", "filename").alias("rel"), F.col("size_bytes").alias("length"), F.when(F.col("ord") % 11 == 0, F.substring(whole, 1, 13)).otherwise(whole).alias("content"))
    return S.inspect(files)


@query("brand_typography", "JOI-16", """WITH f AS (SELECT n_regionkey AS c, n_nationkey AS pos, CASE n_nationkey % 4 WHEN 0 THEN 'Sans Regular' WHEN 1 THEN 'Sans Bold Italic' WHEN 2 THEN 'Sans Black' ELSE 'Sans Book' END || n_nationkey AS nm FROM nation)
 SELECT s_suppkey AS brand_id, CASE WHEN s_suppkey % 4 = 0 AND (SELECT count(*) FROM f WHERE c = s_nationkey % 5 AND pos = s_suppkey % 25) > 0 THEN (SELECT min(nm) FROM f WHERE c = s_nationkey % 5 AND pos = s_suppkey % 25)
 ELSE concat_ws(',', (SELECT arg_min(nm, pos) FROM f WHERE c = s_nationkey % 5 AND (nm LIKE '%Regular%' OR nm LIKE '%Book%')), (SELECT arg_min(nm, pos) FROM f WHERE c = s_nationkey % 5 AND nm LIKE '%Black%')) END AS faces FROM supplier""")
def _(t: Tables):
    k = F.col("n_nationkey")
    faces = t.nation.select(F.col("n_regionkey").cast("string").alias("catalogue_id"), k.alias("pos"), k.cast("string").alias("face_id"),
                            F.concat(F.when(k % 4 == 0, "Sans Regular").when(k % 4 == 1, "Sans Bold Italic").when(k % 4 == 2, "Sans Black").otherwise("Sans Book"), k.cast("string")).alias("face_name"))
    s = F.col("s_suppkey")
    brands = t.supplier.select(s.alias("brand_id"), F.lit(None).cast("string").alias("font_client"), (F.col("s_nationkey") % 5).cast("string").alias("slug"), F.when(s % 4 == 0, (s % 25).cast("string")).alias("regular_id"), F.lit(None).cast("string").alias("bold_id"))
    return C.typography(brands, faces).select("brand_id", F.array_join("faces", ",").alias("faces"))


@query("matrix_values_to_layers", "JOI-35", ctes("layers", "orderlines") + """, r AS (SELECT k AS project_id, 'T' || names AS titular, '$' || price AS precio_actual, CASE WHEN k % 2 = 0 THEN 'Pide' END AS cta FROM orderlines)
 SELECT l.project_id, layer_id, CASE category WHEN 'headline' THEN titular WHEN 'price' THEN precio_actual ELSE cta END AS content FROM layers l JOIN r USING (project_id) WHERE category IN ('headline', 'price') OR (category = 'cta' AND cta IS NOT NULL)""")
def _(t: Tables):
    r = t.bind("orderlines").select(F.col("k").alias("project_id"), F.concat(F.lit("T"), F.col("names")).alias("titular"), F.concat(F.lit("$"), F.col("price").cast("string")).alias("precio_actual"), F.when(F.col("k") % 2 == 0, "Pide").alias("cta"))
    return P.values_to_layers(r, t.bind("layers"), ["project_id"]).select("project_id", "layer_id", "content")


@query("answer_bijection", "FN-28", """SELECT l_orderkey AS art, count(DISTINCT l_linenumber) AS expected, count(*) = count(DISTINCT l_linenumber) AND max(l_linenumber) = count(*) AS valid FROM lineitem GROUP BY ALL""")
def _(t: Tables):
    a = t.lineitem.select(F.col("l_orderkey").alias("art"), (F.col("l_linenumber") - 1).alias("idx"), F.lit("logo").alias("category"))
    return P.valid_bijection(a, a.groupBy("art").agg(F.count_distinct("idx").alias("expected")), ["art"], ["logo", "cta"])


@query("export_manifests", "SNK-02", ctes("layers") + """, v AS (SELECT CAST(floor(project_id / 5) AS BIGINT) AS project, project_id AS variant, string_agg(name, ',' ORDER BY ord) FILTER (type = 'text' AND trim(coalesce(content, '')) <> '') AS texts FROM layers GROUP BY ALL)
 SELECT project, count(*) AS variants, string_agg(variant || ':' || coalesce(texts, ''), ';' ORDER BY variant) AS listing FROM v GROUP BY ALL""")
def _(t: Tables):
    l = t.bind("layers").withColumn("variant_id", F.col("project_id")).withColumn("project_id", F.floor(F.col("project_id") / 5)).withColumn("text_verified", F.lit(True)).withColumn("export_as_text", F.lit(False))
    v = l.select("project_id", "variant_id").distinct().select("project_id", "variant_id", F.lit("prod").alias("product_label"), F.lit("feed").alias("format_id"), F.col("variant_id").alias("index"), F.lit("base").alias("layout"), F.lit(90).alias("score"))
    d = O.export_manifest(l.select("project_id").distinct().withColumn("name", F.lit("p")), v, l)
    listing = F.array_join(F.transform("variants", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.array_join(x["editable_text_layers"], ","))), ";")
    return d.select(F.col("project_id").alias("project"), F.size("variants").cast("bigint").alias("variants"), listing.alias("listing"))


@query("variant_scores_plugin", "UDF-01", """SELECT o_orderkey AS variant_id, CAST(o_custkey % 101 AS INT) AS score, CASE WHEN o_custkey % 101 <> 50 THEN CAST(o_custkey % 101 / 100 AS DOUBLE) END AS predicted_performance,
  CASE WHEN o_custkey % 101 = 50 THEN 'ValueError: fifty' END AS prediction_error, 'half' AS model, true AS available FROM orders""")
def _(t: Tables):
    def half(frame):
        if (frame["score"] == 50).any():
            raise ValueError("fifty")
        return frame["score"] / 100

    v = t.orders.select(F.col("o_orderkey").alias("variant_id"), (F.col("o_custkey") % 101).cast("int").alias("score"))
    return score_with(v, half).drop("composition_score")




@query("json_records", "SRC-13 SRC-14 SRC-15", """SELECT event_id, 'c' || (user_id % 3) AS client_id, event_type AS state, value AS amount FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_type IN ('view', 'click')""")
def _(t: Tables):
    k = F.col("event_id")
    doc = F.to_json(F.struct(F.when(k % 11 == 0, "otro").otherwise(F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string"))).alias("doc_client"), F.col("event_type").alias("state"), F.col("value").alias("amount")))
    raw = t.events.select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("client_id"), F.when(k % 7 == 0, F.concat(F.lit("{"), doc)).otherwise(doc).alias("text"))
    d = S.parse_records(raw, "text", "doc_client STRING, state STRING, amount DOUBLE")
    return d.where((F.col("doc_client") == F.col("client_id")) & F.col("state").isin("view", "click")).select("event_id", "client_id", "state", "amount")


@query("payload_normalisation", "PRJ-24", """SELECT c_custkey, 'b' || c_custkey AS client_id, CASE WHEN c_custkey % 4 = 0 THEN 'Cliente sin nombre' ELSE c_name END AS name, CAST(c_custkey % 9 AS BIGINT) AS templates, CASE WHEN c_custkey % 6 >= 2 THEN CASE WHEN c_custkey % 3 = 0 THEN 'ready' ELSE 'incompatible' END END AS status,
 CASE WHEN c_custkey % 6 >= 2 THEN CAST(c_custkey % 6 AS BIGINT) END AS row_number FROM customer""")
def _(t: Tables):
    k = F.col("c_custkey")
    cl = F.to_json(F.struct(F.lit("").alias("client_id"), F.concat(F.lit("b"), k.cast("string")).alias("brand_id"), F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), (k % 9).alias("template_count")))
    plan = F.to_json(F.struct((k % 6 + 0.5).alias("row_number"), F.when(k % 3 == 0, " ready ").otherwise("raro").alias("status"), F.lit("x").alias("product_count")))
    return t.customer.select("c_custkey", PL.client(cl).alias("c"), PL.row_plan(plan).alias("p")).select("c_custkey", "c.client_id", "c.name", "c.templates", "p.status", "p.row_number")


@query("detector_plugin", "UDF-02", """SELECT CAST(page_id AS VARCHAR) AS image_id, CAST(1 AS INT) AS ord, CAST(length(html) % 500 AS INT) AS width, 'region' AS kind FROM pages""")
def _(t: Tables):
    def detector(batch):
        import pandas as pd

        n = batch["html"].str.len() % 500
        return pd.DataFrame({"image_id": batch["page_id"].astype(str), "ord": 1, "x": 0, "y": 0, "width": n, "height": n, "score": 0.5, "label": "region", "kind": "region"})

    return detect_with(t.pages.select("page_id", "html"), detector).select("image_id", "ord", "width", "kind")


@query("redeliveries", "STR-02", ctes("jobs") + """, d AS (SELECT *, max(CASE WHEN state = 'COMPLETED' THEN ts END) OVER (PARTITION BY task_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM (SELECT task_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'PENDING' ELSE state END AS state FROM jobs))
 SELECT task_id, event_id, ts, NOT coalesce(ts <= done + INTERVAL 36 HOUR, FALSE) AS run FROM d WHERE state = 'PENDING'""")
def _(t: Tables):
    j = t.bind("jobs").withColumn("state", F.when(F.col("event_id") % 3 == 0, "PENDING").otherwise(F.col("state")))
    stream = J.replayed(j.select("task_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "state"), "job-events")
    return J.drained(J.deliveries(stream, hours=36), "redeliveries").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stored_records", "SRC-14 SNK-05", """SELECT o_orderkey, 'c' || (o_custkey % 20) AS client_id, CAST(o_orderkey % 5 AS VARCHAR) AS campaign_id, o_orderstatus AS state, CAST(2 AS BIGINT) AS version FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderstatus IN ('F', 'P') AND o_custkey % 20 IN (3, 4)""")
def _(t: Tables):
    k, client = F.col("o_orderkey"), F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string"))
    records = t.orders.select("o_orderkey", client.alias("client_id"), (k % 5).alias("campaign_id"), F.when(k % 11 == 0, "otro").otherwise(client).alias("doc_client"), F.col("o_orderstatus").alias("state"))
    path = f"{shared_folder(t.spark)}/{t.spark.sparkContext.applicationId}/record-store-{uuid.uuid4().hex}"
    ST.replace_records(records.where(k % 2 == 0).withColumn("version", F.lit(1)), path)
    ST.replace_records(records.withColumn("version", F.lit(2)), path)
    kept = ST.read_store(t.spark, path, "o_orderkey BIGINT, state STRING, version BIGINT", ["F", "P"])
    return kept.where(F.col("client_id").isin("c3", "c4")).select("o_orderkey", "client_id", "campaign_id", "state", "version")


@query("library_order", "SRC-15", """SELECT 'brand' AS kind, CAST(c_custkey AS BIGINT) AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(n), c_custkey) AS place FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || (c_custkey % 97) AS n FROM customer)
 UNION ALL SELECT 'campaign', o_orderkey, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderdate DESC, o_orderkey) FROM orders""")
def _(t: Tables):
    segment = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    brands = t.customer.select("c_nationkey", "c_custkey", F.concat(segment, (F.col("c_custkey") % 97).cast("string")).alias("name"))
    campaigns = t.orders.select((F.col("o_custkey") % 20).alias("client_id"), "o_orderkey", F.col("o_orderdate").alias("created_at"))
    a = ST.by_name(brands, ["c_nationkey"], "name", "c_custkey").select(F.lit("brand").alias("kind"), F.col("c_custkey").cast("bigint").alias("id"), "place")
    return a.unionByName(ST.newest_first(campaigns, ["client_id"], "created_at", "o_orderkey").select(F.lit("campaign").alias("kind"), F.col("o_orderkey").cast("bigint").alias("id"), "place"))


# Touches arrive in two parts, the second full of late ones; a last one of no project moves the watermark past all sessions.
@query("streamed_sessions", "STR-03", ORACLE["idle_sessions"])
def _(t: Tables):
    touches = t.bind("touches").select("project_id", "touch_id", F.col("ts").cast("timestamp").alias("ts"))
    late = F.pmod(F.col("touch_id"), F.lit(4)) == 0
    beat = touches.agg(F.max("ts").alias("ts")).select(F.lit("").alias("project_id"), F.lit(0).cast("bigint").alias("touch_id"), (F.col("ts") + F.expr("INTERVAL 70 DAYS")).alias("ts"))
    parts = [touches.where(~late), touches.where(late), beat.select(*touches.columns)]
    closed = J.arriving(parts, "sessions", lambda stream: J.idle_expiry(stream, 8, "60 days"))
    return closed.where("project_id <> ''").select("project_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "touches")


@query("watched_records", "STR-04", """SELECT source, lang, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS drop, count(*) AS records, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM documents GROUP BY ALL""")
def _(t: Tables):
    """Files of two drops into one folder, each read once by the watch."""
    base = f"{shared_folder(t.spark)}/{t.spark.sparkContext.applicationId}/watched-{uuid.uuid4().hex}"
    docs = t.documents.select("doc_id", "source", "lang", "text")
    for n, name in ((0, "a"), (1, "b")):
        docs.where(F.col("doc_id") % 2 == n).write.option("maxRecordsPerFile", 5000).json(f"{base}/in/{name}")
        lines = J.watch_folder(t.spark, f"{base}/in").select(F.regexp_extract("path", "/([ab])/[^/]*$", 1).alias("drop"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
        rows = J.drained(lines.where("line <> ''").select("drop", F.from_json("line", "source string, lang string, text string").alias("r")).select("drop", "r.*"), "watched", base)
    return rows.groupBy("source", "lang", "drop").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).cast("bigint").alias("chars"))
