"""Queries over documents, pages, feeds and recognised lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas
from ..functions import layers as L
from ..functions import text as X
from ..functions import web as W
from ..operators import documents as D
from ..operators import evidence as E
from ..operators import lifecycle as C
from .base import Tables, big, ctes, query

CK = ["campaign_id"]


@query("document_text", "SRC-12", """SELECT doc_id, left(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), 60000) AS text FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", X.clean_document(F.col("text"), K.TEXT_LIMIT).alias("text"))


@query("document_roles", "FN-13", ctes("sources") + """, h AS (SELECT source_id, kind, lower(filename || chr(10) || left(text, 20000)) AS x FROM sources)
 SELECT source_id, array_to_string(CASE WHEN len(r) = 0 THEN ['other'] ELSE list_sort(list_distinct(r)) END, ',') AS roles FROM (SELECT source_id, list_filter([CASE WHEN kind = 'font' THEN 'typography' END, CASE WHEN kind = 'layered_design' THEN 'key_visual' END, CASE WHEN kind IN ('layered_design', 'image', 'presentation') THEN 'visual_reference' END, """ + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(x, '{w}')" for w in ws) + f" THEN '{r}' END" for r, ws in K.DOCUMENT_ROLE_WORDS) + "], lambda y: y IS NOT NULL) AS r FROM h)")
def _(t: Tables):
    none = F.array().cast("array<string>")
    r = L.document_roles(F.col("kind"), F.col("filename"), F.col("text"), F.lit(False), none)
    return t.bind("sources").select("source_id", F.array_join(F.array_sort(r), ",").alias("roles"))


@query("labelled_values", "FN-14", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(regexp_replace(replace(text, chr(10), ' '), '\\s+', ' ', 'g')) WHEN 1 THEN 'dos partes' ELSE '' END AS value FROM documents""")
def _(t: Tables):
    head = F.replace("text", F.lit("\n"), F.lit(" "))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("intro\n  OBJETIVO : "), head)).when(F.col("doc_id") % 3 == 1, "x\nMeta - dos   partes\notra").otherwise("sin etiqueta")
    return t.documents.select("doc_id", X.labelled_value(body, ["objetivo", "meta"]).alias("value"))


@query("campaign_evidence_text", "AGG-17", ctes("sources") + """SELECT campaign_id, left(string_agg(text, chr(10) || chr(10) ORDER BY pos), 120000) AS evidence FROM sources WHERE text <> '' GROUP BY ALL""")
def _(t: Tables):
    return E.evidence_text(t.bind("sources"), CK)


@query("source_excerpts", "WIN-10", ctes("sources") + """, q AS (SELECT *, CAST(least(6000, floor(48000 / count(*) OVER (PARTITION BY campaign_id))) AS INT) AS quota FROM sources), m AS (SELECT *, chr(10) || '[…contenido recortado para análisis…]' || chr(10) AS mk FROM q),
 h AS (SELECT *, CAST(floor((quota - length(mk)) * 0.68) AS INT) AS head FROM m)
 SELECT source_id, quota, CASE WHEN length(text) <= quota THEN text ELSE left(text, head) || mk || right(text, greatest(1, quota - length(mk) - head)) END AS excerpt, length(text) > quota AS truncated FROM h""")
def _(t: Tables):
    return E.excerpts(t.bind("sources"), CK).select("source_id", "quota", "excerpt", "truncated")


@query("campaign_signals", "AGG-19", ctes("sources") + """, s AS (SELECT campaign_id, bool_or(regexp_matches(lower(text), '\\$\\s*\\d|\\b\\d+\\s*%|\\boferta(?:s)?\\b|\\bprecio(?:s)?\\b|\\bdescuento(?:s)?\\b|\\bcuota(?:s)?\\b|\\bpromoci[oó]n(?:es)?\\b')) AS pr,
 bool_or(regexp_matches(lower(text), '\\b(?:combo|pack|bundle|kit)(?:s)?\\b|\\b2\\s*[x×]\\s*1\\b|\\bdos\\s+productos\\b')) AS co, bool_or(regexp_matches(lower(text), '\\bproducto(?:s)?\\b|\\bcat[aá]logo\\b|\\bcomprar\\b|\\bvender\\b|\\bventa(?:s)?\\b|\\bcr[eé]dito\\b')) AS pd,
 bool_or(regexp_matches(lower(text), '\\binstitucional\\b|\\bmarca\\b|\\bbranding\\b|\\bcomunidad\\b|\\breputaci[oó]n\\b|\\bawareness\\b')) AS ins, bool_or(regexp_matches(lower(text), '\\blegal(?:es)?\\b|\\bt[eé]rminos\\b|\\bvigencia\\b|\\brestricciones\\b')) AS le, min(ord) AS m FROM sources GROUP BY ALL)
 SELECT campaign_id, m % 4 = 0 OR pr OR co OR pd AS product, m % 4 = 0 OR pr AS price, co AS combo, ins OR NOT (m % 4 = 0 OR pr OR co OR pd) AS institutional, le AS legal FROM s""")
def _(t: Tables):
    s = t.bind("sources")
    briefs = s.groupBy("campaign_id").agg(F.min("ord").alias("m")).select(
        "campaign_id", F.lit("").alias("brief_text"), F.when(F.col("m") % 4 == 0, F.array(F.lit("precio"))).otherwise(F.array().cast("array<string>")).alias("variable_keys"))
    return E.campaign_signals(s.withColumn("roles", F.array(F.lit("other"))), briefs, CK)


@query("brief_confidence", "AGG-20", ctes("sources") + """SELECT campaign_id, CAST(round_even(least(0.95, 0.25 + least(count(*), 6) * 0.08 + CASE WHEN sum(length(text)) > 0 THEN 0.12 ELSE 0 END + CASE WHEN count_if(kind = 'image') > 0 THEN 0.10 ELSE 0 END), 2) AS DOUBLE) AS confidence FROM sources GROUP BY ALL""")
def _(t: Tables):
    g = t.bind("sources").groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"), F.count_if(F.col("kind") == "image").alias("v"))
    return g.select("campaign_id", E.brief_confidence(F.col("n"), F.col("c") > 0, F.col("v") > 0, F.lit(False)).alias("confidence"))


@query("even_samples", "WIN-08", ctes("sources") + """, r AS (SELECT campaign_id, source_id, row_number() OVER (PARTITION BY campaign_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY campaign_id) AS n FROM sources)
 SELECT campaign_id, source_id FROM r WHERE n <= 8 OR i IN (SELECT round_even(j * (n - 1) / 7, 0) FROM range(0, 8) AS g(j))""")
def _(t: Tables):
    return E.even_sample(t.bind("sources"), CK, F.lit(8)).select("campaign_id", "source_id")


@query("quota_samples", "WIN-09", """WITH d AS (SELECT campaign_id, src, pos FROM (SELECT CAST(floor(doc_id / 200) AS BIGINT) AS campaign_id, doc_id % 5 AS src, doc_id AS pos FROM documents)), q AS (SELECT campaign_id, src, 8 // count(*) OVER (PARTITION BY campaign_id) + CASE WHEN row_number() OVER (PARTITION BY campaign_id ORDER BY src) <= 8 % count(*) OVER (PARTITION BY campaign_id) THEN 1 ELSE 0 END AS k FROM (SELECT DISTINCT campaign_id, src FROM d)),
 r AS (SELECT d.*, k, row_number() OVER (PARTITION BY campaign_id, src ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY campaign_id, src) AS n FROM d JOIN q USING (campaign_id, src))
 SELECT campaign_id, src, pos FROM r WHERE n <= k OR (k = 1 AND i = 0) OR (k > 1 AND i IN (SELECT round_even(j * (n - 1) / (k - 1), 0) FROM range(0, 8) AS g(j) WHERE j < k))""")
def _(t: Tables):
    d = t.documents.select(F.floor(F.col("doc_id") / 200).alias("campaign_id"), (F.col("doc_id") % 5).alias("src"), F.col("doc_id").alias("pos"))
    return E.quota_sample(d, CK, "src", 8).select("campaign_id", "src", "pos")


@query("master_arts", "TOP-09", ctes("sources") + """, r AS (SELECT campaign_id, source_id, ord, CASE WHEN kind = 'image' THEN 2 WHEN kind = 'layered_design' THEN 0 WHEN kind IN ('pdf', 'presentation') AND page_count BETWEEN 1 AND 2 THEN 3 END AS rank, CASE WHEN width / height BETWEEN 0.5 AND 1.6 THEN 0 ELSE 1 END AS shape FROM sources)
 SELECT campaign_id, source_id, CAST(rk AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY rank, shape, ord) AS rk FROM r WHERE rank IS NOT NULL) WHERE rk <= 2""")
def _(t: Tables):
    roles = F.when(F.col("kind") == "image", F.array(F.lit("visual_reference"), F.lit("other"))).when(F.col("kind") == "layered_design", F.array(F.lit("background"), F.lit("key_visual"))).otherwise(F.array(F.lit("other")))
    return D.master_arts(t.bind("sources").withColumn("roles", roles), CK).select("campaign_id", "source_id", "rn")


def _assets(t: Tables):
    k = F.col("ord")
    role = F.when(k % 9 == 0, "logo").when(k % 9 < 4, "fixed_background").when(k % 9 < 6, "fixed_decoration").otherwise("otro")
    return t.bind("sources").where(F.col("kind") == "layered_design").select(
        "campaign_id", "source_id", k.alias("source_ord"), F.explode(F.array(F.lit(0), F.lit(1))).alias("asset_ord"), role.alias("role")).select(
        "*", F.concat("source_id", F.lit("/"), F.col("asset_ord").cast("string")).alias("path"))


@query("campaign_logos", "TOP-10", ctes("sources") + """, c AS (SELECT campaign_id, source_id || '/' || a AS path, 0 AS late, ord, 0 AS stage, a FROM sources CROSS JOIN (VALUES (0), (1)) AS v(a) WHERE kind = 'layered_design' AND ord % 9 = 0
  UNION ALL SELECT campaign_id, 'x/Logo-' || source_id || '.png', 0, ord, 1, 0 FROM sources WHERE ord % 40 = 7 UNION ALL SELECT campaign_id, filename, 1, ord, 2, 0 FROM sources WHERE kind = 'image')
 SELECT campaign_id, arg_min(path, (late, ord, stage, a)) AS path, CAST(arg_min(stage, (late, ord, stage, a)) AS INT) AS stage FROM c GROUP BY ALL""")
def _(t: Tables):
    s = t.bind("sources")
    files = s.select("campaign_id", F.col("ord").alias("source_ord"), F.lit(0).alias("asset_ord"), F.concat(F.lit("x/"), F.when(F.col("ord") % 40 == 7, "Logo-").otherwise("pieza-"), F.col("source_id"), F.lit(".png")).alias("path"))
    return D.logos(s.withColumn("roles", F.array(F.lit("logo"))).withColumn("path", F.col("filename")), _assets(t), files, CK)


@query("fixed_assets", "JOI-41", ctes("sources") + """, a AS (SELECT campaign_id, source_id, ord, a, CASE WHEN ord % 9 = 0 THEN 'logo' WHEN ord % 9 < 4 THEN 'fixed_background' WHEN ord % 9 < 6 THEN 'fixed_decoration' ELSE 'otro' END AS role, width, height FROM sources CROSS JOIN (VALUES (0), (1)) AS v(a) WHERE kind = 'layered_design')
 SELECT campaign_id, asset_id, CAST(rk AS INT) AS rn FROM (SELECT campaign_id, source_id || '/' || a AS asset_id, row_number() OVER (PARTITION BY campaign_id ORDER BY role = 'fixed_decoration', ord, a) AS rk FROM a WHERE role IN ('fixed_background', 'fixed_decoration')) WHERE rk <= 8""")
def _(t: Tables):
    s = t.bind("sources")
    a = _assets(t).select("campaign_id", "source_id", "role", F.col("path").alias("asset_id"), F.col("asset_ord").alias("z_index"), F.lit("n").alias("name"), F.lit(-5).alias("x0"), F.lit(10).alias("y0"), F.lit(300).alias("x1"), F.lit(9000).alias("y1"))
    # Source lists of a proposal are capped at fifty ids by its contract.
    cand = s.groupBy("campaign_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_id"))), lambda x: x["source_id"]).alias("source_ids")).withColumn("candidate_id", F.lit("k"))
    return D.fixed_assets(cand, s, a, CK).select("campaign_id", "asset_id", "rn")


@query("layer_evidence", "AGG-16", big(ctes("layers") + """SELECT project_id, count_if(visible) AS visible_layers, count_if(type = 'text' AND coalesce(content, '') <> '') AS text_layers, count_if(pk % 8 = 2 AND type <> 'text') AS logo_assets, CAST(0 AS BIGINT) AS fixed_backgrounds, count_if(pk % 8 = 5 AND type <> 'text') AS fixed_decorations FROM layers GROUP BY ALL""", "visible_layers", "text_layers", "logo_assets", "fixed_decorations"))
def _(t: Tables):
    l = t.bind("layers").withColumn("kind", F.when(F.col("type") == "text", "type").otherwise("pixel"))
    a = l.select("project_id", L.asset_role(F.col("name"), F.col("kind"), F.lit(False)).alias("role"))
    return D.layer_evidence(l.withColumn("text", F.col("content")), a, ["project_id"])


@query("page_evidence", "FN-15 FN-16", """SELECT page_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), 180) AS title, '' AS description, true AS accessible, CAST(0 AS INT) AS posts FROM pages""")
def _(t: Tables):
    return E.page_evidence(t.pages).select("page_id", "title", "description", "accessible", F.size("posts").alias("posts"))


@query("page_images", "FN-17", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '' ELSE concat_ws(',', 'https://h' || (page_id % 7) || '.example.com/og' || page_id || '.jpg', 'https://cdn.example.com/foto.jpg', 'https://h' || (page_id % 7) || '.example.com/a/rel.png') END AS images FROM pages""")
def _(t: Tables):
    k = F.col("page_id").cast("string")
    wall = F.when(F.col("page_id") % 5 == 0, "Log in to continue").otherwise("Tienda")
    html = F.concat(F.lit("<title>"), wall, F.lit('</title><meta content="/og'), k, F.lit('.jpg" property="og:image"><img class=a src="//cdn.example.com/foto.jpg"><img data-src=\'rel.png\'><img src="/favicon.ico"><img src="rel.png"><img src="data:image/png;base64,x">'))
    url = F.concat(F.lit("https://h"), (F.col("page_id") % 7).cast("string"), F.lit(".example.com/a/b.html?q=1"))
    return E.page_evidence(t.pages.select("page_id", url.alias("url"), html.alias("html"))).select("page_id", F.array_join("posts", ",").alias("images"))


@query("profile_handles", "FN-18 FN-16", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'marca.' || page_id WHEN 1 THEN NULL WHEN 2 THEN 'otra_' || page_id END AS handle, page_id % 5 IN (0, 2, 4) AS profile FROM pages""")
def _(t: Tables):
    k = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://www.instagram.com/Marca."), k, F.lit("/"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("https://instagram.com/p/"), k)).when(
        F.col("page_id") % 5 == 2, F.concat(F.lit("instagram.com/otra_"), k, F.lit("?hl=es"))).when(F.col("page_id") % 5 == 3, F.concat(F.lit("https://www.facebook.com/x/posts/"), k)).otherwise(F.concat(F.lit("https://m.facebook.com/"), k))
    full = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("https://"), url))
    return t.pages.select("page_id", W.profile_handle(url).alias("handle"), W.profile_page(full).alias("profile"))


@query("url_lists", "FN-19 FN-33 SET-01", """SELECT page_id, concat_ws(',', CASE WHEN starts_with(lower(url), 'http') THEN url END, 'https://a.example.com') AS urls, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) || ',7' END AS idx FROM pages""")
def _(t: Tables):
    raw = F.concat("url", F.lit("\n a.example.com , ,https://a.example.com,"), F.col("url"))
    idx = F.when(F.col("page_id") % 2 == 0, F.concat(F.col("page_id").cast("string"), F.lit(", 7,"))).otherwise("3,x")
    return t.pages.select("page_id", F.array_join(C.url_union(X.url_list(raw), F.array(F.col("url"))), ",").alias("urls"), F.array_join(X.index_list(idx), ",").alias("idx"))


def _feed(t: Tables):
    """Events as nested account -> days -> posts answers, one per account and day."""
    e = t.events.select("user_id", F.to_date("ts").alias("d"), "event_id", "event_type", "value")
    post = F.struct(F.col("event_id").cast("string").alias("IdIg"), F.lit("10:00").alias("Date"), F.col("event_type").alias("Text"), F.floor("value").cast("bigint").alias("Likes"), F.lit(1).cast("bigint").alias("Comments"), F.lit(None).cast("string").alias("Link"),
                    F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "ftp://x").otherwise(F.concat(F.lit("https://cdn/"), F.col("event_id").cast("string"))).alias("Url_media"),
                    F.when(F.col("event_id") % 8 == 0, F.concat(F.lit("http://t/"), F.col("event_id").cast("string"))).alias("Thumbnail"), F.when(F.col("event_type") == "view", "Video").otherwise("image").alias("type"))
    days = e.groupBy("user_id", "d").agg(F.collect_list(post).alias("Posts"))
    return days.select(F.struct(F.col("user_id").alias("Id"), F.lit("n").alias("Name"), F.array(F.struct(F.col("d").cast("string").alias("Date"), "Posts")).alias("Dates")).alias("a"))


@query("feed_posts", "SRC-18 SRC-16", """SELECT user_id AS id_page, CASE WHEN event_id % 8 = 0 THEN 'http://t/' || event_id ELSE 'https://cdn/' || event_id END AS media, '' AS link, event_type AS text, CAST(CAST(ts AS DATE) AS VARCHAR) || ' 10:00' AS date, CAST(floor(value) AS BIGINT) AS likes, CAST(1 AS BIGINT) AS comments FROM events
 WHERE event_type <> 'view' AND (event_id % 8 = 0 OR event_id % 4 IN (2, 3))""")
def _(t: Tables):
    wrapped = _feed(t).select(F.to_json(F.struct(F.array("a").alias("account"))).alias("payload"))
    return E.feed_posts(wrapped.select(F.explode(E.unwrap(F.col("payload"), schemas.FEED_ACCOUNT)).alias("a")))


@query("account_catalogue", "SRC-17 SRC-16", """SELECT c_custkey AS id, left(c_name, 240) AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'user_' || c_custkey END AS handle, CASE WHEN c_custkey % 2 = 0 THEN 'https://instagram.com/u' || c_custkey ELSE '' END AS link, CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE c_custkey END AS audience FROM customer WHERE c_custkey % 11 <> 0""")
def _(t: Tables):
    k = F.col("c_custkey")
    entry = F.struct(F.when(k % 11 == 0, "n/a").otherwise(k.cast("string")).alias("id_page"), F.col("c_name").alias("nom_page"), F.when(k % 3 != 0, F.concat(F.lit("User_"), k.cast("string"))).alias("screenName_page"),
                     F.when(k % 2 == 0, F.concat(F.lit("https://instagram.com/u"), k.cast("string"))).alias("lien_page"), F.when(k % 5 == 0, 0).otherwise(k).alias("nbFollowers_page"), F.lit(7).alias("nbFan_page"))
    payload = t.customer.select(F.to_json(F.struct(F.array(entry).alias("export"))).alias("p"))
    return E.catalogue(payload.select(F.explode(E.unwrap(F.col("p"), schemas.CATALOGUE_ENTRY)).alias("e")))


@query("account_match", "JOI-17", """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'user' || (c_custkey % 400) END AS handle FROM customer), k AS (SELECT id, CASE WHEN handle <> '' THEN handle WHEN id % 2 = 0 THEN 'u' || id END AS key FROM a)
 SELECT w.handle, min(k.id) AS id FROM (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 'u' || o_custkey ELSE 'USER' || (o_custkey % 400) || '/' END AS handle FROM orders) w JOIN k ON k.key = trim(lower(w.handle), '/') GROUP BY ALL""")
def _(t: Tables):
    k = F.col("c_custkey")
    acc = t.customer.select(k.alias("id"), k.alias("ord"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("user"), (k % 400).cast("string"))).alias("handle"), F.when(k % 2 == 0, F.concat(F.lit("https://instagram.com/u"), k.cast("string"))).otherwise("").alias("link"))
    c = F.col("o_custkey")
    want = t.orders.select(F.when(c % 2 == 0, F.concat(F.lit("u"), c.cast("string"))).otherwise(F.concat(F.lit("USER"), (c % 400).cast("string"), F.lit("/"))).alias("handle")).distinct()
    return E.account_for(want, acc).select("handle", "id")


@query("recent_posts", "TOP-02 STR-06", ctes("posts") + """, o AS (SELECT *, row_number() OVER (PARTITION BY account, media ORDER BY ts DESC, post_id) AS dup FROM posts WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 15 DAY AND ts <= TIMESTAMP '2024-01-20')
 SELECT account, post_id, CAST(rk AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts DESC, post_id) AS rk FROM o WHERE dup = 1) WHERE rk <= 24""")
def _(t: Tables):
    return E.recent_posts(t.bind("posts"), "account", F.lit("2024-01-20").cast("timestamp_ntz"), 15).select("account", "post_id", "rn")


@query("social_resolution", "JOI-39", """SELECT page_id % 40 AS campaign_id, CAST(floor(page_id / 40) AS BIGINT) AS pos, url, CASE WHEN page_id % 3 = 0 THEN 'reused' ELSE 'pending' END AS state FROM pages WHERE floor(page_id / 40) < 8""")
def _(t: Tables):
    u = t.pages.select((F.col("page_id") % 40).alias("campaign_id"), F.floor(F.col("page_id") / 40).alias("pos"), "url")
    prev = t.pages.where(F.col("page_id") % 3 != 1).select((F.col("page_id") % 40).alias("campaign_id"), "url", (F.col("page_id") % 3 == 0).alias("accessible"))
    return E.resolved_social(u, prev, CK)


@query("line_categories", "FN-10", ctes("reads") + """, b AS (SELECT *, y1 - y0 AS h, max(y1 - y0) OVER (PARTITION BY art_id) AS tall FROM reads), c AS (SELECT *, CASE WHEN text LIKE '%$%' OR text = '20% OFF' THEN 'price' WHEN text = 'Compra ahora' THEN 'cta'
  WHEN h / tall <= 0.45 AND (text LIKE 'Aplican%' OR text LIKE 'Valido%' OR text LIKE 'Términos%' OR (y0 + h / 2) / canvas_h > 0.86) THEN 'legal' WHEN h / tall >= 0.8 THEN 'headline' ELSE 'subheadline' END AS category FROM b)
 SELECT art_id, ord, category, CAST(round_even(least(1.0, confidence * 0.6 + CASE category WHEN 'price' THEN 0.72 WHEN 'cta' THEN 0.7 WHEN 'legal' THEN 0.6 WHEN 'headline' THEN 0.68 ELSE CASE WHEN h / tall >= 0.5 THEN 0.6 ELSE 0.45 END END * 0.4), 3) AS DOUBLE) AS combined,
 greatest(10, CAST(round_even(h * 0.86, 0) AS INT)) AS font_size, concat_ws(',', CASE WHEN confidence < 0.7 THEN 'low_confidence' END, CASE WHEN angle > 6 THEN 'rotated' END) AS warnings FROM c""")
def _(t: Tables):
    r = t.bind("reads").withColumn("y", F.col("y0")).withColumn("height", F.col("y1") - F.col("y0"))
    return E.classify_lines(r, ["art_id"]).select("art_id", "ord", "category", "combined", "font_size", F.array_join("warnings", ",").alias("warnings"))


@query("text_keys", "FN-02 FN-31 FN-28", """SELECT p_partkey, lower(replace(p_name, ' ', '')) AS tight, replace(p_name, ' ', '-') AS path_slug, p_partkey % 2 = 0 AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'cocina' WHEN p_partkey % 3 = 1 THEN 'horno' END AS answer FROM part""")
def _(t: Tables):
    k = F.col("p_partkey")
    accent = F.translate("p_name", "aeiou", "áéíóú")
    brand = F.when(k % 2 == 0, F.upper("p_name")).otherwise("zz-otra-marca")
    answer = F.when(k % 3 == 0, " Cocina ").when(k % 3 == 1, "Es un horno (clave: horno)").otherwise("cocina u horno")
    return t.part.select("p_partkey", X.compact(accent).alias("tight"), X.url_slug(F.concat(F.lit("  "), accent, F.lit(" "))).alias("path_slug"), X.is_brand_text(accent, brand).alias("brand"), X.closed_answer(answer, ["cocina", "horno"]).alias("answer"))
