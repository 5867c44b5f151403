"""Retention, rule logs, memory roll-ups, duplicate guards, job states, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import casefold, rlike
from .skew import best_per_group, bucketed_rank, top_per_group


def expired_projects(touches: DataFrame, now: Column, hours: int, keep: int) -> DataFrame:
    """Projects to delete: idle for longer than ``hours``, then beyond the newest ``keep``.

    Either limit is off at zero. The ranking over all survivors is done day by
    day, never in one task.
    """
    last = touches.groupBy("project_id").agg(F.max("ts").alias("last"))
    idle = F.col("last") < now - F.expr(f"interval {max(0, hours)} hours")
    old = last.where(idle).withColumn("reason", F.lit("age")) if hours > 0 else last.limit(0).withColumn("reason", F.lit("age"))
    if keep <= 0:
        return old
    alive = (last.where(~idle) if hours > 0 else last).withColumn("_all", F.lit(1))
    age_bucket = F.floor(F.unix_seconds(now.cast("timestamp")) / 3600) - F.floor(F.unix_seconds(F.col("last").cast("timestamp")) / 3600)
    ranked = bucketed_rank(alive, ["_all"], age_bucket, [F.col("last").desc(), F.col("project_id")], "rn")
    over = ranked.where(F.col("rn") > keep).select("project_id", "last", F.lit("count").alias("reason"))
    return old.unionByName(over)


def learned_rules(log: DataFrame, client: str, k: int = 80) -> DataFrame:
    """Rules of a client in the order they were learned (``client, rule, ord``); the last ``k`` stay.

    A rule that the log holds is not learned again; one that was pushed out is.
    So each client's log is replayed in order: rows come sorted within their
    partition and only ``k`` rules of one client are held at a time.
    """
    def replay(batches):
        import pandas as pd

        name, kept = None, {}

        def out():
            return pd.DataFrame({client: [name] * len(kept), "rule": list(kept), "ord": list(kept.values())})

        for batch in batches:
            for c, rule, at in zip(batch[client], batch["rule"], batch["ord"]):
                if c != name:
                    if kept:
                        yield out()
                    name, kept = c, {}
                if rule not in kept:
                    kept[rule] = at
                    if len(kept) > k:
                        del kept[next(iter(kept))]
        if kept:
            yield out()

    rows = log.select(client, "rule", "ord").repartition(client).sortWithinPartitions(client, "ord")
    return rows.mapInPandas(replay, rows.schema)


def client_profiles(clients: DataFrame, campaigns: DataFrame, templates: DataFrame, memory: DataFrame, rules: DataFrame, client: str) -> DataFrame:
    """Counts per client from pre-aggregated tables, and the latest change."""
    def n(df, name):
        return df.groupBy(client).agg(F.count(F.lit(1)).alias(name))

    mem = memory.groupBy(client).agg(F.count(F.lit(1)).alias("approved_candidates"), F.max("approved_at").alias("_m"))
    j = clients.join(n(campaigns, "campaigns"), client, "left").join(n(templates, "_t"), client, "left").join(mem, client, "left").join(
        n(rules, "learned_rules"), client, "left").na.fill(0, ["campaigns", "_t", "approved_candidates", "learned_rules"])
    return j.select(client, "name", "campaigns", (F.col("_t") + F.col("approved_candidates")).alias("templates"), "approved_candidates",
                    "learned_rules", F.greatest("updated_at", "_m").alias("updated_at"))


def delete_impact(campaigns: DataFrame, keys: list[str], **kinds: DataFrame) -> DataFrame:
    """How many rows of each kind go with a campaign; active jobs block it."""
    out = campaigns.select(*keys)
    for name, df in kinds.items():
        out = out.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    out = out.na.fill(0, list(kinds))
    return out.withColumn("allowed", F.col("active_jobs") == 0) if "active_jobs" in kinds else out


def unseen_content(uploads: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """First upload of every digest that the campaign does not hold yet."""
    fresh = uploads.join(existing.select(*keys, "sha256").distinct(), [*keys, "sha256"], "left_anti")
    return best_per_group(fresh, [*keys, "sha256"], [F.col("ord")], fresh.columns).select(*uploads.columns)


def triage_names(uploads: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """Same name and content -> keep; same name, other content -> conflict; else new."""
    known = assets.groupBy(*keys, casefold(F.col("filename")).alias("_n")).agg(F.max_by("sha256", "ord").alias("_sha"))
    j = uploads.withColumn("_n", casefold(F.col("filename"))).join(known, [*keys, "_n"], "left")
    return j.select(*uploads.columns, F.when(F.col("_sha").isNull(), "new").when(F.col("_sha") == F.col("sha256"), "keep").otherwise("conflict").alias("action"))


def selected_assets(selection: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen ids in order, resolved; missing ids and clashing names are marked."""
    once = selection.where(F.trim("asset_id") != "").groupBy(*keys, F.trim("asset_id").alias("asset_id")).agg(F.min("pos").alias("pos"))
    j = once.join(assets.select(*keys, "asset_id", "filename"), [*keys, "asset_id"], "left")
    names = j.where(F.col("filename").isNotNull()).groupBy(*keys, casefold(F.col("filename")).alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    j = j.withColumn("_n", casefold(F.col("filename"))).join(names, [*keys, "_n"], "left")
    return j.select(*keys, "pos", "asset_id", "filename",
                    F.when(F.col("filename").isNull(), "missing").when(F.col("_c") > 1, "same_name").alias("rule"))


def doubled_names(uploads: DataFrame, keys: list[str]) -> DataFrame:
    name = casefold(F.substring("filename", 1, 240))
    return uploads.groupBy(*keys, name.alias("filename")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)


def stale_sources(sources: DataFrame, keys: list[str], version: int = K.VECTOR_VERSION) -> DataFrame:
    """Campaigns with an .ai or .pdf read by another version of the reader."""
    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    return sources.groupBy(*keys).agg(F.bool_or(ext.isin("ai", "pdf") & ~F.col("vector_version").eqNullSafe(F.lit(version))).alias("outdated"))


def step_state(campaigns: DataFrame) -> DataFrame:
    """Workflow flags: material, reviewed brief, templates, next step."""
    has = F.col("workspace") | (F.col("sources") > 0) | (F.col("legacy_projects") > 0)
    reviewed = F.when(F.col("workspace"), F.col("brief_ready") & F.col("brief_reviewed")).otherwise((F.col("legacy_projects") > 0) & F.col("legacy_confirmed"))
    ready = F.when(F.col("workspace"), F.col("approved_templates") > 0).otherwise(F.col("products_ready"))
    return campaigns.select(
        "campaign_id", has.alias("campaign"), reviewed.alias("layers"), ready.alias("products"),
        F.when(~has, "campaign").when(~reviewed, "layers").when(~ready, "products").otherwise("generate").alias("next"))


def storage_usage(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys).agg(F.bround(F.sum("bytes") / (1024 * 1024), 1).alias("mb"), F.count(F.lit(1)).alias("files"))


def progress(done: Column, total: Column) -> Column:
    """6 to 96 over the run of a batch, cut to 0..100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.lit(6) + (F.lit(90) * done / F.greatest(F.lit(1), total)).cast("int")))


def latest_jobs(changes: DataFrame) -> DataFrame:
    """Latest state per task; a finished task stays finished when redelivered."""
    done = F.max_by(F.struct("state", "progress", "ts"), F.when(F.col("state") == "COMPLETED", F.struct("ts", "event_id")))
    last = F.max_by(F.struct("state", "progress", "ts"), F.struct("ts", "event_id"))
    return changes.groupBy("task_id").agg(F.coalesce(done, last).alias("s")).select("task_id", "s.state", "s.progress", "s.ts")


def job_status(jobs: DataFrame, batches: DataFrame) -> DataFrame:
    """A completed job without its batch is reported as failed."""
    j = jobs.join(batches.select("batch_id").distinct().withColumn("_b", F.lit(True)), "batch_id", "left")
    lost = (F.col("state") == "COMPLETED") & F.coalesce("batch_id", F.lit("")).isNotNull() & (F.col("batch_id") != "") & F.col("_b").isNull()
    state = F.when(lost, "FAILED").otherwise(F.col("state"))
    return j.select(*[c for c in jobs.columns if c != "state"], state.alias("state"), lost.alias("lost_result"))


def idle_sessions(touches: DataFrame, key: str, hours: int = 8) -> DataFrame:
    """Stretches of touches with no pause of ``hours`` or more, closed ``hours`` after the last.

    The previous touch is carried over day borders, so one busy project spreads
    over many tasks.
    """
    from .skew import bucketed_before

    day, order = F.to_date("ts"), [F.col("ts"), F.col("touch_id")]
    d = bucketed_before(touches, [key], day, order, {"_p": ("last", F.col("ts"))})
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_p").cast("timestamp"))
    d = d.withColumn("_cut", F.when(F.col("_p").isNull() | (pause >= hours * 3_600_000_000), 1).otherwise(0))
    d = bucketed_before(d.select(*touches.columns, "_cut"), [key], day, order, {"_c": ("sum", F.col("_cut"))})
    session = F.coalesce("_c", F.lit(0)) + F.col("_cut")
    return d.groupBy(key, session.alias("session")).agg(
        F.min("ts").alias("start"), (F.max("ts") + F.expr(f"interval {hours} hours")).alias("end"), F.count(F.lit(1)).alias("touches"))


def safe_path() -> Column:
    """Is ``path`` relative and inside its folder?"""
    raw = F.trim(F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/")))
    return (raw != "") & ~F.startswith(raw, F.lit("/")) & ~rlike(raw, r"(^|/)\.\.(/|$)")


def is_uuid(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "^urn:uuid:", ""), "[{}-]", "")
    return rlike(bare, "^[0-9a-f]{32}$")


def bulk_delete(requested: DataFrame, existing: DataFrame, key: str = "project_id") -> DataFrame:
    """Distinct requested ids as removed (present) or missing."""
    ids = requested.groupBy(key).agg(F.min("pos").alias("pos"))
    j = ids.join(existing.select(key).distinct().withColumn("_e", F.lit(True)), key, "left")
    return j.select(key, "pos", F.when(F.col("_e"), "removed").otherwise("missing").alias("outcome"))


def keyed_union(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; rows already present win, then the earlier one."""
    both = current.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    return best_per_group(both, keys, [F.col("_src"), F.col("ord")], current.columns).select(*current.columns)


def url_union(a: Column, b: Column) -> Column:
    """Ordered distinct union of two link lists, trimmed, cut at 500."""
    both = F.transform(F.concat(a, b), lambda u: F.substring(F.trim(u), 1, 500))
    return F.array_distinct(F.filter(both, lambda u: u != ""))


def distinct_warnings(c: Column, k: int = 10) -> Column:
    return F.slice(F.array_distinct(c), 1, k)


def first_few(c: Column, k: int) -> tuple[Column, Column]:
    """First ``k`` of a list and how many more there are."""
    return F.slice(c, 1, k), F.greatest(F.lit(0), F.size(c) - k)


def typography(brands: DataFrame, faces: DataFrame) -> DataFrame:
    """Chosen faces of a brand, else its first regular-like and first bold-like upright face."""
    low = F.lower("face_name")

    def like(*words):
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(low, F.lit(w))
        return cond & ~F.contains(low, F.lit("italic"))

    regular, bold = like("regular", "medium", "book"), like("bold", "black", "semibold")
    j = brands.join(faces, F.coalesce("font_client", "slug") == F.col("catalogue_id"), "left")
    chosen = F.coalesce(F.col("face_id").isin(F.col("regular_id"), F.col("bold_id")), F.lit(False))
    g = j.groupBy("brand_id").agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(chosen, F.struct("pos", "face_name")))), 1, 2), lambda s: s["face_name"]).alias("chosen"),
        F.min_by(F.when(regular, F.col("face_name")), F.when(regular, F.col("pos"))).alias("r"),
        F.min_by(F.when(bold, F.col("face_name")), F.when(bold, F.col("pos"))).alias("b"))
    return g.select("brand_id", F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.array_distinct(F.array_compact(F.array("r", "b")))).alias("faces"))
