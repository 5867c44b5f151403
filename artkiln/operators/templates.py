"""Rows to templates: fit, choice, plans, decisions, memory, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import casefold, slug, strip_ws
from .matrix import product_count, requested_fields
from .skew import best_per_group, many


def slot_features(templates: DataFrame) -> DataFrame:
    """What the fit rules need to know of a template, as a few small columns."""
    ids = F.transform("slots", lambda s: slug(s["key"]))
    product = F.size(F.filter("slots", lambda s: F.startswith(slug(s["key"]), F.lit("producto")) | (slug(s["category"]) == "product")))
    repeat = F.exists("slots", lambda s: F.coalesce(s["repeatable"], F.lit(False)))
    top = F.coalesce(F.nullif(F.col("range_max"), F.lit(0)), product)
    needed = F.filter("slots", lambda s: F.coalesce(s["required"], F.lit(False)) & ~F.startswith(slug(s["key"]), F.lit("producto")))
    return templates.select(
        "*", F.array_distinct(ids).alias("slot_ids"),
        F.when(repeat, F.greatest(product, top)).otherwise(product).alias("capacity"),
        F.coalesce("range_min", F.lit(1)).alias("fit_min"), top.alias("fit_max"),
        F.transform(needed, lambda s: F.when(slug(s["key"]) == "precio", "precio_actual").otherwise(slug(s["key"]))).alias("needed"),
        slug(F.col("category")).alias("kind"),
    )


def row_signature(rows: DataFrame) -> DataFrame:
    """All of a row that the fit rules look at."""
    def present(f):
        return F.col(f).isNotNull()

    filled = ["producto", "imagen", *K.CONTENT_FIELDS, "plantilla", "notas"]
    return rows.select(
        "*", product_count(F.col("producto"), F.col("imagen")).alias("products"),
        F.array_compact(F.array(*[F.when(present(f), F.lit(f)) for f in K.CONTENT_FIELDS])).alias("present"),
        F.array_sort(F.array_intersect(F.col("suppressed_fields"), F.array(*[F.lit(f) for f in K.CONTENT_FIELDS]))).alias("hidden"),
        F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", F.lit(f)) for f in filled])).alias("filled"),
        casefold(F.coalesce("plantilla", F.lit(""))).alias("forced"),
    )


SIGNATURE = ["products", "present", "hidden", "filled", "forced"]
# Columns every row carries besides its text fields: a slot named like one is never empty.
_ALWAYS = ("row_number", "cantidad_propuestas", "modo", "formatos", "suppressed_fields", "ai_fields")


def _holds(slot_ids: Column, field: str) -> Column:
    hit = F.array_contains(slot_ids, field)
    return hit | F.array_contains(slot_ids, "precio") if field == "precio_actual" else hit


def score() -> Column:
    """Fit of a signature and a template; null when they do not fit."""
    present, hidden, ids = F.col("present"), F.col("hidden"), F.col("slot_ids")
    n = F.col("products")
    open_ = (
        (F.col("forced") == "") | (F.col("forced") == casefold(F.col("name"))) | (F.col("forced") == casefold(F.col("candidate_id")))
    ) & (n >= F.col("fit_min")) & (n <= F.col("fit_max")) & (F.col("capacity") >= n)
    for f in K.CONTENT_FIELDS:
        open_ = open_ & (~F.array_contains(present, f) | _holds(ids, f))
    commercial = F.arrays_overlap(present, F.array(*[F.lit(f) for f in K.COMMERCIAL_FIELDS]))
    points = F.when((n > 0) & (F.col("capacity") == n), 20.0).otherwise(0.0)
    points = points + (
        F.when((n >= 2) & (F.col("kind") == "combo"), 8.0)
        .when((n == 1) & commercial & (F.col("kind") == "price_promotion"), 6.0)
        .when((n == 0) & (F.col("kind") == "institutional"), 6.0).otherwise(0.0)
    )
    points = points + F.size(present) * 3.0
    for f in K.CONTENT_FIELDS:
        quiet = F.array_contains(hidden, f) & ~F.array_contains(present, f) & _holds(ids, f)
        points = points - F.when(quiet, 0.25).otherwise(0.0)
    always = F.array(*[F.lit(f) for f in _ALWAYS])
    lacking = F.size(F.filter("needed", lambda s: ~F.array_contains(F.col("filled"), s) & ~F.array_contains(always, s)))
    return F.when(open_, points - lacking * 25.0)


def select_templates(rows: DataFrame, templates: DataFrame, scope: list[str]) -> DataFrame:
    """Best template per row, earliest on a tie; rows without one keep nulls.

    Rows of a scope share few distinct signatures. Only those meet the
    templates, so the pairing never grows with the number of rows.
    """
    # One struct key: it is never null, so the joins add no conditions on its parts.
    signed = row_signature(rows).select(*rows.columns, F.struct(*SIGNATURE).alias("_sig"))
    feats = slot_features(templates.where(F.col("approved"))).select(
        *scope, "candidate_id", "name", "ord", "slot_ids", "capacity", "fit_min", "fit_max", "needed", "kind")
    distinct = signed.select(*scope, "_sig").distinct().select(*scope, "_sig", *[F.col(f"_sig.{c}").alias(c) for c in SIGNATURE])
    pairs = distinct.join(feats, scope).withColumn("score", score())
    fits = F.col("score").isNotNull()
    picked = F.min_by(F.when(fits, F.struct("candidate_id", "name", "score")), F.when(fits, F.struct(-F.col("score"), F.col("ord"))))
    best = pairs.groupBy(*scope, "_sig").agg(picked.alias("_p"))
    return many(signed).join(best, [*scope, "_sig"], "left").select(
        *rows.columns, F.col("_sig.products").alias("products"), F.col("_p.candidate_id").alias("candidate_id"),
        F.col("_p.name").alias("template_name"), F.col("_p.score").alias("score"))


def scores(rows: DataFrame, templates: DataFrame, scope: list[str]) -> DataFrame:
    """Scores of each distinct row signature and fitting template of its scope."""
    feats = slot_features(templates.where(F.col("approved")))
    cols = [*scope, "candidate_id", "name", "ord", "slot_ids", "capacity", "fit_min", "fit_max", "needed", "kind"]
    return row_signature(rows).groupBy(*scope, *SIGNATURE).agg(F.count(F.lit(1)).alias("rows")).join(
        feats.select(*cols), scope).withColumn("score", score()).where(F.col("score").isNotNull())


def fillable_fields(slots: Column) -> Column:
    """Copy fields the slots allow to be generated, sorted."""
    pairs = F.create_map(*[F.lit(v) for kv in K.COPY_SLOT_ALIASES.items() for v in kv])
    open_ = F.transform(F.filter(slots, lambda s: F.coalesce(s["generate_if_missing"], F.lit(False))), lambda s: slug(s["key"]))
    named = F.transform(open_, lambda k: F.coalesce(F.try_element_at(pairs, k), k))
    return F.array_sort(F.array_distinct(F.filter(named, lambda k: k.isin(*K.COPY_FIELDS))))


def scope_slots(templates: DataFrame, scope: list[str]) -> DataFrame:
    """All slot ids the approved templates of a scope offer."""
    return (
        templates.where(F.col("approved")).select(*scope, F.explode("slots").alias("s"))
        .select(*scope, slug(F.col("s.key")).alias("slot")).where(F.col("slot") != "").distinct()
    )


def fields_without_slot(rows: DataFrame, templates: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Filled fields no approved template of the scope can hold."""
    fields = rows.select(*keys, F.explode(requested_fields()).alias("field")).where(F.col("field") != "producto")
    return fields.join(scope_slots(templates, scope).withColumnRenamed("slot", "field"), [*scope, "field"], "left_anti")


def plan_rows(rows: DataFrame, templates: DataFrame, keys: list[str], scope: list[str]) -> DataFrame:
    """Status of each row: ready, needs_approval or incompatible, and why."""
    chosen = select_templates(rows, templates, scope)
    free = rows.where(F.coalesce("plantilla", F.lit("")) != "").withColumn("plantilla", F.lit("").cast("string"))
    suggested = select_templates(free, templates, scope).where(F.col("candidate_id").isNotNull()).select(
        *keys, F.col("candidate_id").alias("_sug"))
    homeless = fields_without_slot(rows, templates, keys, scope).groupBy(*keys).agg(
        F.array_sort(F.collect_list("field")).alias("blocking"))
    any_ok = templates.where(F.col("approved")).select(*scope).distinct().withColumn("_any", F.lit(True))
    fill = templates.select(*scope, "candidate_id", fillable_fields(F.col("slots")).alias("fillable"))
    j = (
        chosen.withColumn("required", requested_fields()).join(suggested, keys, "left").join(homeless, keys, "left")
        .join(any_ok, scope, "left").join(fill, [*scope, "candidate_id"], "left")
    )
    ready, forced = F.col("candidate_id").isNotNull(), F.coalesce("plantilla", F.lit("")) != ""
    empty = F.array().cast("array<string>")
    return j.select(
        *keys, "products", F.col("candidate_id").alias("template"),
        F.when(ready, "ready").when(F.col("_any").isNull(), "needs_approval").otherwise("incompatible").alias("status"),
        F.when(ready, "uses_template").when(F.col("_any").isNull(), "nothing_approved")
        .when(forced & F.col("_sug").isNotNull(), "forced_but_other_fits").when(F.col("blocking").isNotNull(), "fields_without_slot")
        .when(forced, "forced_and_none_fits").otherwise("no_combination").alias("reason"),
        F.when(~ready, F.col("_sug")).alias("suggested"), "required",
        F.when(ready, F.coalesce("fillable", empty)).otherwise(empty).alias("fillable"),
        F.when(~ready, F.coalesce("blocking", empty)).otherwise(empty).alias("blocking"),
        *[c for c in ("fila_origen", "row_number") if c in rows.columns and c not in keys],
    )


def plans_by_origin(plans: DataFrame, scope: list[str], row: str = "row_number", origin: str = "fila_origen") -> DataFrame:
    """One plan per written row: its first failing part, else its first part."""
    src = F.coalesce(origin, row)
    return plans.groupBy(*scope, src.alias("source_row")).agg(
        F.min_by(F.struct("status", "template", "reason"), F.struct((F.col("status") == "ready").alias("a"), F.col(row).alias("b"))).alias("p"),
        F.count(F.lit(1)).alias("arts"),
    ).select(*scope, "source_row", "p.status", "p.template", "p.reason", "arts")


# Matrix column -> drawn value, and the slot that must exist.
_VALUE_OF = (
    ("product_name", "producto", "nombre_producto"), ("headline", "titular", "titular"),
    ("subheadline", "subtitulo", "subtitulo"), ("price", "precio_actual", "precio"),
    ("previous_price", "precio_anterior", "precio_anterior"), ("installment", "cuota", "cuota"),
    ("discount", "descuento", "descuento"), ("cta", "cta", None), ("legal", "legal", None), ("validity", "vigencia", "vigencia"),
)


def drawn_values(df: DataFrame) -> DataFrame:
    """Texts drawn for a row on its template (``slots``) with its brief.

    Needs brief columns ``primary_message, objective, creative_concept,
    legal_requirements``. Prices are never filled in. A drawn text whose name a
    matrix column already has (``cta``, ``legal``) comes as ``drawn_<name>``.
    """
    slot_keys = F.transform("slots", lambda s: s["key"])
    fill = fillable_fields(F.col("slots"))
    hidden = F.col("suppressed_fields")
    # The product name is hidden only by its drawn name, which a matrix never writes.
    blocked = {k: F.lit(False) if k == "product_name" else F.array_contains(hidden, col) for k, col, _ in _VALUE_OF}
    written = {k: F.when(blocked[k], "").otherwise(F.coalesce(F.col(col), F.lit(""))) for k, col, _ in _VALUE_OF}
    kept = F.filter(
        F.transform("legal_requirements", strip_ws), lambda s: (s != "") & ~F.startswith(casefold(s), F.lit("conservar los legales")))
    brief_head = F.coalesce(F.nullif(F.col("primary_message"), F.lit("")), F.col("objective"))
    defaults = {
        "headline": F.when(F.array_contains(fill, "titular"), brief_head),
        "subheadline": F.when(F.array_contains(fill, "subtitulo"), F.col("creative_concept")),
        "legal": F.substring(F.array_join(kept, " · "), 1, 700),
    }
    out = []
    for k, _, slot in _VALUE_OF:
        value = written[k]
        if k in defaults:
            value = F.when((value == "") & ~blocked[k], F.coalesce(defaults[k], F.lit(""))).otherwise(value)
        if slot:
            value = F.when(F.array_contains(slot_keys, slot), value).otherwise("")
        out.append(value.alias(f"drawn_{k}" if k in df.columns else k))
    return df.select("*", *out)


def pending_copy(rows: DataFrame, allowed: str = "fillable") -> DataFrame:
    """Rows with a copy field that is empty, allowed and not suppressed."""
    cond = F.lit(False)
    for f in K.COPY_FIELDS:
        cond = cond | (F.col(f).isNull() & ~F.array_contains("suppressed_fields", f) & F.array_contains(allowed, f))
    return rows.where(cond)


def fill_copy(rows: DataFrame, updates: DataFrame, keys: list[str], allowed: str = "fillable") -> DataFrame:
    """Write supplied copy (``new_titular`` ...) into open fields and note its origin."""
    j = rows.join(updates.select(*keys, *[f"new_{f}" for f in K.COPY_FIELDS]), keys, "left")
    out, added = {}, []
    for f in K.COPY_FIELDS:
        open_ = F.col(f).isNull() & ~F.array_contains("suppressed_fields", f) & F.array_contains(allowed, f)
        text = F.nullif(F.substring(F.coalesce(F.col(f"new_{f}"), F.lit("")), 1, K.COPY_LENGTHS[f]), F.lit(""))
        out[f] = F.when(open_, text).otherwise(F.col(f))
        added.append(F.when(open_ & text.isNotNull(), F.lit(f)))
    out["ai_fields"] = F.concat("ai_fields", F.array_compact(F.array(*added)))
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in rows.columns])


def overrides(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Human corrections win where they are not null."""
    renamed = changes.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    j = df.join(renamed, keys, "left")
    return j.select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


DECISION = ["candidate_id", "status", "approved", "approved_at", "decision_notes"]


def keep_decisions(fresh: DataFrame, old: DataFrame, scope: list[str]) -> DataFrame:
    """A decided proposal with the same category and content keeps its decision."""
    # The last old proposal of a category is the one that counts.
    last = old.groupBy(*scope, "category").agg(F.max_by(F.struct("revision_hash", *DECISION), "ord").alias("o")).select(
        *scope, "category", F.col("o.revision_hash").alias("_hash"), *[F.col(f"o.{c}").alias(f"_{c}") for c in DECISION])
    j = fresh.join(last, [*scope, "category"], "left")
    same = (F.col("_status") != "proposed") & (F.coalesce("_hash", F.lit("")) != "") & (F.col("_hash") == F.col("revision_hash"))
    return j.select(*[
        F.when(same, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in DECISION else F.col(c) for c in fresh.columns])


def with_memory(proposals: DataFrame, memory: DataFrame, client: list[str]) -> DataFrame:
    """Lay the client's latest approved system of a category over a proposal."""
    latest = memory.groupBy(*client, "category").agg(
        F.max_by(F.struct("layout_intent", "rationale", "range_min", "range_max", "candidate_id"), "approved_at").alias("m"))
    j = proposals.join(latest, [*client, "category"], "left")
    known = F.col("m").isNotNull()
    prefix = F.lit("Sistema aprendido de una plantilla aprobada del cliente. ")

    def full(c):
        return F.nullif(F.col(c), F.lit(""))

    new = {
        "layout_intent": F.coalesce(full("m.layout_intent"), F.col("layout_intent")),
        "range_min": F.col("m.range_min"), "range_max": F.col("m.range_max"),
        "rationale": F.substring(F.concat(prefix, F.coalesce(full("rationale"), F.col("m.rationale"))), 1, 500),
        "status": F.lit("proposed"), "approved": F.lit(False),
    }
    cols = [F.when(known, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in proposals.columns]
    return j.select(*cols, F.col("m.candidate_id").alias("learned_from"))


def overlay_placements(candidates: DataFrame, sources: DataFrame, scope: list[str]) -> DataFrame:
    """Measured boxes over proposed ones.

    ``sources``: ``scope, ord, origin, aspect, boxes``; the first source of the
    best origin gives the boxes of an aspect. Where the campaign's best origin
    is a vector file the measured boxes replace the proposal's own, otherwise
    they only fill gaps. ``candidates``: ``scope, candidate_id, aspect, boxes``.
    """
    rank = F.when(F.col("origin") == "vector", 0).when(F.col("origin") == "psd", 1).when(F.col("origin") == "ocr", 2).otherwise(3)
    ranked = sources.withColumn("_r", rank)
    top = ranked.groupBy(*scope).agg((F.min("_r") == 0).alias("_vector"))
    measured = best_per_group(ranked, [*scope, "aspect"], [F.col("_r"), F.col("ord")], [*scope, "aspect", "boxes"])
    measured = measured.withColumnRenamed("boxes", "_measured").join(top, scope)
    ids = candidates.select(*scope, "candidate_id").distinct()
    grid = ids.join(measured, scope)
    j = candidates.join(grid, [*scope, "candidate_id", "aspect"], "full_outer")
    chosen = F.when(F.coalesce("_vector", F.lit(False)), F.coalesce("_measured", "boxes")).otherwise(F.coalesce("boxes", "_measured"))
    return j.select(*scope, "candidate_id", "aspect", chosen.alias("boxes"),
                    F.when(chosen.eqNullSafe(F.col("boxes")), "own").otherwise("measured").alias("taken_from"))


def overlay_styles(candidates: DataFrame, sources: DataFrame, scope: list[str]) -> DataFrame:
    """Text colours and case that the measured sources of a scope give its candidates.

    ``sources``: ``scope, ord, origin, measured`` (it has boxes), ``text_colors``
    and ``text_case`` (maps by slot). ``candidates``: ``scope, candidate_id,
    text_colors``. Each slot takes the colour of the first source, best origin
    first, that names one. A vector file as the first source marks all
    candidates as measured, gives them its case and replaces their colours;
    otherwise colours only reach candidates without any. A scope where nothing
    is measured changes nothing.
    """
    rank = F.when(F.col("origin") == "vector", 0).when(F.col("origin") == "psd", 1).when(F.col("origin") == "ocr", 2).otherwise(3)
    ranked = sources.withColumn("_r", rank)
    first = ranked.groupBy(*scope).agg(
        F.max("measured").alias("_any"), (F.min("_r") == 0).alias("_vector"), F.min_by(F.struct("text_case"), F.struct("_r", "ord")).alias("_first"))
    named = ranked.select(*scope, "_r", "ord", F.explode("text_colors").alias("slot", "color"))
    colours = best_per_group(named, [*scope, "slot"], [F.col("_r"), F.col("ord")], [*scope, "slot", "color"])
    colours = colours.groupBy(*scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "color")))).alias("_colors"))
    j = candidates.join(first.where("_any"), scope, "left").join(colours, scope, "left")
    vector = F.coalesce("_vector", F.lit(False))
    bare = F.coalesce(F.size("text_colors"), F.lit(0)) <= 0
    none = F.create_map().cast("map<string,string>")
    return j.select(
        *scope, "candidate_id",
        F.when(F.col("_any") & F.col("_colors").isNotNull() & (vector | bare), F.col("_colors")).otherwise(F.col("text_colors")).alias("text_colors"),
        F.when(vector, F.coalesce("_first.text_case", none)).alias("text_case"), vector.alias("plate_measured"))


def choose_plates(outputs: DataFrame, plates: DataFrame, scope: list[str], bare: bool = False) -> DataFrame:
    """Plate per candidate and output size: origin, preferred source, nearest proportion.

    Only the best origin of a scope can win. Its plates are first folded to one
    per proportion, and to one per source and proportion for the sources a
    candidate prefers, so outputs never meet every plate.
    """
    rank = F.when(F.col("origin") == "vector", 0).when(F.coalesce("origin", F.lit("psd")) == "psd", 1).otherwise(2)
    path = F.coalesce(F.nullif(F.col("bare_path"), F.lit("")), F.col("path")) if bare else F.col("path")
    usable = plates.where((F.col("plate_w") > 0) & (F.col("plate_h") > 0)).select(
        *scope, "source_id", rank.alias("_rank"), (F.col("plate_w") / F.col("plate_h")).alias("_aspect"), "ord", path.alias("plate"))
    lowest = usable.groupBy(*scope).agg(F.min("_rank").alias("_rank"))
    top = usable.join(lowest, [*scope, "_rank"])
    any_ = best_per_group(top, [*scope, "_aspect"], [F.col("ord")], [*scope, "_aspect", "ord", "plate"])
    own = best_per_group(top, [*scope, "source_id", "_aspect"], [F.col("ord")], [*scope, "source_id", "_aspect", "ord", "plate"])
    keys = [*scope, "candidate_id", "format_id"]
    cols = [*keys, "width", "height", "_aspect", "ord", "plate"]
    liked = outputs.withColumn("source_id", F.explode(F.array_distinct("source_ids"))).join(own, [*scope, "source_id"]).select(*cols, F.lit(0).alias("_pref"))
    other = outputs.join(any_, scope).select(*cols, F.lit(1).alias("_pref"))
    order = [F.col("_pref"), F.abs(F.col("_aspect") - F.col("width") / F.col("height")), F.col("ord")]
    return best_per_group(liked.unionByName(other), keys, order, [*keys, "plate"])


def valid_sources(ids: Column, known: Column, fallback: Column) -> Column:
    kept = F.filter(ids, lambda i: F.array_contains(known, i))
    return F.when(F.size(kept) == 0, fallback).otherwise(kept)


def template_checks(templates: DataFrame) -> DataFrame:
    """Warnings before producing: ``slots`` with ``category, kind, width, height, font_size, min_font_size``."""
    slots = F.col("slots")
    n = F.size(slots)
    general = F.array_compact(F.array(
        F.when(n == 0, "no_slots"),
        F.when(~F.exists(slots, lambda s: s["category"] == "product"), "no_product_slot"),
        F.when((n > 0) & (n < 2) & (F.col("fixed_layers") > 0), "few_slots"),
        F.when(~F.col("has_plate"), "no_plate"),
    ))
    small = F.transform(F.filter(slots, lambda s: F.least(s["width"], s["height"]) < K.MIN_SLOT_SIDE), lambda s: F.concat(F.lit("small_box:"), s["key"]))
    tiny = F.transform(F.filter(slots, lambda s: (s["kind"] == "text") & (s["font_size"] < s["min_font_size"])), lambda s: F.concat(F.lit("small_font:"), s["key"]))
    return templates.select("template_id", F.concat(general, small, tiny).alias("warnings"))


def template_summary(templates: DataFrame) -> DataFrame:
    ok = F.size(F.filter("masters", lambda m: m["approved"]))
    return templates.select(
        "template_id", F.size("slots").alias("slots"), F.size(F.filter("slots", lambda s: s["required"])).alias("required_slots"),
        "fixed_layers", ok.alias("formats_approved"), (F.size("masters") - ok).alias("formats_proposed"))


def content_fingerprint(columns: list[str]) -> Column:
    """Digest of the stable columns of a record, names in order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def feedback_style(note: Column) -> Column:
    """Style a human note asks for; later rules of the list win."""
    low = casefold(note)

    def says(*words):
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(low, F.lit(w))
        return cond

    calm = says("minimal", "limpio", "menos elemento", "mas aire", "más aire")
    price = says("precio grande", "precio protagonista", "destacar precio")
    return F.struct(
        F.when(calm, "minimal").alias("accent_style"),
        F.when(price, "compact").when(calm, "airy").alias("density"),
        F.when(says("producto a la derecha", "producto derecha"), "split_right")
        .when(says("producto a la izquierda", "producto izquierda"), "split_left").when(price, "price_focus").alias("archetype"),
        F.when(says("centr"), "center").when(says("alineado a la derecha"), "right").alias("text_alignment"),
    )


def instruction_bias(text: Column) -> Column:
    """Layout wishes read from a free instruction."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def says(words):
        cond = F.lit(False)
        for w in words:
            cond = cond | F.contains(low, F.lit(w))
        return cond

    def scale(name):
        out = F.lit(1.0)
        for key, factor, words in K.BIAS_SCALE:
            if key == name:
                out = out * F.when(says(words), factor).otherwise(1.0)
        return out

    def last(rules):
        return F.coalesce(*[F.when(says(words), value) for value, words in reversed(rules)])

    layouts = F.concat(*[
        F.when(says(words), F.array(*[F.lit(n) for n in names])).otherwise(F.array().cast("array<string>"))
        for words, names in K.BIAS_LAYOUTS
    ])
    return F.struct(
        scale("product_scale").alias("product_scale"), scale("text_scale").alias("text_scale"),
        layouts.alias("preferred_layouts"), F.when(says(K.BIAS_CENTER_ALIGN), "center").alias("force_align"),
        last(K.BIAS_HORIZONTAL).alias("product_horizontal"), last(K.BIAS_VERTICAL).alias("product_vertical"),
        F.when(says(K.BIAS_AIR), 0.9).otherwise(1.0).alias("extra_air"),
    )


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in kv])


def _model_int(c: Column) -> Column:
    """Integer text as an integer cut to 0..20; null for anything else."""
    t = strip_ws(c)
    return F.when(F.rlike(t, F.lit(r"^[+-]?\d+$")), F.least(F.lit(20), F.greatest(F.lit(0), t.try_cast("int"))))


def proposal_slot_key(c: Column) -> Column:
    key = slug(c)
    return F.coalesce(F.try_element_at(_lookup(K.SLOT_KEY_ALIASES), key), key)


def proposal_category(category: Column, slot_keys: Column) -> Column:
    money = F.array(*[F.lit(k) for k in ("precio", "precio_anterior", "cuota", "descuento")])
    return F.coalesce(
        F.try_element_at(_lookup(K.CATEGORY_ALIASES), slug(category)),
        F.when(F.array_contains(slot_keys, "productos"), "combo").when(F.arrays_overlap(slot_keys, money), "price_promotion"),
        F.lit("single_product"),
    )


def proposal_slots(raw_keys: Column) -> Column:
    """Known slot keys, first use only, as slots with category and kind."""
    keys = F.array_distinct(F.transform(raw_keys, proposal_slot_key))
    cats, kinds = _lookup(K.SLOT_CATEGORY), _lookup(K.SLOT_KIND)
    known = F.filter(keys, lambda k: F.try_element_at(cats, k).isNotNull())
    return F.transform(known, lambda k: F.struct(
        k.alias("key"), F.try_element_at(cats, k).alias("category"),
        F.coalesce(F.try_element_at(kinds, k), F.lit("text")).alias("kind"), (k == "productos").alias("repeatable")))


def proposal_range(minimum: Column, maximum: Column, exact: Column, free: Column, category: Column) -> Column:
    """Product range from an object (minimum, maximum, exact) or a free text like ``2-4``."""
    combo = category == "combo"
    # A zero in an object counts as missing.
    lo = F.coalesce(F.nullif(_model_int(minimum), F.lit(0)), F.when(combo, 2).otherwise(1))
    hi = F.coalesce(F.nullif(_model_int(maximum), F.lit(0)), F.when(combo, 4).otherwise(1))
    one = F.nullif(_model_int(exact), F.lit(0))
    numbers = F.transform(F.regexp_extract_all(F.coalesce(free, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), _model_int)
    lo = F.coalesce(one, F.when(F.size(numbers) >= 1, F.get(numbers, F.lit(0))), lo)
    hi = F.coalesce(one, F.when(F.size(numbers) >= 2, F.get(numbers, F.lit(1))).when(F.size(numbers) == 1, F.get(numbers, F.lit(0))), hi)
    lo = F.greatest(F.lit(1), lo)
    return F.struct(lo.alias("minimum"), F.greatest(lo, hi).alias("maximum"))


def text_items(items: Column, limit: int, item_limit: int) -> Column:
    cut = F.transform(items, lambda s: F.substring(strip_ws(s), 1, item_limit))
    return F.slice(F.array_distinct(F.filter(cut, lambda s: s != "")), 1, limit)


