"""Joins whose rows must not be broadcast, and work that copies of a name must not multiply."""

import datetime

from pyspark.sql import functions as F

from artkiln import constants as K
from artkiln.operators import catalog as C
from artkiln.operators import images as I
from artkiln.operators import matching as P
from artkiln.operators import matrix as M
from artkiln.operators import spatial as SP
from artkiln.operators import templates as T
from artkiln.operators.plugins import score_with
from artkiln.operators.skew import top_per_group
from artkiln.streaming import jobs as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_matrix_are_not_broadcast(spark):
    """rows that have a template, and the few signatures they share."""
    heads = list(K.HEADER_ALIASES)
    fields = spark.createDataFrame([("c1", "m1", i, *["Uno" if h == "producto" else "" for h in heads]) for i in range(3)], ["client_id", "matrix_id", "row_number", *heads])
    rows = M.split_errors(M.normalise_rows(fields))[0]
    slots = "array(struct('producto' AS key, 'product' AS category, 'image' AS kind, true AS required, false AS repeatable, false AS generate_if_missing))"
    templates = spark.sql(f"SELECT 'c1' AS client_id, 't1' AS candidate_id, 1 AS ord, 'Base' AS name, 'single_product' AS category, 1 AS range_min, 1 AS range_max, true AS approved, {slots} AS slots")
    chosen = T.select_templates(rows, templates, ["client_id"]).where(F.col("candidate_id").isNotNull())
    assert not any("BroadcastHashJoin" in line and "_sig" in line for line in plan(chosen).splitlines()) and chosen.count() == 3


def test_photos_of_one_name_count_as_each(spark):
    """twins are matched once, counted each."""
    rows = spark.createDataFrame([("c", 1, "vaso rojo", None), ("c", 2, "vaso rojo | taza", None), ("c", 3, "plato", None)], "client_id string, row_number int, producto string, imagen string")
    assets = spark.createDataFrame([("c", "a1", "vaso-rojo.png"), ("c", "a2", "vaso-rojo.png"), ("c", "a2", "taza.png"), ("c", "a3", "vaso_rojo.png"), ("c", "a4", "taza.png"), ("c", None, "taza.png"), ("c", "a5", None), ("c", "a6", "zzz.png")], "client_id string, asset_id string, filename string")
    keys = ["client_id", "row_number"]
    used = P.rows_of_assets(rows, assets, keys, ["client_id"]).collect()
    assert sorted((r.asset_id or "", r.rows) for r in used) == [("", 0), ("a1", 2), ("a2", 2), ("a2", 2), ("a3", 2), ("a4", 1), ("a5", 0), ("a6", 0)]
    assert sorted(map(tuple, P.ambiguous(P.token_hits(P.tokens(rows, keys), assets, keys, ["client_id"]), keys).collect())) == [("c", 1, 0, "vaso rojo", 3), ("c", 2, 0, "vaso rojo", 3), ("c", 2, 1, "taza", 3)]
    twins, names = P._twins(assets, ["client_id"])
    assert twins.count() == 6 and names.select("asset_id").distinct().count() == 4
    found = P.candidates(P.tokens(rows, keys), assets, keys, ["client_id"])
    assert sorted((r.row_number, r.pos, r.asset_id or "") for r in found.collect()) == [(n, 0, a) for n in (1, 2) for a in ("a1", "a2", "a3")] + [(2, 1, ""), (2, 1, "a2"), (2, 1, "a4")]


def test_pictures_are_not_broadcast(spark):
    """pixels and what is made of them, whatever the size of their file."""
    px = spark.range(3).selectExpr("id AS image_id", "explode(sequence(0, 63)) AS p").selectExpr("image_id", "p % 8 AS x", "p div 8 AS y", "p AS r", "p * 2 AS g", "3 AS b", "255 AS a")
    sigs = I.signatures(px, ["image_id"], 7, 8)
    assert "BroadcastHashJoin" not in plan(sigs) and sigs.count() == 3
    named = sigs.selectExpr("1 AS doc", "cast(image_id AS string) AS sig", "h0", "h1", "h2", "h3", "mean_r", "mean_g", "mean_b", "aspect")
    assert "BroadcastHashJoin" not in plan(I.similar_signatures(named, ["doc"]))


ARTS = "art_id int, width int, height int, layers int"


def test_formats_of_an_art_are_chosen_in_its_row(spark):
    """no art meets the catalogue as rows before the sort; arts of one key still count together."""
    arts = spark.createDataFrame([(1, 1080, 1080, 1), (1, 1080, 1920, 1), (2, 300, 2000, 5), (3, None, 700, 2), (None, 900, 660, 1)], ARTS)
    for df in (C.nearest_ratio(arts, ["art_id"]), C.nearest_native(arts, ["art_id"]), C.auto_formats(arts, ["art_id"], "layers")):
        assert "NestedLoopJoin" not in plan(df) and "CartesianProduct" not in plan(df) and df.count() == 4
    some, every = (C.art_formats(arts, "layers", k).withColumnsRenamed({"needs_split": "crowded", "format_ord": "ord"}) for k in (5, None))
    best = [sorted(map(tuple, top_per_group(d, ["art_id"], C.picker_order(), 5).select("art_id", "format_id", "rn", "coverage").collect()), key=str) for d in (some, every)]
    assert best[0] == best[1] and len(best[0]) == 20 and some.count() == 25
    assert "NestedLoopJoin" not in plan(some)


def test_the_worst_fit_needs_no_sort_of_arts(spark):
    """arts are folded by plain numbers; the first of the tightest arts is told whole, one without a place comes last."""
    rows = [("f", 5, 2, 7, 7, 0.9, 4), ("f", 6, 3, 4, 4, 0.5, 2), ("f", 9, 6, None, None, 0.4, 9), ("f", 9, 7, 1, 1, 0.7, 5), ("g", 3, 3, None, None, 0.3, 4), ("g", None, 2, 8, 8, 0.2, 4)]
    fits = spark.createDataFrame(rows, "format_id string, total int, fits int, art_id bigint, art_ord bigint, coverage double, layers int")
    worst = C.worst_fit(fits)
    assert sorted(map(tuple, worst.collect())) == [("f", 6, 3, 4, 0.4, False, True), ("g", 3, 3, None, 0.2, False, False)]
    first = [line for line in plan(worst).splitlines() if "_lack" in line and "Aggregate" in line]
    assert first and any("HashAggregate" in line for line in first)


def test_a_few_bad_rows_cost_a_few_calls(spark):
    """a batch with bad rows is halved, not tried row by row."""
    calls = spark.sparkContext.accumulator(0)

    def half(frame):
        calls.add(1)
        if (frame["score"] == 50).any():
            raise ValueError("fifty")
        return frame["score"] / 100

    rows = spark.range(0, 1010, 1, 1).select("id", (F.col("id") % 505).cast("int").alias("score"))
    got = score_with(rows, half).collect()
    assert all((r.predicted_performance, r.prediction_error) == ((None, "ValueError: fifty") if r.score == 50 else (r.score / 100, None)) for r in got)
    assert len(got) == 1010 and 0 < calls.value < 60


def test_a_scorer_of_odd_answers_is_asked_row_by_row(spark):
    """too many values for a batch fail it; a single row takes the first."""
    rows = spark.range(0, 5, 1, 1).select(F.col("id").cast("int").alias("score"))
    got = score_with(rows, lambda frame: [float(frame["score"].iloc[0])] * (len(frame) + 1)).collect()
    assert sorted((r.score, r.predicted_performance, r.prediction_error) for r in got) == [(i, float(i), None) for i in range(5)]


def test_boxes_of_a_piece_travel_as_one_row(spark):
    """coverage shuffles a set of small numbers per piece, no row per grid row, and counts every cell once."""
    rows = [("a", 0, 0, 50, 50, 100, 100), ("a", 25, 25, 50, 50, 100, 100), ("a", 25, 25, 50, 50, 100, 100), ("b", -10, 0, 200, 10, 100, 100), ("c", 100, 50, 9, 9, 100, 100), ("d", 5, 0, 9, 9, 0, 0), ("e", 5, 100, 9, 9, 100, 100), ("f", 0, 0, 99, 3, 100, 100), (None, 0, 0, 1, 1, None, 100)]
    df = spark.createDataFrame(rows, "g string, x int, y int, width int, height int, canvas_w int, canvas_h int")
    out = SP.union_coverage(df, ["g"])
    got = {r.g: r.fill * 4096 for r in out.collect()}
    want = {}
    for g, x, y, w, h, cw, ch in rows:
        cut = lambda v: max(0, min(64, int(v)))
        x0, y0 = (cut(x / cw * 64) if cw else 0), (cut(y / ch * 64) if ch else 0)
        x1, y1 = max(x0 + 1, min(64, int((x + w) / cw * 64) if cw else 0)), max(y0 + 1, min(64, int((y + h) / ch * 64) if ch else 0))
        cells = {(i, j) for i in range(x0, min(64, x1)) for j in range(y0, min(64, y1))} if cw is None or cw > 0 else set()
        if y0 < 64 and (cells or y0 == 0):
            want[g] = want.get(g, set()) | cells
    assert got == {g: len(c) for g, c in want.items()}
    text = plan(SP.union_coverage(df, ["g"]))
    assert "Generate" not in text and text.count("Exchange hashpartitioning") == 1


def test_deliveries_of_a_task_are_judged_in_order(spark):
    """rows of a task in order of time and number; each delivery once."""
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [("t", 4, day(3), "PENDING"), ("t", 1, day(1), "PENDING"), ("t", 2, day(2), "COMPLETED"), ("t", 3, day(2), "PENDING"), ("t", 5, day(9), "PENDING"), ("u", 6, day(1), "STARTED"), ("t", 0, day(2), "PENDING")]
    stream = J.replayed(spark.createDataFrame(rows, "task_id string, event_id bigint, ts timestamp, state string"), "judged")
    got = sorted((r.task_id, r.event_id, r.ts, r.run) for r in J.drained(J.deliveries(stream, hours=36), "judged").collect())
    assert got == [("t", 0, day(2), True), ("t", 1, day(1), True), ("t", 3, day(2), False), ("t", 4, day(3), False), ("t", 5, day(9), True)]
