"""Rules checked against plain Python on small fixtures, and under skew."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from artkiln.functions import sizes as S
from artkiln.operators import art_reads as A
from artkiln.operators import evidence as E
from artkiln.operators import images as I
from artkiln.operators import matching as P
from artkiln.operators import projects as PR
from artkiln.operators import quality as Q
from artkiln.operators import spatial as SP
from artkiln.operators.skew import bucketed_before, bucketed_rank

BOX = "g string, ord bigint, x int, y int, width int, height int"


def boxes(seed, n, group="a", span=1000, size=200):
    rnd = random.Random(seed)
    return [(group, i, rnd.randrange(span), rnd.randrange(span), rnd.randrange(20, size), rnd.randrange(20, size)) for i in range(n)]


def inter(a, b):
    w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return w * h if w > 0 and h > 0 else 0


@pytest.mark.parametrize("n", [30, 700])
def test_box_pairs_find_every_pair_once(spark, n):
    rows = boxes(1, n)
    df = spark.createDataFrame(rows, BOX)
    got = [(r.a_ord, r.b_ord) for r in SP.box_pairs(df, df, ["g"]).where("a_ord < b_ord").collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and inter(a, b) > 0}
    assert len(got) == len(set(got)) and want <= set(got)
    touching = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4] and a[3] <= b[3] + b[5] and b[3] <= a[3] + a[5]}
    assert set(got) == touching


@pytest.mark.parametrize("limit", [1000, 5])
def test_greedy_suppression_in_one_tile_and_in_many(spark, limit):
    rows = boxes(2, 60, "a", 400) + boxes(3, 40, "b", 300)
    got = {(r.g, r.ord) for r in SP.greedy_keep(spark.createDataFrame(rows, BOX), ["g"], [-F.col("width").cast("bigint") * F.col("height")], 0.6, tile_boxes=limit).collect()}
    want = set()
    for g in "ab":
        kept = []
        for b in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4] * r[5], r[1])):
            if not any(inter(b, k) / (b[4] * b[5]) > 0.6 for k in kept):
                kept.append(b)
        want |= {(g, b[1]) for b in kept}
    assert got == want


def plain_keep(rows, share, kind):
    """Kept ord numbers of (ord, x, y, w, h) in rank order, by arrays."""
    import numpy as np

    kept = np.zeros((0, 4))
    out = []
    for o, *b in rows:
        w = np.minimum(b[0] + b[2], kept[:, 0] + kept[:, 2]) - np.maximum(b[0], kept[:, 0])
        h = np.minimum(b[1] + b[3], kept[:, 1] + kept[:, 3]) - np.maximum(b[1], kept[:, 1])
        inside = np.maximum(0, w) * np.maximum(0, h)
        whole = b[2] * b[3] + kept[:, 2] * kept[:, 3] - inside if kind == "iou" else max(1, b[2] * b[3])
        if not (inside > share * whole).any():
            kept = np.vstack([kept, b])
            out.append(o)
    return set(out)


@pytest.mark.parametrize("kind, share", [("contained", 0.6), ("iou", 0.7), ("contained", 0.5)])
def test_greedy_suppression_of_a_hot_group(spark, kind, share):
    """A group with a third of all boxes is dealt to tiles of like size and gives what a plain fold gives."""
    hot = boxes(11, 9000, "hot", 4000, 90) + [("hot", 9000, 0, 0, 4100, 4100), ("hot", 9001, 10, 10, 4000, 20)] + [("hot", 9002 + i, 77, 77, 60, 60) for i in range(300)]
    small = [b for k in range(450) for b in boxes(k, 40, f"g{k}", 900, 200)]
    df = spark.createDataFrame(hot + small, BOX).withColumn("g", F.when(F.col("g") != "g3", F.col("g")))  # a null group is a group
    got = SP.greedy_keep(df, ["g"], [-F.col("width").cast("bigint") * F.col("height")], share, kind, tile_boxes=300)
    assert got.columns == df.columns
    kept = {}
    for r in got.collect():
        kept.setdefault(r.g or "g3", set()).add(r.ord)
    groups = {}
    for r in hot + small:
        groups.setdefault(r[0], []).append(r[1:])
    for g, rows in groups.items():
        assert kept[g] == plain_keep(sorted(rows, key=lambda r: (-r[3] * r[4], r[0])), share, kind), g
    tiled = SP._tiles(df.withColumn("_g", F.coalesce("g", F.lit("g3"))), 300, 0.0).groupBy("_g", "_tx", "_ty").count().collect()
    assert max(r["count"] for r in tiled) < 1200 and sum(r["count"] for r in tiled if r._g == "hot") < 4 * len(hot)
    with pytest.raises(ValueError):
        SP.greedy_keep(df, ["g"], [F.col("ord")], 0.4)


def test_axis_clusters_of_a_hot_group_with_boxes_without_length(spark):
    """Thousands of boxes under one as wide as the canvas, empty ones among them, against a plain fold over all members."""
    rnd = random.Random(8)
    rows = [("a", 0, 0, 0, 30000, 10)] + [("a", i, rnd.randrange(60000), rnd.randrange(50), rnd.choice([0, 1, 2, 7, 30, 200]), 10) for i in range(1, 3000)]
    rows += [("b", i, 5 * i, 0, rnd.choice([0, 4, 9]), 10) for i in range(200)]
    got = {(r.g, r.ord): r.cluster for r in SP.axis_clusters(spark.createDataFrame(rows, BOX).withColumn("axis", F.lit("x")), ["g"]).collect()}
    want = {}
    for g in "ab":
        number, members = -1, []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[3] + r[5] / 2, r[1])):
            s, e = r[2], r[2] + r[4]
            if not any(min(e, b) - max(s, a) > 0 and min(e, b) - max(s, a) >= 0.5 * min(e - s, b - a) for a, b in members):
                number, members = number + 1, []
            members.append((s, e))
            want[g, r[1]] = number
    assert got == want


def test_axis_clusters_against_plain_fold(spark):
    rows = boxes(4, 80, "a", 3000, 150)
    df = spark.createDataFrame(rows, BOX).withColumn("axis", F.lit("x"))
    got = {r.ord: r.cluster for r in SP.axis_clusters(df, ["g"]).collect()}
    clusters = []
    for b in sorted(rows, key=lambda r: (r[2], r[3] + r[5] / 2, r[1])):
        def over(m):
            c = min(b[2] + b[4], m[2] + m[4]) - max(b[2], m[2])
            return c > 0 and c / min(b[4], m[4]) >= 0.5
        if clusters and any(over(m) for m in clusters[-1]):
            clusters[-1].append(b)
        else:
            clusters.append([b])
    assert got == {b[1]: i for i, c in enumerate(clusters) for b in c}


def test_bucketed_windows_equal_plain_windows(spark):
    from pyspark.sql import Window

    df = spark.range(3000).selectExpr("id % 2 = 0 or id % 3 = 0 as hot", "cast(id * 7919 % 3001 as int) o", "cast(id % 13 as int) v")
    w = Window.partitionBy("hot").orderBy("o")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    a = bucketed_rank(df, ["hot"], F.floor(F.col("o") / 100), [F.col("o")])
    b = bucketed_before(a, ["hot"], F.floor(F.col("o") / 100), [F.col("o")], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))})
    plain = df.select("hot", "o", "v", F.row_number().over(w).cast("bigint").alias("rn"), F.sum("v").over(prior).alias("s"), F.max("v").over(prior).alias("m"), F.lag("v").over(w).alias("l"))
    assert b.select("hot", "o", "v", "rn", "s", "m", "l").exceptAll(plain).isEmpty()


def test_product_sizes(spark):
    cases = {"cocina-indurama-4q-20p-croma.png": 90.0, "cilindro-de-gas-15kg.png": 58.0, "cocina a gas 30p": 95.0, "horno microondas 20 litros.png": 30.0,
             "Capa 15": None, "producto.png": None, "": None, "aspiradora.png": None, "Plancha de inducción": None}
    df = spark.createDataFrame([(k,) for k in [*cases, 'Smart TV 55"']], "t string")
    got = {r.t: r.h for r in df.select("t", S.measure(F.col("t"))["height_cm"].alias("h")).collect()}
    assert 70 <= got.pop('Smart TV 55"') <= 78 and got == cases


def test_relative_heights_floor_and_unknown(spark):
    df = spark.createDataFrame([("a", 1, 170.0), ("a", 2, 16.0), ("a", 3, None), ("b", 1, 90.0), ("b", 2, None)], "g string, ord int, height_cm double")
    got = {(r.g, r.ord): round(r.ratio, 4) for r in Q.relative_heights(df, ["g"]).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 0.3, ("a", 3): round(93 / 170, 4), ("b", 1): 1.0, ("b", 2): 1.0}


def test_matching_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["tv", "cocina", "horno", "led", "oster", "gas", "ab", "x"]
    name = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    rows = [("c", i, " | ".join(name(rnd.randrange(1, 3)) for _ in range(2)), None) for i in range(60)]
    assets = [("c", f"a{i}", name(rnd.randrange(1, 4)) + ".png") for i in range(25)] + [("c", "z", "___.png")]
    got = {(r.row, r.pos, r.asset_id) for r in P.candidates(P.tokens(spark.createDataFrame(rows, "scope string, row int, producto string, imagen string"), ["scope", "row"]),
                                                            spark.createDataFrame(assets, "scope string, asset_id string, filename string"), ["scope", "row"], ["scope"]).collect()}
    slug = lambda s: "_".join(p for p in "".join(c if c.isalnum() else " " for c in s.lower()).split())
    marks = [(a, m) for _, a, f in assets for m in {slug(f), slug(f[:-4])} if m]
    want = set()
    for _, i, p, _n in rows:
        for pos, tok in enumerate(t.strip() for t in p.split("|")):
            key = slug(tok)
            hit = {a for a, m in marks if m == key} or {a for a, m in marks if len(key) >= 3 and (key in m or m in key)}
            want |= {(i, pos, a) for a in hit}
    assert got == want


def test_art_slots_sample(spark):
    reads = [(1, "MARCA", 60, 20, 260, 80, "brand"), (2, "Gran oferta de temporada", 60, 120, 900, 220, "content"), (3, "Solo por hoy", 60, 240, 700, 300, "content"),
             (4, "$499", 60, 860, 500, 1000, "content"), (5, "Antes $699", 60, 1010, 400, 1060, "content"), (6, "Compra ahora", 600, 900, 1000, 980, "content"),
             (7, "Aplican restricciones", 60, 1300, 900, 1325, "content")]
    df = spark.createDataFrame([("art", o, t, x0, y0, x1, y1, r, 0.9, "#ffffff", 1080, 1350) for o, t, x0, y0, x1, y1, r in reads],
                               "art_id string, ord int, text string, x0 int, y0 int, x1 int, y1 int, role string, confidence double, color string, canvas_w int, canvas_h int")
    got = {r.slot: r.ord for r in A.assign_slots(df, ["art_id"]).collect()}
    assert got == {"logo": 1, "headline": 2, "subheadline": 3, "price": 4, "previous_price": 5, "cta": 6, "legal": 7}
    band = SP.free_band(df.select("art_id", "canvas_w", "canvas_h", "y0", "y1"), ["art_id"]).first()
    assert 300 < band.y0 < band.y1 < 860


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_art_slots_equal_brute_force_and_rank_the_lines_once(spark):
    from artkiln import constants as K

    rnd = random.Random(24)
    texts = ["MARCA", "Antes $99", "$55", "12", "20% OFF", "12 cuotas", "Aplican restricciones", "Compra ahora", "Valido hasta el 3", "Título del mes", "Texto"]
    chain = ("logo", "legal", "validity", "discount", "installment", "previous_price", "price", "cta", "headline")
    rows = []
    for art in range(25):
        for o in range(rnd.randrange(1, 30 if art % 5 else 90)):
            x0, y0 = rnd.randrange(0, 600), rnd.randrange(0, 1000)
            rows.append((art, o, rnd.choice(texts), x0, y0, x0 + rnd.randrange(0, 300), y0 + rnd.randrange(0, 90), rnd.choice(("brand", "content", None)), rnd.choice((0.9, 0.4, None)), 1080, 1080))
    df = spark.createDataFrame(rows, "art int, ord int, text string, x0 int, y0 int, x1 int, y1 int, role string, confidence double, canvas_w int, canvas_h int")
    has = lambda p, t: re.search(p, t) is not None

    def rank(slot, r):
        _, _, t, _, y0, _, y1, role, _, _, ch = r
        t, h = t.replace("í", "i\u0301"), y1 - y0
        price = has(r"\d", t) and (has(K.ART_MONEY, t) or has(K.ART_BEFORE, t) or has(K.ART_ONLY_FIGURE, t))
        fits = {"logo": role == "brand", "legal": has(K.ART_LEGAL, t) or (y0 / ch > 0.88 and h / ch < 0.035), "validity": h / ch <= 0.05 and has(K.ART_VALIDITY, t),
                "discount": has(K.ART_PERCENT, t), "installment": has(K.ART_INSTALLMENT, t), "previous_price": price and has(K.ART_BEFORE, t), "price": price,
                "cta": has(K.ART_CTA, t) and len(t) <= 40, "headline": True}
        return ({"legal": h, "previous_price": -h, "price": -h, "headline": -h}.get(slot, 0), r[1]) if fits[slot] else None

    want = set()
    for art in range(25):
        live = [r for r in rows if r[0] == art and (r[8] or 0) >= 0.6 and r[5] > r[3] and r[6] > r[4] and (r[5] - r[3]) * (r[6] - r[4]) <= 1080 * 1080 * K.ART_MAX_FIELD]
        used = {}
        for slot in chain:
            best = min(((rank(slot, r), r) for r in live if r[1] not in used.values() and rank(slot, r)), default=None, key=lambda v: v[0])
            if best:
                used[slot] = best[1][1]
        if "headline" in used:
            y1 = next(r[6] for r in live if r[1] == used["headline"])
            sub = min(((r[4], r[1]) for r in live if 0 <= r[4] - y1 < 108 and r[1] not in used.values()), default=None)
            if sub:
                used["subheadline"] = sub[1]
        want |= {(art, s, o) for s, o in used.items()}
    got = A.assign_slots(df, ["art"])
    assert {(r.art, r.slot, r.ord) for r in got.collect()} == want
    # Before, the choice was planned three times: for the result, the headline and the lines in use.
    assert _plan(got).count("Window [row_number") == 1


def test_free_band_equals_brute_force_without_joins(spark):
    rnd = random.Random(13)
    rows = [(a, 500, 1000 + a % 2, y, y + rnd.randrange(-5, 200)) for a in range(30) for y in (rnd.randrange(-50, 1000) for _ in range(rnd.randrange(1, 12)))]
    rows += [(None, 500, 1000, 10, 990), (40, 500, 1000, 5, 5), (41, 500, 800, 100, 300), (41, 500, 1000, 100, 200)]
    got = SP.free_band(spark.createDataFrame(rows, "art int, canvas_w int, canvas_h int, y0 int, y1 int"), ["art"])
    want = set()
    for art, w, ch in {r[:3] for r in rows}:
        spans = [] if art is None else sorted((max(0, r[3]), min(r[2], r[4]), r[2]) for r in rows if r[0] == art and max(0, r[3]) < min(r[2], r[4]))
        gaps, reach = [], 0
        for s, e, own in spans:
            gaps += [(s - reach, -reach)] if own == ch and s > reach else []
            reach = max(reach, e)
        size, a = max([*gaps, (ch - reach, -reach)])
        a, breath = -a, int(size * 0.06)
        if size >= ch * 0.18 and size - 2 * breath > 0:
            want.add((art, 30, a + breath, 470, a + size - breath))
    assert {tuple(r) for r in got.collect()} == want
    # Before, each line met the buckets of its art in a join, and the canvases in another.
    assert "Join" not in _plan(got)


def test_paragraphs_shuffle_each_value_once(spark):
    rnd = random.Random(27)
    rows, top = [], 0
    for o in range(400):
        top += rnd.choice((11, 12, 14, 40, 700))
        rows.append((o % 2, o, top, top + rnd.choice((9, 10, 14)), rnd.randrange(60, 100), *[rnd.choice((0, 60))] * 3))
    df = spark.createDataFrame(rows, "art int, ord int, top int, bottom int, span int, r int, g int, b int")
    want = {}
    for art in (0, 1):
        prev, block, blocks = None, 0, {}
        for _, o, t, b, span, c, _, _ in (r for r in rows if r[0] == art):
            h = b - t + 1
            if prev:
                tall, short = max(prev[1], h), max(1, min(prev[1], h))
                block += t - prev[0] - 1 > tall * 0.9 or tall / short > 1.3 or math.sqrt(3 * (prev[2] - c) ** 2) > 70
            prev = (b, h, c)
            blocks.setdefault(block + 1, []).append((h, span))
        for n, ls in blocks.items():
            hs, wide = [h for h, _ in ls], max(s for _, s in ls)
            want[art, n] = (len(ls), len(ls) < 2 or (max(hs) <= min(hs) * 1.15 and min(s for _, s in ls[:-1]) / wide >= 0.85))
    got = PR.paragraphs(df, ["art"])
    assert {(r.art, r.block): (r.lines, r.is_paragraph) for r in got.collect()} == want
    assert {tuple(r) for r in PR.paragraphs(df, ["art"], 512).collect()} == {tuple(r) for r in got.collect()}
    # Before, the values of the previous line travelled twice, as columns and as a struct of them.
    assert "_v_" not in _plan(got)


def test_gap_redistribution(spark):
    df = spark.createDataFrame([("v", 1, 0, 0, 100, 100, True), ("v", 2, 0, 400, 100, 100, True), ("v", 3, 0, 600, 100, 100, True)], "v string, ord int, x int, y int, width int, height int, pinned boolean")
    hole = spark.createDataFrame([("v", 0, 200, 100, 100)], "v string, x int, y int, width int, height int")
    got = {r.ord: r.new_y for r in Q.redistribute_gaps(df, hole, ["v"]).collect()}
    # Gaps 300 (holds the hole, counts 200) and 100 share 400 free pixels.
    assert got == {1: 0, 2: round(100 + 400 * 200 / 300), 3: 600}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(256) for _ in range(12)]
    sigs = []
    for i in range(150):
        h = base[i % 12]
        for _ in range(rnd.choice([0, 5, 20, 24, 25, 40])):
            h ^= 1 << rnd.randrange(256)
        sigs.append((f"s{i:03d}", h, rnd.randrange(0, 30), round(1 + rnd.randrange(4) * 0.05, 2)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [("d", s, *[signed((h >> (64 * (3 - w))) & (2**64 - 1)) for w in range(4)], m, m, m, a) for s, h, m, a in sigs]
    df = spark.createDataFrame(rows, "doc string, sig string, h0 bigint, h1 bigint, h2 bigint, h3 bigint, mean_r int, mean_g int, mean_b int, aspect double")
    got = {(r.a_sig, r.b_sig) for r in I.similar_signatures(df, ["doc"]).collect()}
    want = {(a[0], b[0]) for a in sigs for b in sigs if a[0] < b[0] and bin(a[1] ^ b[1]).count("1") <= 24 and abs(a[2] - b[2]) <= 18 and round(abs(a[3] - b[3]), 6) <= 0.06}
    assert got == want and want


@pytest.mark.parametrize("hot", [1000, 20])
def test_pictures_that_share_plain_rows_meet_by_their_rarest_bands(spark, monkeypatch, hot):
    """Also where so many share every band that cells of the mean colour take over."""
    monkeypatch.setattr(I, "HOT_BAND", hot)
    rnd = random.Random(5)
    rows = []
    for i in range(240):
        if i % 3 == 0:  # flat but for a few bits
            bits = sum(1 << rnd.randrange(256) for _ in range(rnd.randrange(16)))
        elif i % 3 == 1:  # three plain rows above ones of their own
            bits = rnd.getrandbits(208)
        else:
            bits = rows[-1][-1] ^ sum(1 << b for b in rnd.sample(range(256), rnd.choice((23, 24, 25))))
        words = [(bits >> s) & (2**64 - 1) for s in (192, 128, 64, 0)]
        colour = rows[-1][6:9] if i % 3 == 2 else tuple(rnd.randrange(0, 256, 17) for _ in range(3))
        rows.append((1, f"s{i:03}", *[w - 2**64 if w >= 2**63 else w for w in words], *colour, 1.0, bits))
    schema = "doc int, sig string, h0 long, h1 long, h2 long, h3 long, mean_r int, mean_g int, mean_b int, aspect double"
    df = spark.createDataFrame([r[:-1] for r in rows], schema)
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and (a[-1] ^ b[-1]).bit_count() <= 24 and max(abs(x - y) for x, y in zip(a[6:9], b[6:9])) <= 18}
    assert {(r.a_sig, r.b_sig) for r in I.similar_signatures(df, ["doc"]).collect()} == want and len(want) > 40


def test_colour_clusters_equal_plain_rounds(spark):
    rnd = random.Random(9)
    px = [(g, *[rnd.randrange(256) // s * s for _ in range(3)]) for g, n, s in (("a", 900, 1), ("b", 300, 64), ("c", 3, 1)) for _ in range(n)]
    df = spark.createDataFrame(px, "image_id string, r int, g int, b int")
    want = set()
    for g in "abc":
        bins = {}
        for _, *c in (p for p in px if p[0] == g):
            t = bins.setdefault(tuple(v >> 4 for v in c), [0, 0, 0, 0])
            bins[tuple(v >> 4 for v in c)] = [t[0] + 1, *[x + y for x, y in zip(t[1:], c)]]
        rows = [v for _, v in sorted(bins.items(), key=lambda kv: (-kv[1][0], kv[0]))]
        centres = [([s // v[0] for s in v[1:]], 0) for v in rows[:4]]
        for _ in range(6):
            own = [[0, 0, 0, 0] for _ in centres]
            for v in rows:
                at = min(range(len(centres)), key=lambda i: (sum((s // v[0] - m) ** 2 for s, m in zip(v[1:], centres[i][0])), i))
                own[at] = [x + y for x, y in zip(own[at], v)]
            centres = [([s // o[0] for s in o[1:]], o[0]) if o[0] else (c[0], 0) for o, c in zip(own, centres)]
        order = sorted((i for i in range(len(centres)) if centres[i][1]), key=lambda i: (-centres[i][1], i))
        want |= {(g, k + 1, centres[i][1], *centres[i][0]) for k, i in enumerate(order)}
    assert {tuple(r) for r in I.cluster_colours(df, ["image_id"], 4, 6).collect()} == want


def test_signature_of_a_gradient(spark):
    px = spark.range(34 * 32).selectExpr("'i' image_id", "cast(id % 34 as int) x", "cast(id div 34 as int) y", "cast(255 - id % 34 * 7 as int) r").withColumns(
        {"g": F.col("r"), "b": F.col("r"), "a": F.lit(255)})
    s = I.signatures(px, ["image_id"]).first()
    assert (s.h0, s.h1, s.h2, s.h3) == (-1, -1, -1, -1) and s.aspect == round(34 / 32, 2)


def test_evidence_text_is_cut_exactly(spark):
    parts = [("k", i, "x" * (i % 37) + str(i)) for i in range(500)]
    got = E.evidence_text(spark.createDataFrame(parts, "k string, pos int, text string"), ["k"], limit=2_000).first().evidence
    assert got == "\n\n".join(t for _, _, t in parts)[:2_000]


def test_even_sample_positions(spark):
    df = spark.range(23).selectExpr("'k' k", "id pos")
    for k in (1, 2, 5, 16, 22):
        got = sorted(r.pos for r in E.even_sample(df, ["k"], F.lit(k)).collect())
        assert got == ([0] if k == 1 else sorted({round(j * 22 / (k - 1)) for j in range(k)}))


def test_paragraph_and_list(spark):
    lines = [("p", 1, 0, 20, 300), ("p", 2, 24, 44, 295), ("p", 3, 48, 68, 90), ("l", 1, 0, 20, 300), ("l", 2, 24, 44, 80), ("l", 3, 48, 68, 290)]
    df = spark.createDataFrame([(*x, 0, 0, 0) for x in lines], "art string, ord int, top int, bottom int, span int, r int, g int, b int")
    assert {r.art: r.is_paragraph for r in PR.paragraphs(df, ["art"]).collect()} == {"p": True, "l": False}


def test_sizes_use_the_diagonal():
    assert math.isclose(55 * 9 / math.sqrt(337) * 2.54 * 1.08, 73.98, abs_tol=0.1)


def test_frames_win_over_pages(spark):
    from artkiln.operators import documents as D

    pages = spark.createDataFrame([("a", 1, 0, 0, 1000, 1000), ("a", 2, 0, 0, 1000, 1000), ("b", 1, 0, 0, 800, 800), ("b", 2, 0, 0, 3000, 100)],
                                  "doc string, page int, x int, y int, width int, height int")
    images = spark.createDataFrame(
        [("a", 1, 1, 5, False, 100, 100, 400, 500), ("a", 1, 2, 6, False, 120, 120, 380, 400), ("a", 1, 3, 7, True, 0, 0, 500, 500), ("a", 1, 4, 8, False, 900, 0, 300, 400),
         ("b", 1, 1, 9, True, 0, 0, 300, 300), ("b", 2, 1, 9, False, 0, 0, 10, 10)],
        "doc string, page int, ord bigint, xref int, alpha boolean, x int, y int, width int, height int")
    got = {(r.doc, r.page, r.xref, r.kind) for r in D.frames_or_pages(pages, images, ["doc"]).collect()}
    # The second image lies in the first; the fourth leaves the sheet; a document with frames gives no pages.
    assert got == {("a", 1, 5, "frame"), ("b", 1, 0, "page")}


def test_warnings_keep_report_order(spark):
    rows = [("v", 10, 2, 0, "b"), ("v", 10, 1, 0, "a"), ("v", 90, 1, 0, "a"), *[("v", 20, i, 0, f"o{i}") for i in range(20)]]
    df = spark.createDataFrame(rows, "v string, section int, a bigint, b bigint, text string")
    assert Q.report_warnings(df, ["v"]).first().warnings == ["a", "b", *[f"o{i}" for i in range(8)]]


def test_hot_group_gives_the_same_pairs(spark):
    """Two thirds of all rows in one group: the grid splits it, small groups stay whole."""
    rows = boxes(9, 900, "hot", 4000, 120) + [b for g in range(40) for b in boxes(g, 8, f"g{g}", 300)]
    df = spark.createDataFrame(rows, BOX)
    got = SP.box_pairs(df, df, ["g"]).where("a_ord < b_ord").select("g", "a_ord", "b_ord")
    a, b = (df.select("g", *[F.col(c).alias(p + c) for c in ("ord", "x", "y", "width", "height")]) for p in ("a_", "b_"))
    plain = a.join(b, "g").where("a_ord < b_ord AND a_x <= b_x + b_width AND b_x <= a_x + a_width AND a_y <= b_y + b_height AND b_y <= a_y + a_height").select("g", "a_ord", "b_ord")
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_contained_names_of_one_prefix_meet_by_their_rarest_letters(spark):
    """20,000 names that all begin alike, with numbers; every name inside another is found, and few pairs are compared."""
    rnd = random.Random(4)
    longer = [("c", f"campana navidad tienda {rnd.randrange(10**6)} frente {i % 7}") for i in range(20000)]
    shorter = [("c", x[: rnd.randrange(24, len(x))]) for _, x in rnd.sample(longer, 300)] + [("c", "campana navidad tienda zz"), ("c", "tienda 1"), ("d", "tienda 1"), ("c", "ana"), ("c", "a")]
    left, right = spark.createDataFrame(sorted(set(shorter)), "g string, s string"), spark.createDataFrame(sorted(set(longer)), "g string, l string")
    got = {tuple(r) for r in P._contained(left, "s", right, "l", ["g"]).collect()}
    assert got == {(g, s, l) for g, s in set(shorter) for h, l in set(longer) if g == h and len(s) >= 3 and s in l}


def test_styles_follow_the_best_source(spark):
    """A vector file rules; without one, colours fill gaps; where nothing is measured, nothing changes."""
    from artkiln.operators import templates as T

    rows = [("v", 2, "vector", False, {"cta": "#1"}, {"cta": "upper"}), ("v", 1, "ocr", True, {"cta": "#2", "legal": "#3"}, {"cta": "no"}), ("w", 1, "vector", True, {}, None),
            ("p", 5, "psd", True, {"cta": "#4"}, {"cta": "upper"}), ("p", 4, "psd", False, {"cta": "#5"}, None), ("n", 1, "vector", False, {"cta": "#6"}, {"cta": "upper"}), ("x", 1, "psd", True, None, None)]
    sources = spark.createDataFrame(rows, "c string, ord int, origin string, measured boolean, text_colors map<string,string>, text_case map<string,string>")
    own = [(c, k, m) for c in "vwpnxz" for k, m in (("a", {}), ("b", {"cta": "#own"}), ("d", None))]
    got = {(r.c, r.candidate_id): (r.text_colors, r.text_case, r.plate_measured)
           for r in T.overlay_styles(spark.createDataFrame(own, "c string, candidate_id string, text_colors map<string,string>"), sources, ["c"]).collect()}
    assert len(got) == len(own)
    for k, m in (("a", {}), ("b", {"cta": "#own"}), ("d", None)):
        assert got["v", k] == ({"cta": "#1", "legal": "#3"}, {"cta": "upper"}, True)
        assert got["w", k] == (m, {}, True)
        assert got["p", k] == ({"cta": "#5"} if not m else m, None, False)
        assert got["n", k] == got["x", k] == got["z", k] == (m, None, False)


def test_budgets_of_a_production(spark):
    from artkiln.operators import matching as P

    sizes = {1: [(1000, 1000)] * 6, 2: [(10, 10)] * 7, 3: [(10_000, 5_000)], 4: [(10_000, 5_001)], 5: [(6000, 2000)] * 2, 6: [(6000, 2000), (6000, 2001)]}
    df = spark.createDataFrame([(k, w, h) for k, v in sizes.items() for w, h in v], "row int, width int, height int")
    got = {r.row: r.rule for r in P.render_budget(df, ["row"]).collect()}
    assert got == {1: None, 2: "too_many_products", 3: "too_many_pixels", 4: "photo_too_large", 5: None, 6: "too_many_pixels"}


@pytest.mark.parametrize("few", [1000, 6])
def test_repeated_images_equal_brute_force(spark, monkeypatch, few):
    """looks that many others resemble, lone ones, copies, files of several pieces, pieces that are null, a scope of one piece."""
    monkeypatch.setattr(I, "HOT_BAND", few)
    monkeypatch.setattr(I, "BUCKET", few, raising=False)
    rnd = random.Random(8)
    rows = []
    for i in range(220):
        doc = ("dense", "sparse", "one", "dense" if i % 20 else None)[i % 4]
        bits = rnd.getrandbits(20) if doc != "sparse" else rnd.getrandbits(256)
        if doc == "sparse" and i % 3 == 0 and i > 8:
            bits = rows[i - 4][-1] ^ sum(1 << b for b in rnd.sample(range(256), rnd.choice((0, 23, 24, 25))))
        colour = (rnd.randrange(0, 256, 12),) * 3 if doc == "dense" else (9, 9, 9)
        piece = None if i % 15 == 0 else 1 if doc == "one" else rnd.randrange(6)
        words = [(bits >> s) & (2**64 - 1) for s in (192, 128, 64, 0)]
        rows.append((i, doc, piece, rnd.choice((0, 7, 8, *[100 + i] * 30)), i % 11 > 0, 0.01 if i % 7 == 0 else 0.3, *[w - 2**64 if w >= 2**63 else w for w in words], *colour, rnd.choice((1.0, 1.06, 1.2)), bits))
    schema = "image_id int, doc string, piece_id int, xref int, alpha boolean, ratio double, h0 long, h1 long, h2 long, h3 long, mean_r int, mean_g int, mean_b int, aspect double"
    cut = [r for r in rows if r[4] and r[3] > 0 and r[1]]

    def like(a, b):
        same = a[6:14] == b[6:14]
        return same or (a[-1] ^ b[-1]).bit_count() <= 24 and max(abs(x - y) for x, y in zip(a[10:13], b[10:13])) <= 18 and round(abs(a[13] - b[13]), 6) <= 0.06

    def other(a):
        return any(a[1] == b[1] and b[2] not in (None, a[2]) and (a[3] == b[3] or like(a, b)) for b in cut)

    want = {a[0]: None if a[2] is None else other(a) for a in cut if a[5] == 0.3}
    monkeypatch.setattr(I, "staged", lambda d, label: d)
    result = I.repeated_images(spark.createDataFrame([r[:-1] for r in rows], schema), ["doc"])
    got = result.select("image_id", "repeated").collect()
    assert {r.image_id: r.repeated for r in got} == want and len(got) == len(want)
    assert {None, True, False} == set(want.values())
    # A look is looked up, pairs are not listed.
    assert "LeftSemi" in _plan(result) and "LeftAnti" in _plan(result)


def test_signatures_need_no_join_of_cells(spark):
    """the pixels of a picture are read and dealt out once, also where cells are missing."""
    rnd = random.Random(4)
    px = [(p, x, y, *[rnd.randrange(256) for _ in range(3)]) for p in range(5) for y in range(8) for x in range(8) if p < 4 or (x, y) != (3, 3)]
    df = spark.createDataFrame(px, "image_id int, x int, y int, r int, g int, b int")
    s = I.signatures(df, ["image_id"], 7, 8)
    grey = {(p, x, y): (r * 19595 + g * 38470 + b * 7471 + 32768) // 65536 for p, x, y, r, g, b in px}
    want = {p: sum(1 << 63 - (y * 7 + x) for y in range(8) for x in range(7) if grey.get((p, x, y), -1) > grey.get((p, x + 1, y), 999)) for p in range(5)}
    assert {r.image_id: r.h0 % 2**64 for r in s.collect()} == want
    assert _plan(s).count("Join ") == 2
