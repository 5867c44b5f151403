"""Classifier, page model, pieces and search."""

import math
import random
import zlib

import numpy as np
import pytest
from fixtures import documents, empty
from pyspark.sql import functions as F

from artkiln.llm import dom, passages, pieces, pivot_search
from artkiln.llm.registry import QUERIES, vocabulary

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_documents(spark):
    scored = QUERIES["op4_attention_mil"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in rows)
    assert len(rows) > 50 and right >= 0.95 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.collect())


def test_classifier_takes_odd_rows(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 0, 0), (6, 1, None), (None, 1, 0), (500, None, 0)], "doc_id long, quality int, toxic int")
    model = passages.fit(df, labels)
    assert passages.score(df, model).count() == df.count()
    none = passages.fit(df, labels.limit(0))
    assert {r.score for r in passages.score(df, none).collect()} == {0.5}
    assert passages.score(empty(spark), model).count() == 0 and passages.select_good(df, none).count() == df.count()
    assert passages.select_good(df, none).columns == df.columns


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["", "one two", "\n\n", "a " * 200, "x$$$ y%%%\nZ", "  lead", "é ñ 梦"]
    together, first = passages.features(texts)
    edges = [*first.tolist(), len(together)]
    for t, a, b in zip(texts, edges, edges[1:]):
        assert np.allclose(together[a:b], passages.features([t])[0])


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, passages.N_FEATURES))
    first = np.arange(0, 300, 3)
    y = (np.maximum.reduceat(x[:, 0], first) > 0.8).astype(float)  # one telling passage makes the document
    model = passages.train(x, first, y, steps=400)
    assert ((model.forward(x, first)["score"] > 0.5) == (y > 0.5)).mean() > 0.95


def brute_marginals(model, nodes):
    import itertools
    import math

    odds = [sum(model.clue.get(c, 0.0) for c in dom.clues(v)) for v in nodes]
    odds[0] = math.log(1e-9)
    total, of = 0.0, [0.0] * len(nodes)
    for s in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(sum(o for o, k in zip(odds, s) if k) + sum(model.edge[s[v.parent]][s[i]] for i, v in enumerate(nodes) if i))
        total += w
        for i, k in enumerate(s):
            of[i] += w * k
    return [x / total for x in of]


def test_quotes_open_values_after_equals_signs_only():
    def read(page):
        nodes, flow = dom.parse(page)
        return [v.tag for v in nodes[1:]], [x for _, x in flow if x.strip()]

    assert read("<p title=don't>It's here, a long paragraph.</p>") == (["p"], ["It's here, a long paragraph."])
    assert read("""<p><img alt=5"><p>After "it".</p>""") == (["p", "p"], ['After "it".'])
    assert read("""<p title = "a > b" class='c > d' id=x=">">text</p>""") == (["p"], ['">text'])
    assert read("""<p title="a > b" class='c > d'>text</p>""") == (["p"], ["text"])
    assert read("""<p "' title=a>It's "so"</p>""") == (["p"], ["""It's "so\""""])


def test_marginals_are_exact():
    model = dom.trained()
    for html in ("<div class=ad><p>x y z<ul><li>a<li>b</ul></div><article><p>hello there<div>x</div></article>", "<p>a<p>b", ""):
        nodes, _ = dom.parse(html)
        got, _ = model.marginals(nodes, [dom.clues(v) for v in nodes])
        assert np.allclose(got, brute_marginals(model, nodes))


@pytest.mark.parametrize("html,text", [
    ("<html><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy now, pay later.</div><article><h1>A  title</h1><p><b>First &amp; last<br><p>Second\n line&nbsp;here</p></article><footer>&copy; us</footer>", "A title\nFirst & last\nSecond line here"),
    ("<body><header><a href=/>Home</a></header><article><h1>T</h1><p>Some words of the text, and more.</p></article><section class='comments'><p>Nice post</p></section><form><p>Your mail</p></form><script>var x='</p><p>no</p>'</script></body>", "T\nSome words of the text, and more."),
    ("<article><p>cut off in the mid &am", "cut off in the mid &am"), ("<article><p>a &lt; b</p></artic", "a < b"), ("", ""), ("<!-- x", ""),
])
def test_pages(html, text):
    assert dom.trained().extract(html) == text


def test_extraction_takes_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<article><p>" + "word " * 50000 + "</article>", "t")], "page_id long, url string, html string, text string")
    got = dom.extract(df, dom.trained()).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 249999]
    assert dom.extract(df.limit(0), dom.trained()).count() == 0


def brute_pieces(model, text):
    n = len(text)
    score, back = [0.0] + [-1e300] * n, [(0, -1)] * (n + 1)
    for end in range(1, n + 1):
        score[end], back[end] = score[end - 1] + model.unknown, (end - 1, -1)
        for start in range(end):
            found = model.piece.get(text[start:end])
            if found and (score[start] + found[0] > score[end] or (score[start] + found[0] == score[end] and start < back[end][0])):
                score[end], back[end] = score[start] + found[0], (start, found[1])
    out, end = [], n
    while end:
        start, i = back[end]
        out = ([i] if i >= 0 else [model.byte_id[b] for b in text[start:end].encode()]) + out
        end = start
    return out


def test_streaming_search_is_the_whole_search():
    model, rng = pieces.PieceModel(vocabulary("piece_bpe_32k.model")), random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice(["the", "in", "g", " ", " ", "  ", "\n", "é", "梦", "▁", "tion", "ab", "x"]) for _ in range(rng.randrange(160)))
        want = brute_pieces(model, " " + text) if text else []
        assert list(model.stream(" " + text) if text else []) == want
        (ids,) = model.encode([text])
        assert np.frombuffer(ids, "<i4").tolist() == want and model.decode(want) == text


def test_pieces_take_odd_rows_and_round_trip(spark):
    df, file = documents(spark), vocabulary("piece_bpe_32k.model")
    got = pieces.encode(df, file)
    rows = got.collect()
    assert len(rows) == df.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    assert sorted(r.text for r in pieces.decode(got, file).collect()) == sorted(r.text or "" for r in df.collect())
    assert pieces.encode(empty(spark), file).count() == 0


def test_search_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK", 16)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(pivot_search, "GROUP", 2)
    rng = random.Random(4)
    same = [0.25] * 8
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)] if i % 3 else same, "x") for i in range(120)]
    rows += [(200, None, "x"), (201, [], "x"), (202, [None] * 8, "x"), (203, [float("nan")] * 8, "x"), (204, [float("inf")] + [0.0] * 7, "x"), (205, [1.0, 2.0], "x"), (210, [1.0, 3.0], "x"), (None, same, "x"), (206, [0.0] * 8, "x"), (206, [0.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    whole = [(r.vec_id, r.v) for r in pivot_search.whole_vectors(df).collect()]
    want = set()
    for q, v in dict(sorted(whole, key=lambda x: x[1], reverse=True)).items():
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = pivot_search.top_k(df, F.col("vec_id") % 5 == 0, 5).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert pivot_search.top_k(df.limit(0), F.col("vec_id") % 5 == 0, 5).count() == 0


@pytest.mark.parametrize("sizes", [[1.0, 7e4, 1e6], [1.0, 7e4, 3e9, 1e20, 3e38]])
def test_search_keeps_vectors_of_any_finite_size(spark, sizes):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) * sizes[i % len(sizes)] for _ in range(4)]) for i in range(48)] + [(60, [65536.0, 0.0, 0.0, 0.0]), (61, [-sizes[-1]] * 4), (62, [0.5] * 4), (65, [float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in df.collect() if r.vec_id != 65]
    want = set()
    for q, v in whole:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:5]
            want |= {(q, k + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for k, (s, i) in enumerate(best)}
    got = pivot_search.top_k(df, F.col("vec_id") % 5 == 0, 5).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {r.query_id for r in got} >= {0, 5, 60}
    assert any((r.score is None) if sizes[-1] > 1e9 else (r.score > 1 << 53) for r in got)
    keys = [-(1 << 90), -(1 << 64), -257, -256, -1, 0, 1, 255, 256, 1 << 64, 1 << 90]
    assert sorted(keys, key=pivot_search.sort_key) == keys
