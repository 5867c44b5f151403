"""Suffix-array removal, near copies and line rules against brute force."""

import hashlib
import math
import random

import pytest
from fixtures import DOCS, documents, empty

from artkiln.llm import bottom_k, graph, line_rules, suffix_dedup


def removed(rows):
    """(id, bytes, bytes removed, runs, digest of the rest) by looking every string up."""
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


LAST = (1 << 63) - 1


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_removal_is_that_of_brute_force(spark, hot):
    df = documents(spark).repartition(3)
    rows = [(LAST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.collect()]
    got = suffix_dedup.remove_repeats(df, chunk_bytes=4000, hot=hot).collect()
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(rows)


def test_texts_keep_their_columns_and_lose_repeats(spark):
    df = documents(spark)
    got = suffix_dedup.without_repeats(df, chunk_bytes=4000)
    assert got.columns == df.columns
    want = {i: s for i, _, _, _, s in removed([(LAST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.collect()])}
    for r in got.filter("doc_id IN (1, 2, 3, 500)").collect():
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id]
    assert suffix_dedup.without_repeats(empty(spark)).count() == suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_hashes_of_grams_depend_on_the_gram_alone():
    import numpy as np

    data = np.frombuffer(random.Random(1).randbytes(400) * 3, np.uint8)
    h = suffix_dedup.gram_hashes(data)
    assert (h[:300] == h[400:700]).all() and len(set(h[:400].tolist())) == 400


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("hot,block,values,exact", [(bottom_k.HOT, bottom_k.BLOCK, bottom_k.BLOCK_VALUES, False), (2, 5, 900, False), (bottom_k.HOT, bottom_k.BLOCK, bottom_k.BLOCK_VALUES, True), (20, 9, 900, True)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, hot, block, values, exact):
    monkeypatch.setattr(bottom_k, "BLOCK_VALUES", values)
    monkeypatch.setattr(bottom_k, "HOT", hot)
    monkeypatch.setattr(bottom_k, "BLOCK", block)
    df = documents(spark, n=90)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    sets = [(i, shingles(t, 3)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = bottom_k.near_duplicates(df, words=3, percent=85, exact=exact).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(
        (str(i), len(s), str(label.get(i)), i is None or label[i] == i) for i, s in sets)


def test_limits_of_the_estimate_and_the_exact_prefix():
    for percent in (50, 80, 85, 95, 100):
        m = round(bottom_k.least_estimate(percent) * bottom_k.SKETCH)
        tail = lambda n: sum(math.comb(64, k) * (percent / 100) ** k * (1 - percent / 100) ** (64 - k) for k in range(n))
        assert tail(m) < bottom_k.MISS and (m == 64 or tail(m + 1) >= bottom_k.MISS)
    rng = random.Random(9)
    for _ in range(300):
        x = set(rng.sample(range(400), rng.randrange(1, 60)))
        y = {v if rng.random() < 0.92 else rng.randrange(400) for v in x}
        for percent in (70, 80, 85):
            if 100 * len(x & y) >= percent * len(x | y):
                assert set(sorted(x)[: bottom_k.exact_prefix(len(x), percent)]) & set(sorted(y)[: bottom_k.exact_prefix(len(y), percent)])


def test_one_row_of_each_group_stays(spark):
    df = documents(spark)
    got = bottom_k.select_kept(df)
    assert got.columns == df.columns
    ids = [r.doc_id for r in got.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {1, 2, 3, 4, 500} <= set(ids) and 5 not in ids
    assert bottom_k.select_kept(empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(graph.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))


def repeated(words):
    n = len(words)
    at = {}
    for i in range(n - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)})


def test_repeated_windows():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randrange(0, 40))]
        assert line_rules.repeated_words(words) == repeated(words)


def test_line_rules_count_and_reject(spark):
    own = lambda i: f"text number {i} " + " ".join(f"w{i}x{k}" for k in range(30))
    foot = "Read more on our site and do not forget to subscribe to the letter that we send to everyone every single week of the year"
    rows = [(i, own(i) + "\n" + foot, "big") for i in range(40)] + [(100 + i, foot + f"\nshort {i}", "big") for i in range(30)] + [(200, None, "big"), (201, "# a | b", None), (40, own(40), "other")]
    df = spark.createDataFrame([(i, t, s, "x", "h", 1, 2) for i, t, s in rows], DOCS)
    got = {r.doc_id: r for r in line_rules.judge(line_rules.measure(df), least=20).collect()}
    assert all(got[i].kept for i in range(41))
    assert [i for i in range(100, 130) if got[i].kept] == []
    assert got[200].base_failed and got[200].n_words == 0 and not got[200].kept
    assert (got[201].n_words, got[201].word_chars, got[201].n_symbols) == (4, 4, 2)
    kept = line_rules.select_kept(df, least=20)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(41))
    assert line_rules.judge(line_rules.measure(empty(spark))).count() == line_rules.select_kept(empty(spark)).count() == 0


def test_the_first_of_many_copies_stays_and_hosts_of_any_size_have_one_limit(spark):
    text = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    rows = [(i, text(0), "few") for i in range(line_rules.LEAST_DOCS - 1)] + [(1000 + i, text(1), "many") for i in range(line_rules.LEAST_DOCS)]
    rows += [(2000 + i, text(i), "many") for i in range(2, 3000)]
    df = spark.createDataFrame([(i, t, s, "x", "h", 1, 2) for i, t, s in rows], DOCS)
    kept = {r.doc_id for r in line_rules.select_kept(df).select("doc_id").collect()}
    assert kept == {i for i, _, _ in rows} - set(range(1001, 1000 + line_rules.LEAST_DOCS))


def test_rows_that_repeat_an_id_are_one_document(spark):
    rows = [(7, " ".join(f"word{k}" for k in range(60)) + f"\nown {i}", "s") for i in range(200)]
    df = spark.createDataFrame([(i, t, s, "x", "h", 1, 2) for i, t, s in rows], DOCS)
    assert line_rules.frequent_lines(line_rules.measure(df)).count() == 0 and line_rules.select_kept(df).count() == 200


def test_frequent_lines_leave_the_texts(spark):
    rng = random.Random(11)
    foot = [" ".join(f"foot{j}w{k}" for k in range(6)) for j in range(3)]
    rows = []
    for i in range(90):
        lines = [" ".join(f"own{i}x{j}y{k}" for k in range(9)) for j in range(5)] + ["", "  "]
        lines += [rng.choice([f, f.upper(), "  " + f.replace(" ", " \t ")]) for f in foot if rng.random() < 0.6]
        rng.shuffle(lines)
        rows.append((i * 7 % 90, "\n".join(lines), rng.choice(["a", "a", "b", "c", None])))
    rows += [rows[5], (None, rows[8][1], "a"), (200, None, "a")]

    def norm(line):
        return " ".join(line.lower().split())

    holders = {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            holders.setdefault((s, norm(line)), []).append((i, t))
    often = {k: min(i for i, _ in v if i is not None) for k, v in holders.items() if k[1] and len({i for i, _ in v}) >= 20}
    want = [(i, "\n".join(x for x in t.split("\n") if often.get((s, norm(x)), i) == i), s) for i, t, s in rows if t]
    assert any(w[1] != t for w, (_, t, _) in zip(want, rows)) and any(w[1] == t for w, (_, t, _) in zip(want, rows))
    df = spark.createDataFrame([(i, t, s, "x", "h", 1, 2) for i, t, s in rows], DOCS)
    got = line_rules.select_kept(df, least=20)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert got.columns == df.columns and {(r.kept, r.host, r.print, r.value) for r in got.collect()} == {("x", "h", 1, 2)}
    assert sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=order) == sorted(want, key=order)
