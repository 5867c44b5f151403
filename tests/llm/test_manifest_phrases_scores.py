"""Merkle manifest, phrase mining and lattice scores against brute force, on tables with odd rows."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from fixtures import documents, empty
from pyspark.sql import functions as F

from artkiln.llm import lattice, merkle, phrases
from artkiln.llm.registry import vocabulary


@pytest.fixture(scope="module")
def docs(spark):
    """With languages (null, empty and a hot one), lengths (one null), clashing names, and rows that repeat whole."""
    df = documents(spark).withColumn("lang", F.expr("case when doc_id % 7 = 0 then null when doc_id % 7 = 1 then '' when doc_id % 7 = 2 then 'é' else 'en' end"))
    df = df.withColumn("n_chars", F.when(F.col("doc_id") != 9, F.char_length("text")).cast("long")).withColumns({"tree": F.lit("t"), "pos": F.lit(0), "phrase": F.lit("p"), "chunk": F.lit(1), "block": F.lit(1)})
    return df.unionByName(df.filter("doc_id in (12, 14)")).cache()


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fan):
    """Root, and of each leaf its levels of (before, after)."""
    at, ways, level = list(range(len(leaves))), [[] for _ in leaves], leaves
    while len(level) > 1:
        for w, i in zip(ways, at):
            a = i - i % fan
            w.append(("".join(level[a:i]), "".join(level[i + 1 : a + fan])))
        level, at = [digest(*level[i : i + fan]) for i in range(0, len(level), fan)], [i // fan for i in at]
    return level[0], ways


def brute_manifest(rows, fan):
    def leaf(r, more=0):
        values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
        return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    groups = {}
    for r in rows:
        tried = leaf(r, 1) if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else leaf(r)
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), tried, r.doc_id))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(groups[k])], fan) for k in names]
    root, above = brute_tree([t[0] for t in trees], fan)
    out = []
    for k, (subroot, ways), up in zip(names, trees, above):
        for (_, _, own, tried, doc_id), way in zip(sorted(groups[k]), ways):
            for b, a in way + up:
                tried = digest(b, tried, a)
            out.append((doc_id, own, subroot, root, digest(*[b + a for b, a in way + up]), tried, tried == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan, height, partitions", [(2, 2, 3), (2, 12, 5), (3, 1, 4)])
def test_manifest_against_brute_force(spark, docs, fan, height, partitions):
    got = merkle.manifest(merkle.document_leaves(docs), partitions, fan, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = got.collect()
    assert sorted(map(tuple, rows), key=str) == brute_manifest(docs.collect(), fan)
    assert not all(r.verified for r in rows) and any(r.verified for r in rows)


def test_manifest_of_no_rows_and_of_one(spark, docs):
    assert merkle.manifest(merkle.document_leaves(docs.limit(0)), 3).count() == 0
    one = docs.filter("doc_id = 12").limit(1)
    (r,) = merkle.manifest(merkle.document_leaves(one), 3).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == digest()


def brute_phrases(rows, least, top, percent):
    count, total = Counter(), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for r in rows:
        text, lang = (r.text or "").translate(lower), "und" if r.lang is None else r.lang
        for mark in ".,;:!?\n\v\f\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            count.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {p: a for p, a in count.items() if a >= least and len(p) > 2}
    out = []
    for lang in total:
        kept = []
        for (x, *p), a in found.items():
            p = tuple(p)
            inside = any(q[0] == x and len(q) - 1 > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(1, len(q))) for q, b in found.items())
            if x == lang and not inside:
                cuts = [(phrases.SCALE * a // (count[(x, *p[:k])] + count[(x, *p[k:])]), k, count[(x, *p[:k])], count[(x, *p[k:])]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least, top, reach", [(3, 5, (1, 2)), (2, 40, ())])
def test_phrases_against_brute_force(spark, docs, least, top, reach):
    got = phrases.mine(docs, least=least, top=top, reach=reach)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(docs.collect(), least, top, 80)


def test_phrases_of_no_rows(spark, docs):
    assert phrases.mine(docs.limit(0)).count() == 0 == phrases.mine(docs.filter("text is null")).count()


def test_small_frontiers_lose_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 64)  # nearly every phrase seems to be in the frontier
    assert sorted(map(tuple, phrases.mine(docs, least=3, top=5).collect())) == brute_phrases(docs.collect(), 3, 5, 80)


def brute_lattice(own, pieces, text, weights):
    piece, byte = weights
    data = b" " + text.encode() if text else b""
    forward = [-math.inf] * (len(data) + 1)
    forward[0] = 0.0
    for end in range(1, len(data) + 1):
        terms = []
        for start in range(max(0, end - 60), end):
            part = data[start:end]
            if part in pieces:
                terms.append(forward[start] + piece[pieces[part], 0])
            if len(part.decode("utf-8", "ignore")) == 1 and len(part.decode("utf-8", "ignore").encode()) == len(part):
                terms.append(forward[start] + len(part) * byte[0])
        if terms and max(terms) > -math.inf:
            forward[end] = max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
    return forward[-1]


def test_scores_against_brute_force(spark, docs):
    import sentencepiece

    file = vocabulary("piece_bpe_32k.model")
    long = spark.createDataFrame([(901, "梦" * 300 + "über" * 90 + "\n  two  spaces"), (902, "x" * 700)], "doc_id long, text string")
    df = docs.select("doc_id", "text", "chunk").unionByName(long, allowMissingColumns=True)
    rows = df.collect()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {id(r): [w.translate(lower) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] for r in rows}
    held = {id(r): r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    count = Counter(w for r in rows if not held[id(r)] for w in words[id(r)])
    ends = sum(not h for h in held.values())
    total, distinct = sum(count.values()) + ends, len(count) + 1
    own = lattice.lattice(file)
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    pieces = {model.id_to_piece(i).replace("▁", " ").encode(): k for k, i in enumerate(i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))}
    fits = {e: sum(brute_lattice(own, pieces, r.text or "", own.weights((e,))) for r in rows if not held[id(r)]) for e in lattice.EXPONENTS}
    best = max(fits, key=fits.get)
    weights = own.weights((best,), ends / total)
    got = lattice.score(df, file, chunk_bytes=3000)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = []
    for r in rows:
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) for c in [*(count[w] for w in words[id(r)]), ends])
        score = (brute_lattice(own, pieces, r.text or "", weights) + math.log(ends / total)) / math.log(10)
        want.append((str(r.doc_id), held[id(r)], len(words[id(r)]) + 1, sum(count[w] > 0 for w in words[id(r)]) + 1, total, round(base, 6), round(score, 6)))
    assert sorted((str(r.doc_id), *r[1:5], round(r.base_score, 6), round(r.score, 6)) for r in got.collect()) == sorted(want)


def test_lattice_is_a_distribution_and_learns(spark):
    """Mass 1 over pieces, bytes and the end; over the strings that two pieces spell; nothing for an empty table."""
    import numpy as np

    own = lattice.Lattice.__new__(lattice.Lattice)
    own._set([b"a", b"b", b"ab", b" a"], np.array([1.0, 2.0, 3.0, 4.0]))
    piece, byte = own.weights((0.7, 1.1), end=0.2)
    assert np.allclose(np.exp(piece).sum(0) + 256 * np.exp(byte) + 0.2, 1)
    import pyarrow as pa

    one, two = (np.exp(own.marginals(pa.array([x], pa.binary()), (piece, byte)))[0] for x in (b"a", b"ab"))
    p, b = np.exp(piece), np.exp(byte)
    assert np.allclose(one, p[0] + b) and np.allclose(two, p[2] + (p[0] + b) * (p[1] + b))
    assert lattice.score(empty(spark), vocabulary("piece_bpe_32k.model")).count() == 0


def test_held_out_scores_stay_near_the_base(spark, tmp_path):
    """on held-out texts the model may pay for case, white space and the spelling of new words, no more."""
    from artkiln.llm import registry

    rng = random.Random(3)
    stems = ["".join(rng.choice(["th", "ea", "re", "on", "ing", "er", "tion", "st", "nd", "ou"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(stems).capitalize() if k % 9 == 0 else rng.choice(stems[: 1 + rng.randrange(300)]) for k in range(120)) + f".\nNew{i} zq\t x  y\n") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, "a row without an id"), (1003, "ÜBER 梦" * 90), (1004, "x" * 700)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op13_lattice_scores"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.score is not None and math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and sum(r.score for r in held) > 1.4 * sum(r.base_score for r in held)


def test_learned_weights_and_arcs_are_a_distribution():
    """Expected uses against the listed segmentations of a unit, and mass 1 over pieces, bytes and the end of a unit."""
    import numpy as np
    import pyarrow as pa

    own = lattice.Lattice.__new__(lattice.Lattice)
    own._set([b"a", b"b", b"ab"], np.array([1.0, 2.0, 3.0]))
    piece, byte = own.weights((1.0,))
    p, b = np.exp(piece[:, 0]), np.exp(byte[0])
    whole = p[2] + (p[0] + b) * (p[1] + b)
    want = [p[0] * (p[1] + b) / whole, p[1] * (p[0] + b) / whole, p[2] / whole]
    assert np.allclose(own.uses(pa.array([b"ab"], pa.binary()), (piece, byte)), want)
    assert np.allclose(own.uses(pa.array([b"ab" * 300, b"ab"], pa.binary()), (piece, byte)).sum() > 300, True)
    piece, byte = own.learned(np.array([4.0, 0.0, 9.0]), 0.8)
    assert np.allclose(np.exp(piece).sum() + 256 * np.exp(byte[0]), 0.8)
