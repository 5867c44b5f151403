"""WARC archives, shards, packed sequences and the pipeline."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from fixtures import documents, empty
from pyspark.sql import functions as F

from artkiln.llm import packing, sharding, warc
from artkiln.llm.registry import vocabulary


def pages(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, "u3", None), (4, None, ""), (5, "u 5", "é" * 70000), (6, "u6", "same"), (6, "u6", "same"), (None, "u", "other"), (-7, "u7", "same")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_archives_give_back_every_record(spark):
    got = warc.read(warc.write(pages(spark))).collect()
    assert len(got) == 9 and not any(r.error for r in got)
    same = {r.page_id: (r.record_type, r.refers_to) for r in got if r.payload_digest == warc.base32_sha1(b"same")}
    assert same == {-7: ("response", None), 1: ("revisit", -7), 2: ("revisit", -7), 6: ("revisit", -7)}
    none = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got if r.payload_bytes == 0}
    assert none == {3: ("response", None, 0), 4: ("revisit", 3, 0)}
    assert next(bytes(r.payload) for r in got if r.page_id == 5) == ("é" * 70000).encode()
    assert warc.read(warc.write(pages(spark).limit(0))).count() == 0


def test_rows_of_one_page_id_keep_their_own_payloads(spark):
    """Each row of a repeated id is a record with the verdict of its payload, and every payload is in an archive."""
    rows = [(1, "AAA"), (2, "BBB"), (5, "AAA"), (5, "CCC"), (6, "AAA"), (6, "BBB"), (6, "BBB"), (7, None)]
    got = warc.read(warc.write(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string"))).collect()
    first = {}
    for i, h in rows:
        first.setdefault(h or "", i)
    want = [(i, warc.base32_sha1((h or "").encode()), None if first[h or ""] == i else first[h or ""]) for i, h in rows]
    assert sorted(str((r.page_id, r.payload_digest, r.refers_to)) for r in got) == sorted(map(str, want))
    assert {r.payload for r in got if r.record_type == "response"} == {b"AAA", b"BBB", b"CCC", b""}


def test_reading_takes_time_in_proportion(spark):
    """Thousands of small records in one archive, and one as large as many slices."""
    records = [b"%d " % i * 20 for i in range(5000)] + [bytes(range(256)) * 2000, b""]
    assert list(warc.frames(warc.write_archive(records, records[:200]))) == records


def test_archive_files_and_damage(spark, tmp_path):
    records = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 50, warc.base32_sha1(b"payload %d " % i * 50), len(b"payload %d " % i * 50), None) for i in range(300)]
    whole = warc.write_archive(records, records[:200])
    assert list(warc.frames(whole)) == records
    (tmp_path / "a.warc.zst").write_bytes(whole)
    (tmp_path / "b.warc.zst").write_bytes(b"".join(map(zstandard.ZstdCompressor().compress, records[:3])))  # without a dictionary
    (tmp_path / "c.warc.zst").write_bytes(whole[:-5])
    (tmp_path / "d.warc.zst").write_bytes(warc.write_archive([records[0].replace(b"payload 0 p", b"payload 1 p", 1), b"no header", records[1]], records[:1]))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    read = {k: warc.read(files.filter(F.col("path").endswith(f"{k}.warc.zst"))).collect() for k in "abcd"}
    assert sorted(r.page_id for r in read["a"]) == list(range(300)) and len(read["b"]) == 3
    assert sum(r.error is None for r in read["c"]) == 299 and [r.error for r in read["c"] if r.error][0].startswith("archive")
    assert [r.page_id for r in read["d"]] == [None, None, 1]
    with pytest.raises(ValueError):
        warc.parse(records[0][:-1])


def shards_of(rows, limit):
    h = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16)

    def split(group, depth):
        if sum(n for _, n in group) <= limit or len({k for k, _ in group}) == 1:
            return {k: (format(h(k), "060b")[:depth], depth) for k, _ in group}
        sides = [[x for x in group if h(x[0]) >> (59 - depth) & 1 == bit] for bit in (0, 1)]
        return {k: v for g in sides if g for k, v in split(g, depth + 1).items()}

    return split(rows, 0)


@pytest.mark.parametrize("limit", [100, 700, 10**9])
def test_shards(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(sharding, "SPARE_BITS", 0)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    rows = [(i, (i * 37) % 90) for i in range(200)] + [(900, 5000), (901, None), (5, 40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n long, shard string")
    got = sharding.shard(df, F.col("doc_id"), F.col("n"), limit)
    want = shards_of([(i, n or 0) for i, n in rows], limit)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.fits == (r.shard_bytes <= limit)
        assert r.shard == want[r.doc_id][0] if r.fits else want[r.doc_id][0].startswith(r.shard) or r.shard.startswith(want[r.doc_id][0])
    assert sum(r.n or 0 for r in out if r.shard == out[0].shard) == out[0].shard_bytes
    if limit == 700:
        sharding.write_shards(got, str(tmp_path / "s"))
        assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)
    assert sharding.shard(df.limit(0), F.col("doc_id"), F.col("n"), limit).count() == 0


def test_plan_uses_every_length_once():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 5000):
        counts = np.bincount(np.minimum(2047, rng.geometric(1 / 500, n)), minlength=2049)
        made = packing.plan(counts)
        used = np.zeros(2049, np.int64)
        for lens, k in made:
            assert sum(lens) <= 2048 and k > 0
            for v in lens:
                used[v] += k
        assert (used == counts).all()
        bins = sum(k for _, k in made)
        assert bins <= sum(k for _, k in packing.best_fit(counts)) and bins <= -(-int((counts * np.arange(2049)).sum()) // 2048) * 1.01 + 1


def test_units_encode_as_whole_texts_do():
    import random

    from tokenizers import Tokenizer

    file, rng = vocabulary("byte_bpe_50k.json"), random.Random(3)
    whole, ours = Tokenizer.from_file(file), packing.ByteTokenizer(file)
    texts = ["".join(rng.choice(["the", "in", "g", " ", " ", "  ", "\n", "é", "梦", ".", "'s", "'", "12", "x", "\n\n", "%%%", "_", "don't", "\t", "²", "-", "<|endoftext|>"]) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for some in (texts, [t.replace("<|endoftext|>", "") for t in texts]):
        ids, sizes = ours.encode(pa.array(some))
        for t, n, end in zip(some, sizes, np.cumsum(sizes)):
            assert ids[end - n : end].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_units_are_encoded_anew_when_forgotten():
    from tokenizers import Tokenizer

    file = vocabulary("byte_bpe_50k.json")
    whole, ours = Tokenizer.from_file(file), packing.ByteTokenizer(file, bound=3)
    for text in ("a few words here", "", "others\n\n follow, then　wide spaces", "a few words here"):
        ids, sizes = ours.encode(pa.array([text, None or text]))
        assert ids.tolist() == 2 * whole.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids) // 2] * 2


def check_packed(df, got, file):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(file), []
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        starts = [0, *range(n if n <= 2048 else n % 2048 or 2048, n, 2048)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
            want.append((str(r.doc_id), k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by), sum(x[3] for x in want)


def test_packing(spark):
    df, file = documents(spark), vocabulary("byte_bpe_50k.json")
    bins, tokens = check_packed(df, packing.pack(df.repartition(3), file).collect(), file)
    assert bins >= -(-tokens // 2048)
    assert packing.pack(empty(spark), file).count() == 0


def test_pipeline_against_stages_by_hand(spark, tmp_path):
    import corpus_pipeline
    from test_dedup import removed, shingles

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name != "pack":
            assert docs.columns == columns
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r.doc_id for r in after}
            judged = [(labels[r.doc_id] == 1) == (r.doc_id in kept) for r in before if r.doc_id in labels]
            assert sum(judged) >= 0.95 * len(judged)
        if name == "near_dedup":
            sets = {r.doc_id: shingles(r.text, 5) for r in before}
            label = {i: i for i in sets}
            changed = True
            while changed:
                changed = False
                for a, x in sets.items():
                    for b, y in sets.items():
                        if x and y and label[a] != label[b] and 100 * len(x & y) >= 80 * len(x | y):
                            label[a] = label[b] = min(label[a], label[b])
                            changed = True
            assert sorted(r.doc_id for r in after) == sorted(i for i in sets if label[i] == i)
        if name == "passage_dedup":
            want = {i: (n, gone) for i, n, gone, _, _ in removed([(r.doc_id, r.text.encode()) for r in before])}
            assert all(abs(len(r.text.encode()) - (want[r.doc_id][0] - want[r.doc_id][1])) <= 6 * want[r.doc_id][1] and r.n_chars == len(r.text) for r in after)
            assert {i for i, (n, gone) in want.items() if gone == 0} <= {r.doc_id for r in after}
            left = {r.doc_id: r for r in after}
        if name == "pack":
            assert {r.doc_id for r in after} == set(left)
