"""Removal of repeated passages with longest-previous-factor arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id. In suffix order, equal strings of that length are
neighbours, so a suffix has such an earlier match exactly if its previous or
its next smaller document in suffix order shares ``length`` bytes with it: the
longest-previous-factor array, cut at that length.

One suffix array over a corpus would not be a Spark job. Every string of
``length`` bytes has a minimizer, the least hash of the GRAM-byte strings in
it, and equal strings have equal minimizers. So:

1. texts are packed into chunks of bounded size, written once;
2. each chunk sends the distinct hashes of its minimizers, with how many of
   its documents have them, and learns which occur in two documents or more;
3. the stretches of text under those minimizers go to the bucket of the hash.
   Equal stretches of a chunk go once, for their smallest document: the others
   are settled where they are. A hash of very many documents is not sent to
   one bucket: its strings are, each by its own hash;
4. each bucket builds the sparse suffix array of its stretches and finds the
   earlier matches, and what they cover goes back to the chunks.

Whole copies of an earlier text are found first, by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import staged
from .units import forget

LENGTH, GRAM = 50, 20
#: Bytes of text in a chunk; chunks for each bucket; documents from which a hash is spread over buckets; windows sorted at once.
CHUNK, CHUNKS_A_BUCKET, HOT, AT_ONCE = 2 << 20, 4, 5000, 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNKS = "chunk long, doc_ids binary, sizes binary, digests binary, text binary, rest binary"
_SENT = "bucket int, chunk long, body binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; their types are known to the reader."""
    body = b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(body: bytes, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for kind in map(np.dtype, kinds):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * kind.itemsize
    return out


def chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts in the order they are read, packed up to `size` bytes, with the columns to carry along; a null text is empty, a null id the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        part, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        raw: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        held = 0

        def closed() -> pa.RecordBatch:
            digests = b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in raw)
            sink = pa.BufferOutputStream()
            if carry:
                with pa.ipc.new_stream(sink, rest[0].schema) as out:
                    for x in rest:
                        out.write_batch(x)
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([(part << 32) + made], pa.int64()), "doc_ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "sizes": pa.array([np.array([len(x) for x in raw], np.int64).tobytes()], pa.binary()),
                "digests": pa.array([digests], pa.binary()), "text": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(raw))], pa.binary()), "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            begin, other = 0, batch.select([f"rest{i}" for i in range(len(carry))])
            for i, (doc_id, x) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()))):
                ids.append(doc_id)
                raw.append(x.as_py())
                held += len(raw[-1])
                if held >= size:
                    rest.append(other.slice(begin, i + 1 - begin))
                    yield closed()
                    ids, raw, rest, held, made, begin = [], [], [], 0, made + 1, i + 1
            rest.append(other.slice(begin))
        if ids:
            yield closed()

    rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                            *[F.col(f"`{c}`").alias(f"rest{i}") for i, c in enumerate(carry)])
    return rows.mapInArrow(run, _CHUNKS)


class Chunk:
    """A chunk's bytes, documents and minimizers."""

    def __init__(self, doc_ids: bytes, sizes: bytes, text: bytes) -> None:
        self.doc_ids, self.sizes = np.frombuffer(doc_ids, np.int64), np.frombuffer(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first string start, number of strings, document number) of each minimizer with the strings it is least in."""
        none = np.zeros(0, np.int64)
        if len(self.data) < LENGTH:
            return none.astype(np.uint64), none, none, none
        hashes, span = gram_hashes(self.data), LENGTH - GRAM + 1
        starts = np.arange(len(self.data) - LENGTH + 1)
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[: len(starts)]
        inside = starts + LENGTH <= self.ends[doc]
        least = _slide(hashes, span, np.minimum)
        # Consecutive strings with one and the same least hash form a stretch; it is cut where a document ends or span strings are full.
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        heads = np.flatnonzero(fresh & inside)
        stops = np.flatnonzero(np.concatenate([(fresh | ~inside)[1:], [True]]) & inside) + 1
        sizes = stops - heads
        pieces = -(-sizes // span)
        first = np.repeat(heads, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * span
        many = np.minimum(span, np.repeat(stops, pieces) - first)
        return _mixed(least[first]), first, many, doc[first]

    def distinct(self, skip: np.ndarray | None = None) -> tuple:
        """Sorted distinct hashes with their document counts, and the minimizers they come from."""
        hashes, first, many, doc = self.minimizers()
        if skip is not None and len(skip):
            keep = ~np.isin(doc, skip)
            hashes, first, many, doc = hashes[keep], first[keep], many[keep], doc[keep]
        order = np.lexsort((doc, hashes))
        h, d = hashes[order], self.doc_ids[doc[order]]
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        other = fresh.copy()
        other[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(fresh)
        count = np.add.reduceat(other, at) if len(at) else at
        return h[at], count, (hashes, first, many, doc)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of `width` values, by doubling."""
    step = 1
    while 2 * step <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """48-bit hashes of all GRAM-byte strings, polynomial by doubling and then mixed."""
    powers, step, parts = _WORD[data], 1, []
    multiplier = _MULTIPLIER
    left = GRAM
    while left:
        if left & 1:
            parts.append((step, powers, multiplier))
        left >>= 1
        if left:
            powers = powers[:-step] * np.uint64(multiplier) + powers[step:]
            multiplier = multiplier * multiplier % (1 << 64)
            step *= 2
    at, out = 0, None
    n = len(data) - GRAM + 1
    for size, value, m in parts:
        piece = value[at : at + n]
        out = piece if out is None else out * np.uint64(m) + piece
        at += size
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(29))) >> np.uint64(16)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """The hashes dealt anew, one to one, over 48 bits: the least of many hashes are nearly all small, and buckets are ranges."""
    low = np.uint64((1 << 48) - 1)
    x = hashes * np.uint64(0xC2B2AE3D27D5) & low
    x ^= x >> np.uint64(25)
    x = x * np.uint64(0x9FB21C651E99) & low
    return x ^ (x >> np.uint64(23))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so that sorted hashes are sent as small differences."""
    return ((hashes >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask(found: DataFrame, buckets: int) -> DataFrame:
    """Of each chunk, to each bucket: its distinct hashes and their document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, count, _ = Chunk(row["doc_ids"], row["sizes"], row["text"]).distinct()
                some, begins = np.unique(_bucket(hashes, buckets), return_index=True)
                edges, few = np.append(begins, len(hashes)), np.minimum(count, 255).astype(np.uint8)
                bodies = [_pack(np.diff(hashes[a:b], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T.copy().ravel(), few[a:b]) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "chunk": pa.array([row["chunk"]] * len(some), pa.int64()), "body": pa.array(bodies, pa.binary())})

    return found.mapInArrow(run, _SENT)


def _answer(hot: int):
    """For each sent hash: 0 in one document, 1 in several, 2 in very many."""

    def run(asked: pa.Table) -> pa.Table:
        lists, counts = [], []
        for body in asked["body"]:
            planes, count = _unpack(body.as_py(), np.uint8, np.uint8)
            wide = np.zeros((len(count), 8), np.uint8)
            wide[:, :6] = planes.reshape(6, -1).T
            lists.append(np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64))
            counts.append(count)
        hashes = np.concatenate(lists)
        unique, back = np.unique(hashes, return_inverse=True)
        total = np.bincount(back, np.concatenate(counts))
        code = ((total > 1).astype(np.uint8) + (total >= hot))[back]
        edges = np.cumsum([0, *map(len, lists)])
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "body": pa.array([_pack(code[a:b].astype(np.uint8)) for a, b in zip(edges, edges[1:])], pa.binary())})

    return run


def _copies(found: DataFrame) -> DataFrame:
    """chunk, ordinals: numbers of its documents whose whole text an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["doc_ids"], np.int64)
                digests = [row["digests"][16 * i : 16 * i + 16] for i in range(len(ids))]
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([row["chunk"]] * len(ids), pa.int64()), "ordinal": pa.array(range(len(ids)), pa.int32()), "doc_id": pa.array(ids), "digest": pa.array(digests, pa.binary())})

    each = found.select("chunk", "doc_ids", "digests").mapInArrow(run, "chunk long, ordinal int, doc_id long, digest binary")
    first = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(F.col("first") < F.col("last")).select("digest", "first")
    return each.join(first, "digest").filter(F.col("doc_id") > F.col("first")).groupBy("chunk").agg(F.sort_array(F.collect_list("ordinal")).alias("ordinals"))


def _send(buckets: int):
    """For a chunk and its answers: stretches to the buckets, and to bucket -1 what is settled within the chunk."""

    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in chunk.to_pylist():
            here = Chunk(row["doc_ids"], row["sizes"], row["text"])
            skip, codes = np.zeros(0, np.int64), {}
            for a in answers.to_pylist():
                if a["ordinals"] is not None:
                    skip = np.array(a["ordinals"], np.int64)
                else:
                    (codes[a["bucket"]],) = _unpack(a["body"], np.uint8)
            known, _, (hashes, first, many, doc) = here.distinct()
            code_of = np.concatenate([codes[b] for b in sorted(codes)]) if codes else np.zeros(0, np.uint8)
            code = code_of[np.searchsorted(known, hashes)] if len(hashes) else code_of
            code = np.where(np.isin(doc, skip), 0, code)
            whole, spread = code == 1, np.flatnonzero(code == 2)
            # Strings of very common hashes go one by one.
            single = np.repeat(first[spread], many[spread]) + np.arange(many[spread].sum()) - np.repeat(np.cumsum(many[spread]) - many[spread], many[spread])
            start, count = np.concatenate([first[whole], single]), np.concatenate([many[whole], np.ones(len(single), np.int64)])
            owner = here.doc_ids[np.concatenate([doc[whole], np.repeat(doc[spread], many[spread])])]
            wide = 2 * LENGTH - GRAM
            padded = np.concatenate([here.data, np.zeros(wide, np.uint8)])
            text = np.lib.stride_tricks.sliding_window_view(padded, wide)[start].copy()
            text[np.arange(wide) >= (count + LENGTH - 1)[:, None]] = 0
            rows = np.concatenate([text, count[:, None].astype(np.uint8)], 1)
            order = np.lexsort((owner, np.ascontiguousarray(rows).view(f"S{wide + 1}").ravel())) if len(rows) else np.zeros(0, np.int64)
            rows, start, count, owner = rows[order], start[order], count[order], owner[order]
            bucket = np.concatenate([_bucket(hashes[whole], buckets), np.full(len(single), -1)])[order]
            part = np.concatenate([hashes[whole], np.zeros(len(single), np.uint64)]).astype(np.uint16)[order]
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:] != rows[:-1]).any(1)
            group = np.cumsum(fresh) - 1
            heads = np.flatnonzero(fresh)
            mine = owner == owner[heads][group] if len(heads) else np.zeros(0, bool)
            out.append((-1, row["chunk"], _pack(start[~mine], count[~mine])))
            uses = np.bincount(group[mine], minlength=len(heads))
            places = start[mine]
            bucket, part = bucket[heads], part[heads]
            lone = bucket < 0
            if lone.any():
                strings = np.ascontiguousarray(rows[heads[lone], :LENGTH])
                own = np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little") for x in strings], np.uint64)
                bucket[lone], part[lone] = (own >> np.uint64(16)) % np.uint64(buckets), own.astype(np.uint16)
            # Everything in the order of the buckets, once; each bucket then takes a slice.
            begins, order = np.cumsum(uses) - uses, np.argsort(bucket, kind="stable")
            heads, uses, begins, bucket, part = heads[order], uses[order], begins[order], bucket[order], part[order]
            ends = np.cumsum(uses)
            places = places[np.repeat(begins - (ends - uses), uses) + np.arange(len(places))]
            rows, owner = rows[heads], owner[heads]
            some, at = np.unique(bucket, return_index=True)
            for b, i, j in zip(some.tolist(), at, np.append(at[1:], len(bucket))):
                out.append((b, row["chunk"], _pack(rows[i:j].ravel(), owner[i:j], uses[i:j], places[ends[i] - uses[i] : ends[j - 1]], part[i:j])))
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"bucket": pa.array(cols[0], pa.int32()), "chunk": pa.array(cols[1], pa.int64()), "body": pa.array(cols[2], pa.binary())})

    return run


def earlier(strings: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which suffixes, given by their first LENGTH bytes and their document, have a longest previous factor of LENGTH.

    Neighbours in suffix order with LENGTH bytes in common form a run; within
    it, a suffix has an earlier match if a smaller document stands before it
    (previous smaller position) or after it (next smaller position).
    """
    n = len(strings)
    if not n:
        return np.zeros(0, bool)
    flat = np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel()
    array = np.argsort(flat, kind="stable")
    ordered = flat[array]
    run = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])).astype(np.int64)
    rank = np.unique(owner, return_inverse=True)[1].astype(np.int64)[array]
    step = n + 1
    previous = np.minimum.accumulate(rank - run * step) + run * step
    following = (np.minimum.accumulate((rank + run * step)[::-1])[::-1]) - run * step
    found = np.zeros(n, bool)
    found[array] = (previous < rank) | (following < rank)
    return found


def _match(sent: pa.Table) -> pa.Table:
    """Strings with an earlier match, as (start, number) of neighbouring strings, for each chunk.

    Equal strings have equal parts, so a bucket is sorted part by part where it is large.
    """
    if sent["bucket"][0].as_py() < 0:
        return sent.select(["chunk", "body"])
    wide = 2 * LENGTH - GRAM
    lists: list[list[np.ndarray]] = []
    names = sent["chunk"].to_pylist()
    for i, body in enumerate(sent["body"]):
        r, o, u, p, t = _unpack(body.as_py(), np.uint8, np.int64, np.int64, np.int64, np.uint16)
        lists.append([r.reshape(-1, wide + 1), o, u, p, t, np.full(len(u), i)])
    rows, owner, uses, places, part, origin = map(np.concatenate, zip(*lists))
    del lists
    begin = np.cumsum(uses) - uses
    slices = max(1, int(rows[:, wide].sum(dtype=np.int64)) // AT_ONCE)
    starts, numbers, sources = [], [], []
    for k in range(slices):
        some = np.flatnonzero(part % slices == k)
        count = rows[some, wide].astype(np.int64)
        item = np.repeat(np.arange(len(some)), count)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        strings = np.lib.stride_tricks.sliding_window_view(rows[some, :wide], LENGTH, 1)
        found = earlier(strings[item, offset], owner[some][item])
        first = found & ((offset == 0) | ~np.concatenate([[False], found[:-1]]))
        last = found & ((offset == count[item] - 1) | ~np.concatenate([found[1:], [False]]))
        at = some[item[first]]
        each = np.repeat(np.arange(len(at)), uses[at])
        place = places[np.repeat(begin[at], uses[at]) + np.arange(len(each)) - np.repeat(np.cumsum(uses[at]) - uses[at], uses[at])]
        starts.append(place + offset[first][each])
        numbers.append((offset[last] - offset[first] + 1)[each])
        sources.append(origin[at][each])
    start, number, source = map(np.concatenate, (starts, numbers, sources))
    order = np.argsort(source, kind="stable")
    edges = np.searchsorted(source[order], np.arange(len(names) + 1))
    bodies = [_pack(start[order[a:b]], number[order[a:b]]) for a, b in zip(edges, edges[1:])]
    return pa.table({"chunk": pa.array(names, pa.int64()), "body": pa.array(bodies, pa.binary())})


def _keep(found: pa.Table, here: Chunk) -> Iterator[tuple[int, int, int, bytes]]:
    """(bytes, bytes removed, runs removed, what is left) of each document of a chunk."""
    edge = np.zeros(len(here.data) + 1, np.int32)
    begins = here.ends - here.sizes
    for a in found.to_pylist():
        if a["ordinals"] is not None:
            gone = np.array(a["ordinals"], np.int64)
            gone = gone[here.sizes[gone] >= LENGTH]
            np.add.at(edge, begins[gone], 1)
            np.add.at(edge, here.ends[gone], -1)
        else:
            start, number = _unpack(a["body"], np.int64, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + number + LENGTH - 1, -1)
    removed = np.cumsum(edge[:-1]) > 0
    for a, b in zip(begins.tolist(), here.ends.tolist()):
        mask = removed[a:b]
        n = int(mask.sum())
        yield b - a, n, int((mask[1:] & ~mask[:-1]).sum() + mask[0]) if n else 0, (here.data[a:b][~mask] if n else here.data[a:b]).tobytes()


def _digests(chunk: pa.Table, found: pa.Table) -> pa.Table:
    out: list[tuple] = []
    for row in chunk.to_pylist():
        here = Chunk(row["doc_ids"], row["sizes"], row["text"])
        for doc_id, (n, gone, spans, kept) in zip(here.doc_ids.tolist(), _keep(found, here)):
            out.append((None if doc_id == (1 << 63) - 1 else doc_id, n, gone, spans, hashlib.sha256(kept).hexdigest()))
    cols = list(zip(*out)) if out else [[]] * 5
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols)})


def _texts(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """The carried columns of each document, with n_removed and what is left as text; a character cut in two is left out."""
    out = []
    for row in chunk.to_pylist():
        kept = list(_keep(found, Chunk(row["doc_ids"], row["sizes"], row["text"])))
        rest = pa.ipc.open_stream(row["rest"]).read_all()
        out.append(rest.append_column("n_removed", pa.array([k[1] for k in kept], pa.int64())).append_column("left", pa.array([k[3].decode("utf-8", "ignore") for k in kept], pa.string())))
    return pa.concat_tables(out)


def _covered(found: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """The chunks, and what is found repeated in each: strings with earlier matches, and whole copies."""
    buckets = max(8, found.select("chunk").count() // CHUNKS_A_BUCKET)
    copies = staged(_copies(found), "whole-copies").withColumn("bucket", F.lit(None).cast("int")).withColumn("body", F.lit(None).cast("binary"))
    plain = found.select("chunk", "doc_ids", "sizes", "text")
    asked = _ask(plain, buckets).groupBy("bucket").applyInArrow(_answer(hot), "chunk long, bucket int, body binary")
    answers = asked.withColumn("ordinals", F.lit(None).cast("array<int>")).unionByName(copies)
    sent = plain.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_send(buckets), _SENT)
    spread = F.when(F.col("bucket") < 0, F.col("chunk")).otherwise(F.col("bucket"))  # what is settled needs no meeting place
    matched = sent.withColumn("to", spread).groupBy("bucket", "to").applyInArrow(lambda t: _match(t), "chunk long, body binary")
    return plain, matched.withColumn("ordinals", F.lit(None).cast("array<int>")).unionByName(copies.select("chunk", "body", "ordinals"))


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Rows that repeat an id are not earlier than each other, so they take
    nothing from one another. An empty table gives no rows.
    """
    plain, cover = _covered(staged(chunks(documents, key, text, chunk_bytes), "text-chunks"), hot)
    return plain.groupBy("chunk").cogroup(cover.groupBy("chunk")).applyInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK, hot: int = HOT) -> DataFrame:
    """All columns of documents, the text without its repeated strings; rows of which only white space is left go."""
    carry = tuple(c for c in documents.columns if c != text)
    found = staged(chunks(documents, key, text, chunk_bytes, carry), "text-chunks")
    _, cover = _covered(found, hot)
    schema = ", ".join([*[f"rest{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)], "n_removed long", "left string"])
    rows = found.select("chunk", "doc_ids", "sizes", "text", "rest").groupBy("chunk").cogroup(cover.groupBy("chunk")).applyInArrow(_texts, schema)
    rows = rows.filter((F.col("n_removed") == 0) | F.col("left").rlike(r"\S"))
    return rows.select(*[F.col("left").alias(c) if c == text else F.col(f"rest{carry.index(c)}").alias(c) for c in documents.columns])
