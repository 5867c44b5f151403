"""Packing token sequences by length patterns fitted with non-negative least squares.

Lengths, not documents, are what is packed. Patterns of one to three lengths
that fill a sequence exactly are enumerated, repeat counts are fitted to the
histogram of lengths, rounded, and what they leave over is packed best fit
first. The histogram and the patterns are bounded by the sequence length, so
that part runs on the driver whatever the corpus. Documents then take the
places that their length has, by rank: a running count within the task that
cut them plus the counts of the tasks before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import staged, texts
from .units import remembered, slices

SEQUENCE, END_ID = 2048, 0
#: Steps of the projected gradient.
FIT_STEPS = 300
#: Distinct units remembered by a worker, and bytes of text encoded at once.
UNITS, GROUP = 1_000_000, 4 << 20
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


#: Kinds of bytes: white space, ASCII letter, other printable ASCII sign, and first byte of a character that may be white space.
_WHITE, _LETTER, _SIGN, _RISKY = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(9, 14), *range(28, 33)]] = _WHITE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = _RISKY


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Marks bytes of UTF-8 text before which the pre-tokenizer always starts a new word, whatever surrounds them.

    A space between two characters that are no white space, a line end after
    such a character, a character after a lone line end, and a sign after a
    letter. Where a neighbour may be white space beyond ASCII, no mark is set.
    """
    n = len(data)
    padded = np.zeros(n + 5, np.uint8)  # four bytes before and one after
    padded[4 : n + 4] = data
    kind = _KIND[padded]
    at = lambda k: padded[4 + k : n + 4 + k]  # noqa: E731  the byte k places on
    of = lambda k: kind[4 + k : n + 4 + k]
    solid = lambda k: (of(k) != _WHITE) & (at(k - 1) != 0xC2) & ((of(k - 2) != _RISKY) | (at(k - 2) == 0xC2))  # noqa: E731  a character that is no white space ends k places on
    begins = (of(0) & (_WHITE | _RISKY)) == 0
    after = solid(-1)
    starts = (at(0) == 32) & after & ((of(1) & (_WHITE | _RISKY)) == 0)
    starts |= (at(0) == 10) & after
    starts |= (at(-1) == 10) & solid(-2) & begins
    starts |= (of(0) == _SIGN) & ((of(-1) == _LETTER) | ((at(-2) == 0xC3) & (at(-1) != 0x97) & (at(-1) != 0xB7)))
    return starts


class ByteTokenizer:
    """Ids of whole texts.

    A group of texts is cut, as bytes, at places where the vocabulary's
    pre-tokenizer always starts a new word. Arrow numbers the distinct units;
    only those not yet known are encoded, and the ids of the texts are
    gathered from the known ones by array operations.
    """

    def __init__(self, file: str, bound: int = UNITS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bound, self.known = bound, remembered()
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.begin, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _apart(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> None:
        """Units without white space within are encoded in one text, one a line: a lone line end between them is a word of its own."""
        plain = [u for u in units if len(u.split()) == 1 and not u[-1:].isspace() and (u[:1] == b" " or not u[:1].isspace())]
        for at in range(0, len(plain), 100_000):
            part = plain[at : at + 100_000]
            text = b"\n".join([*part, b""]).decode() + " ."
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) == len(part):
                begins = np.concatenate([[0], ends[:-1] + 1])
                self._add(part, ids, begins, ends - begins)
        rest = [u for u in units if u not in self.known]
        if rest:
            apart = self._apart([u.decode() for u in rest])
            sizes = np.array([len(x) for x in apart], np.int64)
            self._add(rest, np.concatenate(apart), np.cumsum(sizes) - sizes, sizes)

    def _add(self, units: list[bytes], ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(units)
        if last > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(max(len(x), last - len(x)), np.int64)]) for x in (self.begin, self.size))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[first:last], self.size[first:last] = begins + self.used, sizes
        self.used += len(ids)
        self.known.update(zip(units, range(first, last)))

    def encode(self, texts_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        if not self.known or len(self.known) > self.bound:
            self._clear()
        raw = texts_.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(raw), np.int64)
        body = data.tobytes()
        if any(x in body for x in self.special):  # a special token's name counts wherever it stands, so such a text is encoded whole
            whole = self._apart(texts_.to_pylist())
            return np.concatenate(whole), np.array([len(x) for x in whole], np.int64)
        starts = unit_starts(data)
        starts[offsets[:-1][offsets[:-1] < len(data)]] = True
        edges = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
        numbered = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(body)]).dictionary_encode()
        units = numbered.dictionary.to_pylist()
        place = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [units[i] for i in missing]
            self._learn(new)
            place[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        at = place[numbered.indices.to_numpy()]
        sizes, begins = self.size[at], self.begin[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1])]
        total = np.concatenate([[0], ends])[np.searchsorted(edges, offsets)]
        return ids, np.diff(total)


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(file: str) -> ByteTokenizer:
    """One for each worker and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if file not in _TOKENIZERS:
        _TOKENIZERS[file] = ByteTokenizer(file)
    return _TOKENIZERS[file]


def spans(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first piece of a long text may be shorter."""
    first = n if n <= sequence else n % sequence or sequence
    return [(0, first), *((s, sequence) for s in range(first, n, sequence))]


def pieces(documents: DataFrame, file: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """The pieces of every text, ids and then end_id, with the task that cut them and their rank there among equal lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokenizer(file).encode, TaskContext.get().partitionId()
        seen = [0] * (sequence + 1)
        for batch in batches:
            rows: list[tuple] = []
            for group in slices(batch, "text", GROUP):
                ids, sizes = encode(group["text"])
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
                body, at = memoryview(ids.tobytes()), 0
                for doc_id, n in zip(group["doc_id"].to_pylist(), (sizes + 1).tolist()):
                    for k, (start, length) in enumerate(spans(n, sequence)):
                        begin = 4 * (at + start)
                        rows.append((doc_id, k, start, length, zlib.crc32(body[begin : begin + 4 * length]), part, seen[length]))
                        seen[length] += 1
                    at += n
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    return texts(documents).mapInArrow(run, _PIECES)


def patterns(lengths: np.ndarray, sequence: int = SEQUENCE) -> np.ndarray:
    """Rows of one to three of the given lengths that add up to the sequence, the unused places 0."""
    have = np.zeros(sequence + 1, bool)
    have[lengths] = True
    rows = [np.array([[sequence, 0, 0]])] if have[sequence] else []
    low = lengths[lengths <= sequence // 2]
    two = low[have[sequence - low]]
    rows.append(np.stack([sequence - two, two, np.zeros_like(two)], 1))
    for a in lengths[lengths <= sequence // 3]:
        b = lengths[(lengths >= a) & (lengths <= (sequence - a) // 2)]
        b = b[have[sequence - a - b]]
        rows.append(np.stack([sequence - a - b, b, np.full_like(b, a)], 1))
    return np.concatenate(rows)


def fit(shapes: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with the least squared difference to the histogram.

    Accelerated projected gradient. Place 0 of the histogram stands for an unused place and has no weight.
    """
    size, used = len(counts), shapes.ravel()
    target = counts.astype(float)
    reach = np.bincount(used, minlength=size).astype(float)
    reach[0] = 0
    # The norm of the pattern matrix is at most its largest row sum times its largest column sum.
    rate = 1 / max(1.0, 3 * reach.max())
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        off = np.bincount(used, np.repeat(y, shapes.shape[1]), size) - target
        off[0] = 0
        nxt = np.maximum(y - rate * off[shapes].sum(1), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = np.maximum(nxt + (t - 1) / t2 * (nxt - x), 0)
        x, t = nxt, t2
    return x


def rounded(shapes: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeat counts, never more than the histogram holds, and the histogram that is left.

    Whole parts first. The fractions are then rounded as running sums, so
    that patterns of less than one repeat each get their share together.
    """
    left, taken = counts.copy(), []
    whole = np.floor(x).astype(np.int64)
    parts = np.cumsum(x - whole)
    extra = np.diff(np.floor(parts), prepend=0).astype(np.int64)
    for want in (whole, extra):
        for p in np.flatnonzero(want):
            lens = tuple(int(v) for v in shapes[p] if v)
            n = min(int(want[p]), *(int(left[v]) // lens.count(v) for v in lens))
            if n:
                for v in lens:
                    left[v] -= n
                taken.append((lens, n))
    return taken, left


def best_fit(left: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Longest lengths first, each into the fullest sequences that still take it; equal sequences are handled as one group."""
    room: list[list[list]] = [[] for _ in range(sequence + 1)]
    open_ = np.zeros(sequence + 1, bool)
    for length in range(len(left) - 1, 0, -1):
        todo = int(left[length])
        while todo:
            fits = length + int(np.argmax(open_[length:])) if open_[length:].any() else -1
            if fits < 0:
                lens, n, rest = (length,), todo, sequence - length
            else:
                held, many = room[fits].pop()
                n, rest, lens = min(todo, many), fits - length, (*held, length)
                if many > n:
                    room[fits].append([held, many - n])
                open_[fits] = bool(room[fits])
            room[rest].append([lens, n])
            open_[rest] = True
            todo -= n
    return [(lens, n) for groups in room for lens, n in groups]


def plan(counts: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) for all lengths of the histogram, each used exactly as often as it occurs."""
    lengths = np.flatnonzero(counts)
    shapes = patterns(lengths, sequence)
    if not len(shapes):
        return best_fit(counts, sequence)
    taken, left = rounded(shapes, fit(shapes, counts), counts)
    return taken + best_fit(left, sequence)


def places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the plan by length: an array of (length, first rank, first sequence, offset), and the start of each length in it."""
    rows, at = [], 0
    for lens, n in made:
        offset = 0
        for v in lens:
            rows.append((v, n, at, offset))
            offset += v
        at += n
    slots = np.array(sorted(rows), np.int64).reshape(-1, 4)
    total = np.cumsum(slots[:, 1]) - slots[:, 1]
    starts = np.searchsorted(slots[:, 0], slots[:, 0])
    slots[:, 1] = total - total[starts] if len(slots) else total
    return slots, np.searchsorted(slots[:, 0], np.arange(SEQUENCE * 2))


def pack(documents: DataFrame, file: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null text is empty and so is the end id alone. Rows that repeat, also
    whole, are packed each. An empty table gives no rows. Pieces that fill a
    sequence have negative sequence ids.
    """
    cut_ = staged(pieces(documents, file, sequence, end_id), "pieces")
    short = cut_.filter(F.col("length") < sequence)
    each = short.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    each = staged(each, "piece-counts")
    counts = np.zeros(sequence + 1, np.int64)
    for length, n in each.groupBy("length").agg(F.sum("n")).collect():  # at most one row a length
        counts[length] = n
    slots = cut_.sparkSession.sparkContext.broadcast(places(plan(counts, sequence)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begins = slots.value
        # Slots sorted by length and first rank, as one ascending key.
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(zero_copy_only=False), batch["rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            found = table[at] if len(at) else np.zeros((0, 4), np.int64)
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = short.join(firsts.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = cut_.filter(F.col("length") == sequence).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - (F.col("part").cast("long") * (1 << 40) + F.col("rank"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)
