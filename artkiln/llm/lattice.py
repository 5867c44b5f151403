"""Language-model scoring by the likelihood of a subword lattice.

All segmentations of a text into pieces of an existing vocabulary form a
lattice. Its scores weight the pieces, and a forward recursion in logarithms
sums over all segmentations: the probability of the text, not of its best
segmentation. The vocabulary's scores are ranks, so a piece of rank r weighs
(r + OFFSET) ** -exponent; the exponent is learned, as the one of EXPONENTS
under which the training documents, all of them, are likeliest. Every
character can also be spelled in bytes, which share the mass SPELLED. A text
ends with the chance that a training token is an end.

With rounds of learning, ranks only begin: the weights of pieces become their
expected uses in the distinct units of the training documents (each once a
chunk, so that rare words shape them), and the words of the training documents
join the lattice as arcs of their own, weighted by their counts, their case and
the white space before them. What no word arc spells goes through the pieces.

Where no piece of the vocabulary holds two neighbouring bytes together, all
segmentations part there, so the sum is a product of sums over units; each
distinct unit of a group of texts is computed once, many at a time.

The base score needs the count of every token over the training documents.
Texts are packed into chunks, written once; a chunk sends each of its distinct
tokens once, counts are summed by token, and go back by chunk and number.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_dedup import chunks
from .tables import staged
from .units import distinct_runs, forget

SPACE_MARK = "▁"
#: Production parameters: exponents tried, offset of ranks, mass of all bytes, bytes of text in a chunk.
EXPONENTS, OFFSET, SPELLED, CHUNK = (0.6, 0.8, 1.0, 1.2, 1.4), 2.7, 1e-3, 8 << 20
#: Cells of a table of units handled at once; units longer than WIDE bytes are handled one by one.
CELLS, WIDE = 1 << 20, 256
#: Where learning begins, the uses every piece is given, and the classes of a word: its case by the white space before it.
START, GIVEN, CASES = (1.0,), 0.01, 3
FOLDS, HELD_OUT = 5, 1
_SPREAD = np.full(256, 1, np.int64)  # bytes of a character by its first byte
_SPREAD[0xC0:], _SPREAD[0xE0:], _SPREAD[0xF0:] = 2, 3, 4
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Lattice:
    """The pieces of a vocabulary as a trie over bytes."""

    def __init__(self, file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=os.fspath(file))
        plain = [i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in plain]
        self._set(pieces, np.array([-model.get_score(i) for i in plain]))

    def _set(self, pieces: list[bytes], ranks: np.ndarray) -> None:
        self.ranks, self.edges, piece_of = ranks, {}, [-1]
        self.adjacent = np.zeros((256, 256), bool)
        for number, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.edges:
                    self.edges[key] = len(piece_of)
                    piece_of.append(-1)
                node = self.edges[key]
            piece_of[node] = number
            self.adjacent[list(piece[:-1]), list(piece[1:])] = True
        self.adjacent[:, 0x80:0xC0] = True  # a character's own bytes
        self.piece_of = np.array(piece_of)
        self.child = np.fromiter(self.edges.values(), np.int64, len(self.edges))

    @cached_property
    def index(self) -> pd.Index:
        return pd.Index(np.fromiter(self.edges.keys(), np.int64, len(self.edges)))

    def weights(self, exponents: tuple[float, ...], end: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of pieces (a column an exponent) and of one byte; with the end they sum to 1."""
        raw = (self.ranks + OFFSET)[:, None] ** -np.array(exponents)
        return np.log((1 - SPELLED) * (1 - end) * raw / raw.sum(0)), np.full(len(exponents), np.log(SPELLED * (1 - end) / 256))

    def learned(self, uses: np.ndarray, mass: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of pieces by their uses and of one byte, as one column; they sum to the mass."""
        raw = (uses + GIVEN)[:, None]
        return np.log((1 - SPELLED) * mass * raw / raw.sum(0)), np.full(1, np.log(SPELLED * mass / 256))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Marks bytes before which every segmentation parts."""
        out = np.ones(len(data), bool)
        out[1:] = ~self.adjacent[data[:-1], data[1:]]
        return out

    def marginals(self, units: pa.Array, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log probability of each unit (UTF-8 bytes), summed over its segmentations, a column an exponent."""
        offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
        data = np.frombuffer(units.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        out = np.zeros((len(units), len(weights[1])))
        order = np.argsort(sizes, kind="stable")
        at, short = 0, int(np.searchsorted(sizes[order], WIDE, side="right"))
        while at < short:
            # As many units as fit, all as wide as the longest of them.
            most = np.flatnonzero(sizes[order[at:short]] * np.arange(1, short - at + 1) > CELLS)
            stop = at + (int(most[0]) if len(most) else short - at)
            some = order[at : max(stop, at + 1)]
            out[some] = self._table(data, offsets[some], sizes[some], weights)
            at += len(some)
        for i in order[short:]:
            out[i] = self._one(data[offsets[i] : offsets[i + 1]].tolist(), weights)
        return out

    def uses(self, units: pa.Array, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Expected uses of each piece in the units, under weights of one column; longer units in stretches of WIDE bytes."""
        offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
        data = np.frombuffer(units.buffers()[2] or b"", np.uint8)
        parts = -(-np.diff(offsets) // WIDE)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begins = np.repeat(offsets[:-1], parts) + inside * WIDE
        sizes = np.minimum(np.repeat(offsets[1:], parts) - begins, WIDE)
        order = np.argsort(sizes, kind="stable")
        out, at = np.zeros(len(self.ranks)), 0
        while at < len(order):
            most = np.flatnonzero(sizes[order[at:]] * np.arange(1, len(order) - at + 1) > CELLS // 4)
            some = order[at : max(at + (int(most[0]) if len(most) else len(order) - at), at + 1)]
            arcs: list = []
            forward = self._table(data, begins[some], sizes[some], weights, arcs)
            back = np.full((int(sizes[some].max()) + 1, len(some)), -np.inf)
            back[sizes[some], np.arange(len(some))] = 0
            for p, here, k, rows, pieces in reversed(arcs):
                cost = back[k, rows] + (weights[0][pieces, 0] if pieces is not None else (k - p) * weights[1][0])
                back[p, rows] = np.logaddexp(back[p, rows], cost)
                if pieces is not None:
                    out += np.bincount(pieces, np.exp(here + cost - forward[rows, 0]), len(out))
            at += len(some)
        return out

    def _table(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, weights: tuple[np.ndarray, np.ndarray], arcs: list | None = None) -> np.ndarray:
        """The recursion over a table of units, start by start: a start's value is final once all before it are done. Keeps its arcs if asked."""
        piece, byte = weights
        width = int(sizes.max(initial=0))
        forward = np.full((width + 1, len(sizes), len(byte)), -np.inf)
        forward[0] = 0
        for p in range(width):
            rows = np.flatnonzero((sizes > p) & np.isfinite(forward[p, :, 0]))
            here = forward[p, rows]
            spread = np.minimum(_SPREAD[data[begins[rows] + p]], sizes[rows] - p)
            forward[p + spread, rows] = np.logaddexp(forward[p + spread, rows], here + spread[:, None] * byte)
            if arcs is not None:
                arcs.append((p, here[:, 0], p + spread, rows, None))
            node, k = np.zeros(len(rows), np.int64), p
            while len(rows):
                found = self.index.get_indexer(node << 8 | data[begins[rows] + k])
                on = found >= 0
                rows, here, node, k = rows[on], here[on], self.child[found[on]], k + 1
                is_piece = self.piece_of[node] >= 0
                ends = rows[is_piece]
                forward[k, ends] = np.logaddexp(forward[k, ends], here[is_piece] + piece[self.piece_of[node[is_piece]]])
                if arcs is not None and len(ends):
                    arcs.append((p, here[is_piece, 0], k, ends, self.piece_of[node[is_piece]]))
                on = sizes[rows] > k
                rows, here, node = rows[on], here[on], node[on]
        return forward[sizes, np.arange(len(sizes))]

    def _one(self, unit: list[int], weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The same recursion for a long unit; values behind the current start by the longest piece are given up."""
        piece, byte = weights
        forward: dict[int, np.ndarray] = {0: np.zeros(len(byte))}
        for p in range(len(unit)):
            here = forward.pop(p, None)
            if here is None:
                continue
            spread = min(int(_SPREAD[unit[p]]), len(unit) - p)
            arcs, node = [(p + spread, spread * byte)], 0
            for k in range(p, len(unit)):
                node = self.edges.get(node << 8 | unit[k], -1)
                if node < 0:
                    break
                if self.piece_of[node] >= 0:
                    arcs.append((k + 1, piece[self.piece_of[node]]))
            for end, weight in arcs:
                forward[end] = np.logaddexp(forward[end], here + weight) if end in forward else here + weight
        return forward[len(unit)]


_LATTICES: dict[str, Lattice] = {}


def lattice(file: str) -> Lattice:
    """One for each worker and file."""
    if file not in _LATTICES:
        _LATTICES[file] = Lattice(file)
    return _LATTICES[file]


class Texts:
    """The documents of a chunk."""

    def __init__(self, row: dict) -> None:
        self.ids = pa.ipc.open_stream(row["rest"]).read_all().column(0).to_pylist()
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.body = zstandard.ZstdDecompressor().decompress(row["text"])
        self.held_out = np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in self.ids], bool)

    @cached_property
    def tokens(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct lower-cased words, and of each word in the texts its number among them and its document."""
        data = _LOWER[np.frombuffer(self.body, np.uint8)]
        words, at, starts = distinct_runs(data, _INSIDE[data], self.ends - self.sizes)
        return words, at, np.searchsorted(self.ends, starts, side="right")

    def units(self, own: Lattice) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Units of the texts, the edges between them, where texts begin, and the bytes; a text is read with a space before it."""
        texts = [self.body[a:b] for a, b in zip((self.ends - self.sizes).tolist(), self.ends.tolist())]
        joined = b"".join([b" " + t for t in texts if t])
        data = np.frombuffer(joined, np.uint8)
        begins = np.cumsum([0, *[len(t) + 1 if t else 0 for t in texts]])
        starts = own.cuts(data)
        starts[begins[begins < len(data)]] = True
        edges = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(joined)]).dictionary_encode(), edges, begins, data

    def likelihoods(self, own: Lattice, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Log probability of each text without its end, a row a document."""
        units, edges, begins, _ = self.units(own)
        each = own.marginals(units.dictionary, weights)[units.indices.to_numpy()] if len(units) else np.zeros((0, len(weights[1])))
        doc = np.searchsorted(begins[1:], edges[:-1], side="right")
        return np.stack([np.bincount(doc, each[:, g], len(self.ids)) for g in range(each.shape[1])], 1)

    def uses(self, own: Lattice, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
        """Expected uses of pieces in the distinct units of the training documents, and the number of these units."""
        units, edges, begins, _ = self.units(own)
        training = ~self.held_out[np.searchsorted(begins[1:], edges[:-1], side="right")]
        kept = np.unique(units.indices.to_numpy()[training])
        return own.uses(units.dictionary.take(pa.array(kept)), weights) if len(kept) else np.zeros(len(own.ranks)), len(kept)

    @cached_property
    def starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: where its bytes begin and end in the texts, and its class: preceded by a space (or a text's start), a line break or neither, and lower, capital, other."""
        body = np.frombuffer(self.body, np.uint8)
        words, at, doc = self.tokens
        lengths = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]).astype(np.int64)
        upper = np.cumsum(np.append(0, (body >= 65) & (body <= 90)))
        inside = _INSIDE[body]
        head = np.zeros(len(body) + 1, bool)
        head[self.ends - self.sizes] = True
        begin = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | head[: len(body)]))
        end = begin + lengths[at]
        many = upper[end] - upper[begin]
        case = np.where(many == 0, 0, np.where((many == 1) & (upper[begin + 1] > upper[begin]), 1, 2))
        before = np.where(head[begin], 32, body[begin - 1]) if len(begin) else np.zeros(0, np.uint8)
        return begin, end, np.where(before == 32, 0, np.where(before == 10, 1, 2)) * CASES + case

    def mixed(self, own: Lattice, weights: tuple[np.ndarray, np.ndarray], arcs: np.ndarray, spell: float) -> np.ndarray:
        """Log probability of each text without its end.

        A word with the white space before it is one arc (its log weight, -inf
        without one) or is spelled, at the log price `spell`. Units outside of
        words, and words whose ends a piece may cross, are spelled one by one.
        """
        units, edges, begins, _ = self.units(own)
        if not len(units):
            return np.zeros(len(self.ids))
        each = own.marginals(units.dictionary, weights)[units.indices.to_numpy(), 0]
        doc = np.searchsorted(begins[1:], edges[:-1], side="right")
        begin, end, kind = self.starts
        word_doc = self.tokens[2]
        # Texts are joined with a space before each.
        shift = np.cumsum(self.sizes > 0)[word_doc]
        first, last = begin + shift - (kind < 2 * CASES), end + shift
        i, j = np.searchsorted(edges, first), np.searchsorted(edges, last)
        whole = (edges[i] == first) & (edges[j] == last)
        i, j = i[whole], j[whole]
        inside = np.cumsum(np.bincount(i, minlength=len(edges)) - np.bincount(j, minlength=len(edges)))[:-1] > 0
        total = np.append(0, np.cumsum(each))
        words = np.logaddexp(arcs[whole], total[j] - total[i] + spell)
        return np.bincount(word_doc[whole], words, len(self.ids)) + np.bincount(doc, np.where(inside, 0, each + spell), len(self.ids))


def _gather(file: str, exponents: tuple[float, ...], learn: bool):
    """Of each chunk: its distinct tokens with their counts in training documents, its training documents, and their log likelihoods, or their classes of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own = lattice(file)
        weights = own.weights(exponents)
        for batch in batches:
            for row in batch.to_pylist():
                texts = Texts(row)
                words, at, doc = texts.tokens
                training = ~texts.held_out
                count = np.bincount(at[training[doc]], minlength=len(words)) if len(at) else np.zeros(len(words), np.int64)
                if learn:
                    fits = np.bincount(texts.starts[2][training[doc]], minlength=3 * CASES).astype(float)
                else:
                    fits = texts.likelihoods(own, weights)[training].sum(0)
                n, g = len(words), len(fits)
                # Numbers below 0: the ends, then the likelihoods or classes.
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + 1 + g, row["chunk"])), pa.concat_arrays([words, pa.nulls(1 + g, pa.binary())]), pa.array(np.concatenate([np.arange(n), -1 - np.arange(1 + g)]), pa.int32()),
                    pa.array(np.concatenate([count, [training.sum()], np.zeros(g)]).astype(np.int64)), pa.array(np.concatenate([np.zeros(n + 1), fits]))], names=["chunk", "token", "number", "count", "fit"])

    return run


def _learn(packed: DataFrame, file: str, rounds: int) -> tuple[np.ndarray, float]:
    """Expected uses of each piece in the distinct training units of all chunks after some rounds, and the chance that a piece ends its unit."""
    uses, stop = None, 0.5

    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], uses: np.ndarray | None = uses, stop: float = stop) -> Iterator[pa.RecordBatch]:
            own = lattice(file)
            weights = own.weights(START) if uses is None else own.learned(uses, 1 - stop)
            for batch in batches:
                for row in batch.to_pylist():
                    found, n = Texts(row).uses(own, weights)
                    some = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(found[some], n).astype(float))], names=["piece", "uses"])

        rows = packed.mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # a row a piece of the vocabulary
        number, value = rows["piece"].to_numpy(), rows["uses"].to_numpy()
        uses = np.zeros(len(lattice(file).ranks))
        uses[number[number >= 0]] = value[number >= 0]
        units = value[number < 0].sum()
        stop = float((units + 1) / (units + uses.sum() + 2))
    return uses, stop


def score(documents: DataFrame, file: str, exponents: tuple[float, ...] = EXPONENTS, chunk_bytes: int = CHUNK, rounds: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text is empty: its only token is the end. A row without an id is a
    training row. Rows that repeat count and are scored each. An empty table
    gives no rows. Without training rows no token is known, ends are as likely
    as not, and the first exponent serves. With `rounds`, weights of pieces are
    learned in as many rounds, in place of the exponent, and the training words
    are arcs, too.
    """
    packed = staged(chunks(documents.select("doc_id", "text"), "doc_id", "text", chunk_bytes, ("doc_id",)).drop("doc_ids", "digests"), "lattice-chunks")
    gathered = staged(packed.mapInArrow(_gather(file, exponents, rounds > 0), "chunk long, token binary, number int, count long, fit double"), "lattice-tokens")
    seen = gathered.filter("number >= 0")
    counts = staged(seen.filter("count > 0").groupBy("token").agg(F.sum("count").alias("c")), "lattice-counts")
    sums = {r.number: (r.n, r.fit) for r in gathered.filter("number < 0").groupBy("number").agg(F.sum("count").alias("n"), F.sum("fit").alias("fit")).collect()}  # a row an exponent or class, and one
    words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    ends = sums.get(-1, (0, 0.0))[0]
    total, distinct = words.n + ends, words.v + (ends > 0)
    best = max(range(len(exponents)), key=lambda g: (sums.get(-2 - g, (0, 0.0))[1], -g))
    end = ends / total if 0 < ends < total else 0.5
    uses, stop = _learn(packed, file, rounds) if rounds else (None, 0.5)
    # Words met once tell how often a new word comes; classes of words have a share of what is not spelled.
    rare = (words.once + 1) / (words.n + 2)
    classes = np.array([sums.get(-2 - g, (0, 0.0))[1] if rounds else 0.0 for g in range(3 * CASES)]) + 0.5
    classes = np.log(classes / classes.sum()) + np.log(1 - end) + np.log(1 - rare)
    spell = np.log(1 - end) + np.log(rare) + np.log(stop)

    def finish(chunk: pa.Table, known: pa.Table) -> pa.Table:
        own, out = lattice(file), []
        weights = own.learned(uses, 1 - stop) if rounds else own.weights((exponents[best],), end)
        for row in chunk.to_pylist():
            texts = Texts(row)
            words, at, doc = texts.tokens
            c = np.zeros(len(words), np.int64)
            c[known["number"].to_numpy()] = known["c"].to_numpy()
            n = len(texts.ids)
            cost = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            last = np.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))
            if rounds:
                begin, stops, kind = texts.starts
                with np.errstate(divide="ignore"):
                    share = np.log(c[at] / max(total - ends, 1))
                # Of words of mixed case any letter may be a capital.
                inside = texts.mixed(own, weights, share + classes[kind] - np.where(kind % CASES == 2, (stops - begin) * np.log(2), 0), spell)
            else:
                inside = texts.likelihoods(own, weights)[:, 0]
            likely = (inside + np.log(end)) / np.log(10)
            out.append(pa.table({
                "doc_id": pa.array(texts.ids, pa.int64()), "held_out": pa.array(texts.held_out), "n_tokens": pa.array(np.bincount(doc, minlength=n) + 1, pa.int64()),
                "n_known": pa.array(np.bincount(doc[c[at] > 0], minlength=n) + int(ends > 0), pa.int64()), "train_tokens": pa.array(np.full(n, total), pa.int64()),
                "base_score": pa.array(np.bincount(doc, cost[at], minlength=n) + last), "score": pa.array(likely)}))
        return pa.concat_tables(out)

    answers = seen.select("chunk", "token", "number").join(counts, "token").select("chunk", "number", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
