"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages and only the bag has a label. Every passage is
encoded, a gated attention learns from the labels how much each passage
counts, and the weighted sum of the codes is what is scored. Training takes a
bounded sample of labelled documents; scoring reads every passage of every
text and sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import texts
from .units import groups

#: Words of a passage; labelled documents that are learned from; units of code and attention; steps.
PASSAGE, SAMPLE, CODE, ATTENTION, STEPS, RATE = 64, 3000, 16, 8, 300, 0.03
#: Score from which a document counts as good.
THRESHOLD = 0.3
HOLD_OUT = 5

_KINDS = ("space", "line end", "lower", "upper", "digit", "comma or stop", "bang or question", "bar", "symbol", "other ASCII", "beyond ASCII")
N_FEATURES = len(_KINDS) + 7


def _kind_table() -> np.ndarray:
    kind = np.full(256, 9, np.int64)
    kind[[9, 11, 12, 13, 32]] = 0
    kind[10] = 1
    kind[97:123], kind[65:91], kind[48:58] = 2, 3, 4
    kind[list(b".,;:")], kind[list(b"!?")], kind[list(b"|")], kind[list(b"#*$%&<>@^~_=+{}[]\\/")] = 5, 6, 7, 8
    kind[128:] = 10
    return kind


_KIND = _kind_table()
#: Random weights for a sum that stands for a word: by byte and place in the word.
_MIX = np.random.default_rng(7).integers(-(1 << 62), 1 << 62, (256, 32))


def features(texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of features for each passage, the number of the first passage of each text); a text without words has one passage."""
    raw = [t.encode() for t in texts_]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    kind = _KIND[data]
    inside = kind > 1
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    word_text = np.searchsorted(ends, starts, side="right")
    words_of = np.bincount(word_text, minlength=len(raw))
    passages_of = np.maximum(1, -(-words_of // PASSAGE))
    first = np.concatenate([[0], np.cumsum(passages_of)])
    n = int(first[-1])
    place = np.arange(len(starts)) - (np.cumsum(words_of) - words_of)[word_text]
    word_passage = first[word_text] + place // PASSAGE
    # Bytes belong to the passage of the last word that began before them, in the same text.
    byte_text = np.repeat(np.arange(len(raw)), np.diff(np.concatenate([[0], ends])))
    seen = np.zeros(len(data), np.int64)
    seen[starts] = 1
    seen = np.cumsum(seen)
    passage = first[byte_text]
    if len(starts):
        last = word_passage[np.maximum(seen - 1, 0)]
        passage = np.where((seen > 0) & (last >= passage), last, passage)
    counts = np.bincount(passage * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, -1).astype(float)
    chars = np.maximum(1, counts.sum(1))
    words = np.bincount(word_passage, minlength=n).astype(float)
    some = np.maximum(1, words)
    if len(starts):
        spot = np.arange(len(data)) - starts[np.maximum(seen - 1, 0)]
        mixed = np.where(inside, _MIX[data, np.clip(spot, 0, 31)], 0)
        total = np.concatenate([[0], np.cumsum(mixed)])
        stop = np.concatenate([starts[1:], [len(data)]])
        word = total[stop] - total[starts]
        length = np.add.reduceat(inside.astype(np.int64), starts)
        order = np.lexsort((word, word_passage))
        fresh = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (word_passage[order][1:] != word_passage[order][:-1])])
        distinct = np.bincount(word_passage[order], fresh, n)
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (word_passage[1:] == word_passage[:-1])])
        repeats = np.bincount(word_passage, again, n)
        short = np.bincount(word_passage, length <= 3, n)
        long_ = np.bincount(word_passage, length >= 12, n)
        capital = np.bincount(word_passage, kind[starts] == 3, n)
        size = np.bincount(word_passage, length, n)
    else:
        distinct = repeats = short = long_ = capital = size = np.zeros(n)
    rows = np.column_stack([np.sqrt(counts / chars[:, None]), distinct / some, repeats / some, short / some, long_ / some, capital / some, size / some / 10, np.log1p(words) / 5])
    return rows, first[:-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights of encoder, gated attention and score, and the scaling of the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        code = np.tanh(x @ w["encode"] + w["encode0"])
        lean, gate = np.tanh(code @ w["lean"]), _sigmoid(code @ w["gate"])
        raw = (lean * gate) @ w["attend"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(x)]])))
        top = np.maximum.reduceat(raw, first)[bag] if len(first) else raw
        share = np.exp(raw - top)
        share /= np.add.reduceat(share, first)[bag] if len(first) else 1
        held = np.add.reduceat(share[:, None] * code, first) if len(first) else code
        return {"x": x, "code": code, "lean": lean, "gate": gate, "bag": bag, "share": share, "held": held, "score": _sigmoid(held @ w["score"] + w["score0"])}


def train(x: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> Model:
    """Weights fitted to the labels of the bags by Adam on the whole sample; the same sample gives the same weights."""
    draw = np.random.default_rng(seed).normal
    shapes = {"encode": (x.shape[1], CODE), "encode0": (CODE,), "lean": (CODE, ATTENTION), "gate": (CODE, ATTENTION), "attend": (ATTENTION,), "score": (CODE,), "score0": ()}
    w = {k: draw(0, 1 / np.sqrt(s[0]), s) if k[-1] != "0" else np.zeros(s) for k, s in shapes.items()}
    model = Model(x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-3 if len(x) else np.ones(x.shape[1]), w)
    if not len(labels):
        w["score"] = np.zeros(CODE)
        return model
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(x, first)
        off = (f["score"] - labels) / len(labels)
        d_held = off[:, None] * w["score"]
        to_code = d_held[f["bag"]] * f["share"][:, None]
        d_share = (d_held[f["bag"]] * f["code"]).sum(1)
        mean = np.add.reduceat(d_share * f["share"], first)[f["bag"]]
        d_raw = f["share"] * (d_share - mean)
        both = f["lean"] * f["gate"]
        d_lean = d_raw[:, None] * w["attend"] * f["gate"] * (1 - f["lean"] ** 2)
        d_gate = d_raw[:, None] * w["attend"] * both * (1 - f["gate"])
        d_code = (to_code + d_lean @ w["lean"].T + d_gate @ w["gate"].T) * (1 - f["code"] ** 2)
        grad = {"encode": f["x"].T @ d_code + 1e-5 * w["encode"], "encode0": d_code.sum(0), "lean": f["code"].T @ d_lean, "gate": f["code"].T @ d_gate,
                "attend": both.T @ d_raw, "score": f["held"].T @ off + 1e-5 * w["score"], "score0": off.sum()}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(key: str = "doc_id"):
    """Documents never learned from: the CRC of the id as text is divisible by HOLD_OUT. A missing id is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.quality from at most `sample` labelled documents outside the held-out ones, chosen by a hash of the id.

    A document with several labels has the least of them. Without labels every score is 0.5.
    """
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = texts(documents).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, marks = batch["doc_id"].to_pylist(), batch["quality"].to_pylist()
            for at, group in groups(batch, "text"):
                x, first = features(group)
                parts = np.split(x, first[1:])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids[at : at + len(group)], pa.int64()), "quality": pa.array(marks[at : at + len(group)], pa.int32()),
                                                  "x": pa.array([p.astype("<f4").tobytes() for p in parts], pa.binary())})

    rows = known.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    sizes = np.array([len(b) for b in bags], np.int64)
    return train(np.concatenate(bags) if bags else np.zeros((0, N_FEATURES)), np.cumsum(sizes) - sizes, np.array([float(r["quality"] == 1) for r in rows]))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and n_passages of every row; a null or empty text is one passage without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in groups(batch, "text"):
                x, first = features(group)
                f = model.forward(x, first)
                sizes = np.diff(np.concatenate([first, [len(x)]]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(group)), pa.array(f["score"], pa.float64()), pa.array(sizes, pa.int64())], names=["doc_id", "score", "n_passages"])

    scored = texts(documents).mapInArrow(run, "doc_id long, score double, n_passages long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")


def select_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of documents that score at least the threshold, with all their columns."""
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(at).fill_null("")], names=["text"])
            good: list[bool] = []
            for _, group in groups(plain, "text"):
                good += (model.forward(*features(group))["score"] >= threshold).tolist()
            yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
