"""SentencePiece encoding and decoding with a streaming Viterbi search.

The best segmentation of a text under the scores of a piece vocabulary. The
search keeps a window no longer than the longest piece: every boundary that
can still be extended lies in it, and once the backpointer paths of all of
them run through one boundary, the ids up to it are final and given out.

Characters without a piece fall back to the ids of their UTF-8 bytes. A space
is matched as the vocabulary's space mark; the mark itself, where a text has
it, is spelled in bytes. So decoding gives every text back exactly.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import texts
from .units import Memory, cut, groups

SPACE_MARK = "▁"
#: A character spelled in bytes costs so much more than the worst piece.
UNKNOWN_COST = 10.0


class PieceModel:
    """Pieces, scores and byte ids of a SentencePiece model file; the file's own segmentation is not used."""

    def __init__(self, file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.piece: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = [b""] * len(model)
        self.byte_id = [0] * 256
        for i in range(len(model)):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(text[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(text[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = text.replace(SPACE_MARK, " ")
                self.piece[plain] = (model.get_score(i), i)
                self.bytes_of[i] = plain.encode()
        self.longest = max(map(len, self.piece))
        self.unknown = min(s for s, _ in self.piece.values()) - UNKNOWN_COST
        # Every beginning of a piece, so that a search stops at the first that begins none.
        self.begins: dict[str, tuple[float, int] | None] = {p[:k]: None for p in self.piece for k in range(1, len(p))} | self.piece
        self.memory = Memory(self._units)

    def settle(self, text: str) -> list[int]:
        """Ids of a text that the window holds whole: all paths meet at its end."""
        begins, unknown, n = self.begins.get, self.unknown, len(text)
        score, start_of, id_of = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        for start in range(n):
            here = score[start]
            if here + unknown > score[start + 1]:
                score[start + 1], start_of[start + 1], id_of[start + 1] = here + unknown, start, -1
            for end in range(start + 1, n + 1):
                part = text[start:end]
                found = begins(part, 0)
                if found == 0:
                    break
                if found is not None and here + found[0] > score[end]:
                    score[end], start_of[end], id_of[end] = here + found[0], start, found[1]
        ids, at = [], n
        while at:
            if id_of[at] >= 0:
                ids.append(id_of[at])
            else:
                ids.extend(self.byte_id[b] for b in reversed(text[start_of[at] : at].encode()))
            at = start_of[at]
        ids.reverse()
        return ids

    def stream(self, text: str) -> Iterator[int]:
        """Ids of the best segmentation, given out as soon as they are settled.

        Of equal scores, the longer last piece wins.
        """
        piece, longest, n = self.piece, self.longest, len(text)
        # score and back hold boundaries base .. base + len - 1; back is (start, id or -1 for bytes).
        base, score, back = 0, [0.0], [(0, -1)]
        for end in range(1, n + 1):
            low = max(base, end - longest)
            best, where = score[end - 1 - base] + self.unknown, (end - 1, -1)
            for start in range(low, end):
                found = piece.get(text[start:end])
                if found is not None:
                    s = score[start - base] + found[0]
                    if s > best or (s == best and start < where[0]):
                        best, where = s, (start, found[1])
            score.append(best)
            back.append(where)
            if end == n or end - base >= 4 * longest:
                # Boundaries that a later piece can start from; their paths back meet where all is settled.
                live = {end} if end == n else set(range(end - longest + 1, end + 1))
                while len(live) > 1:
                    top = max(live)
                    live.remove(top)
                    live.add(back[top - base][0])
                (settled,) = live
                if settled > base:
                    path, at = [], settled
                    while at > base:
                        start, i = back[at - base]
                        path.append((start, at, i))
                        at = start
                    for start, stop, i in reversed(path):
                        if i >= 0:
                            yield i
                        else:
                            yield from (self.byte_id[b] for b in text[start:stop].encode())
                    del score[: settled - base], back[: settled - base]
                    base = settled
                    back[0] = (base, -1)

    def _units(self, units: list[str]) -> Iterator[bytes]:
        window = 4 * self.longest
        return (array("i", self.settle(" " + u) if len(u) < window else self.stream(" " + u)).tobytes() for u in units)

    def encode(self, texts_: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers.

        No piece runs on over a space after another character, so all paths
        meet before each such space: units between single spaces are settled
        one by one, and their ids remembered.
        """
        return self.memory.join([cut(t) if t else [] for t in texts_])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the leading space that encoding puts before it."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", errors="replace")


_MODELS: dict[str, PieceModel] = {}


def model(file: str) -> PieceModel:
    """One for each worker and file."""
    if file not in _MODELS:
        _MODELS[file] = PieceModel(os.fspath(file))
    return _MODELS[file]


def encode(documents: DataFrame, file: str) -> DataFrame:
    """doc_id, n_chars, ids, n_ids, and round_trip: whether decoding the ids gives the text back.

    A null or empty text has no ids. Each row is encoded by itself, so rows
    that repeat give rows that repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(file)
        for batch in batches:
            doc_ids = batch["doc_id"]
            for at, group in groups(batch, "text"):
                flat = [np.frombuffer(x, "<i4") for x in pieces.encode(group)]
                sizes = np.array([len(x) for x in flat], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
                same = [pieces.decode(x.tolist()) == t for x, t in zip(flat, group)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(at, len(group)), pa.array([len(t) for t in group], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(sizes), pa.array(same)],
                    names=["doc_id", "n_chars", "ids", "n_ids", "round_trip"])

    return texts(documents).mapInArrow(run, "doc_id long, n_chars long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([pieces.decode(x.as_py() or []) for x in batch["ids"]], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
