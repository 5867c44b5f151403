"""Cutting text into units that a tokenizer never joins, and remembering their ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space with no white space beside it: the space starts a unit.
_GAP = re.compile(r"(?<=\S) (?=\S)")
_BESIDE = re.compile(r"\s |\s\Z| \s|\A\s")


def cut(text: str) -> list[str]:
    """Parts of the text between single spaces; the space before every part but the first is left out.

    Runs of white space stay inside a part, whole.
    """
    return _GAP.split(text) if _BESIDE.search(text) else text.split(" ")


_KNOWN: list[dict] = []


def remembered() -> dict[str, bytes]:
    """A new table of encoded units of this worker."""
    _KNOWN.append({})
    return _KNOWN[-1]


def forget() -> None:
    """Empties all tables: a worker serves many stages, and those without a tokenizer need the room."""
    for known in _KNOWN:
        known.clear()


class Memory:
    """encoded(unit) for many units, kept up to a bound; past it, all is forgotten and learned anew."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], bound: int = 1_000_000) -> None:
        self.encode, self.bound, self.known = encode, bound, remembered()

    def join(self, lists: list[list[str]]) -> list[bytes]:
        """The encoded units of each list, one after the other."""
        if len(self.known) > self.bound:
            self.known.clear()
        missing = list(set().union(*lists).difference(self.known))
        if missing:
            self.known.update(zip(missing, self.encode(missing)))
        known = self.known.__getitem__
        return [b"".join(map(known, units)) for units in lists]


def groups(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts of the batch in order, in groups of about `size` characters, each with its first row's number."""
    at, held, chars = 0, [], 0
    for i, x in enumerate(batch[column]):
        text = x.as_py()
        held.append(text)
        chars += len(text)
        if chars >= size:
            yield at, held
            at, held, chars = i + 1, [], 0
    if held:
        yield at, held


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text, a longer text alone."""
    ends = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def distinct_runs(data: np.ndarray, inside: np.ndarray, heads: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct runs of bytes that are inside, and of each run its number among them and its start; heads (of texts) part runs, too."""
    n = len(data)
    head = np.zeros(n + 1, bool)
    head[heads] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | head[:n]))
    ends = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | head[1 : n + 1])) + 1
    edges = np.empty(2 * len(starts) + 1, np.int32)  # runs and what stands between them, by turns
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, n
    both = pa.Array.from_buffers(pa.binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data.tobytes())])
    runs = both.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    return runs.dictionary, runs.indices.to_numpy(), starts
