"""Near-duplicates by bottom-k sketches from one hash function.

A document's set of word shingles is hashed once; its smallest hashes are its
sketch. Documents of equal sets form one class and take part once. Inverted
lists of the smallest retained values give the overlaps: a pair above the
similarity misses all of ``LOW`` values of its union with a chance below
1e-19. Candidates pass if the sketch of their union does not rule the limit
out: a pair at the limit shares fewer of its values with a chance below
``MISS``. They are then confirmed on full sets.

Values that very many classes hold are hot. A document with enough other
values is found by those. The rest, whose text is mostly shared, meets in the
lists of its hot values, cut into blocks by documents and by values; a task
gets two blocks with their full sets, and gives back a spanning forest of
their links, not all pairs.

The exact mode leaves nothing to chance: a document is listed under as many of
its smallest values that one of them is shared with every document at the limit
(its size, less the least number that such a document shares, and one), under
all that are hot among them too, and no estimate is asked.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .tables import staged, texts
from .units import forget, groups

#: Retained values, those with inverted lists, and those a document must have besides hot ones to be found by them.
SKETCH, LOW, ENOUGH = 64, 24, 12
#: Classes from which a value is hot; hot values a document is listed under; documents and values of a block.
HOT, HOT_VALUES, BLOCK, BLOCK_VALUES = 40, 8, 500, 2_000_000
#: Chance at which the estimate may lose a pair at the limit.
MISS = 1e-8
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(23).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # letters A to Z as their small forms
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts_: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of so many words; of all its words, where it has fewer."""
    raw = [t.encode() for t in texts_]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(_BASE))]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(pow(_BASE, -1, 1 << 64)))]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * powers[:-1], dtype=np.uint64)])
    word = _mix((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    text = np.searchsorted(ends, starts, side="right")
    many = np.bincount(text, minlength=len(raw))
    first = np.cumsum(many) - many
    n = len(word)
    hashes = np.zeros(n, np.uint64)
    for k in range(words):
        part = np.zeros(n, np.uint64)
        part[: n - k] = word[k:]
        hashes = _mix(hashes * np.uint64(_BASE) + part)
    whole = np.arange(n) + words <= (first + many)[text] if n else np.zeros(0, bool)
    owner, value = text[whole], hashes[whole]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[fresh], value[fresh]
    sets = np.split(value, np.searchsorted(owner, np.arange(1, len(raw))))
    for i in np.flatnonzero((many > 0) & (many < words)):
        body = b" ".join(raw[i].lower().split())
        sets[i] = np.array([int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little")], np.uint64)
    return sets


def least_estimate(percent: int) -> float:
    """Share of a full sketch's values below which a pair at the limit falls with a chance under MISS."""
    p, below, shared = percent / 100, 0.0, 0
    while shared < SKETCH:
        below += math.comb(SKETCH, shared) * p**shared * (1 - p) ** (SKETCH - shared)
        if below >= MISS:
            break
        shared += 1
    return shared / SKETCH


def exact_prefix(size: int, percent: int) -> int:
    """Smallest values of a set of which every set at the limit shares one among as many of its own."""
    return size - -(-size * percent // 100) + 1


def sketches(documents: DataFrame, words: int, prefix: Callable[[int], int] = lambda size: LOW) -> DataFrame:
    """doc_id, n_shingles, print (digest of the whole set), low (smallest values, as many as prefix says) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at, group in groups(batch, "text"):
                sets = shingle_sets(group, words)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, len(group)), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array([s[:prefix(len(s))].view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "print", "low", "sketch"])

    return texts(documents).mapInArrow(run, "doc_id long, n_shingles long, print binary, low array<long>, sketch binary")


def _estimates(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose union sketch has enough values of both."""
    forget()
    for batch in batches:
        keep = []
        for x, y in zip(batch["sa"], batch["sb"]):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            union = np.union1d(x, y)
            # Beyond the end of a full sketch its set is not known.
            if len(x) == SKETCH or len(y) == SKETCH:
                union = union[:SKETCH]
            both = np.intersect1d(x, y, assume_unique=True)
            keep.append(bool(len(union)) and int((both <= union[-1]).sum()) >= limit * len(union))
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        keep = []
        for x, y in zip(batch["xa"], batch["xb"]):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["a", "b"])


def _forest(percent: int):
    """Links of the documents of two blocks, as (document, smallest document that it reaches there)."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        ids = table["rep"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["set"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        value, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(column)[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            some = slice(*np.searchsorted(column, [at, at + width]))
            held = np.zeros((len(sets), width), np.float32)
            held[row[some], column[some] - at] = 1
            both += held @ held.T
        near = both.astype(np.int64) * (100 + percent) >= percent * (sizes[:, None] + sizes)
        del both
        seen, out = np.zeros(len(ids), bool), []
        for i in np.argsort(ids, kind="stable"):
            if not seen[i]:
                reach = np.zeros(len(ids), bool)
                reach[i] = True
                front = reach
                while front.any():
                    front = near[front].any(0) & ~reach
                    reach |= front
                seen |= reach
                out += [(ids[i], ids[j]) for j in np.flatnonzero(reach) if ids[j] != ids[i]]
        cols = list(zip(*out)) if out else [[], []]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def links(documents: DataFrame, known: DataFrame, words: int, percent: int, exact: bool = False) -> DataFrame:
    """a, b: links between classes of known that connect all that are similar; within a hot block, a spanning forest."""
    classes = staged(known.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("low").alias("low"), F.first("sketch").alias("sketch")), "classes")
    posts = classes.select("rep", "n", F.explode("low").alias("value"))
    sizes = posts.groupBy("value").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("values")).filter("size > 1")
    listed = posts.select("rep", "value").join(sizes, "value").groupBy("rep").agg(F.collect_list(F.struct("value", "size", "values")).alias("at"))
    listed = listed.join(classes.select("rep", F.size("low").alias("n_low")), "rep")
    hot = F.filter("at", lambda x: x["size"] > HOT)
    some = F.when(F.col("n_low") - F.size(hot) < ENOUGH, F.slice(F.array_sort(hot), 1, HOT_VALUES)).otherwise(F.slice(hot, 1, 0))
    listed = staged(listed.select(
        "rep", F.filter("at", lambda x: x["size"] <= HOT)["value"].alias("cold"),
        (hot if exact else some).alias("hot")), "inverted-lists")
    lists = listed.select("rep", F.explode("cold").alias("value")).groupBy("value").agg(F.array_sort(F.collect_list("rep")).alias("reps")).filter(F.size("reps") > 1)
    pair = F.transform(F.slice("reps", F.col("i") + 2, F.lit(HOT)), lambda b: F.struct(F.col("a").alias("a"), b.alias("b")))
    pairs = lists.select("reps", F.posexplode("reps").alias("i", "a")).select(F.explode(pair).alias("p")).select("p.*").filter("a <> b").distinct()
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    limit = least_estimate(percent)
    likely = staged(sized.select("a", "b") if exact else sized.select("a", "b", "sa", "sb").mapInArrow(lambda it: _estimates(it, limit), "a long, b long"), "candidates")

    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(listed.filter(F.size("hot") > 0).select("rep")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in groups(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, len(group)), pa.array([s.tobytes() for s in shingle_sets(group, words)], pa.binary())], names=["rep", "set"])

    sets = staged(texts(documents).join(wanted, "doc_id").mapInArrow(run, "rep long, set binary"), "shingle-sets")

    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.least("size", F.col("values") / BLOCK_VALUES))).cast("int")
    tight = listed.select("rep", F.explode("hot").alias("h")).select("rep", "h.*").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    meet = tight.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    close = staged(meet.join(sets, "rep").groupBy("value", "x", "y").applyInArrow(_forest(percent), "a long, b long").distinct(), "hot-links")

    def confirmed(pairs_: DataFrame) -> DataFrame:
        x = lambda c: sets.select(F.col("rep").alias(c), F.col("set").alias(f"x{c}"))
        return pairs_.join(x("a"), "a").join(x("b"), "b").select("a", "b", "xa", "xb").mapInArrow(lambda it: _confirm(it, percent), "a long, b long")

    # Each document is first held against its smallest candidate; of the other pairs, only those are left whose documents are still apart.
    first = staged(confirmed(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).union(close), "first-links")
    near = components(first)
    part = lambda c: near.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    apart = likely.join(part("a"), "a", "left").join(part("b"), "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    return first.union(staged(confirmed(apart), "more-links"))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked if 100 * shared >= percent * united shingles. A text
    without words links with nothing. Rows that share an id count as one
    document, whose component is that of all its texts. A row without an id
    stays alone: its component is null and it is kept. `exact` finds every
    link, at the price of lists as long as a fifth of the sets (at 80 percent).
    """
    known = staged(sketches(documents, words, (lambda size: exact_prefix(size, percent)) if exact else (lambda size: LOW)), "sketches")
    worded = known.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "print")
    first = worded.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    repeated = worded.join(first.filter("many > 1"), "print").select("doc_id", "rep")
    # An id with several texts ties their classes together.
    several = worded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    tied = worded.join(several, "doc_id").join(first, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(links(documents, known, words, percent, exact).union(tied))
    to = repeated.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    of = joined.select(F.col("node").alias("doc_id"), "component").union(to).groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = known.select("doc_id", "n_shingles").join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def select_kept(documents: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, that of the smallest id, with all its columns; of rows that repeat its id, the least text.

    Rows without an id stay.
    """
    narrow = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kept = near_duplicates(narrow, words, percent).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = documents.filter(F.col(key).isNotNull()).select(F.struct("*").alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))
    chosen = named.join(kept, "doc_id").withColumn("rank", rank).filter("rank = 1").select("row.*")
    return chosen.unionByName(documents.filter(F.col(key).isNull()))
