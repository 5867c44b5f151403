"""Phrase collocation mining by best-first branch and bound.

A phrase of two to four words scores floor(SCALE * a / (l + r)) at its worst
cut, with a its count and l, r the counts of the cut's parts. Growing a phrase
p to the right never gives more than SCALE * f(p) / (f(first word) + f(p)),
growing it to the left never more than SCALE * f(p) / (f(last word) + f(p)):
the cut behind the first word, or before the last, is among the cuts, and the
grown phrase is no more frequent than p. So only phrases with such a bound of
at least a limit can begin or end phrases that score it, and only these form
the frontier that a pass over the texts grows by a word.

The limit of each language starts where its pairs suggest that enough phrases
lie above it. Once the wanted number of surviving phrases, ties included,
scores the limit or more, nothing below can matter: the language is settled.
Else its limit is lowered, to nought at last, and the frontier expanded.

A phrase is dropped for a longer one of nearly its count. A part of the longer
one, one word longer than the phrase, is then at least as frequent, so growth
by one word on either side finds all reasons.

Passes know the frontier by a bit array of bounded size. It has no false
negatives, and what a false positive lets through is counted exactly, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import staged
from .units import distinct_runs, forget, slices

#: Production parameters: least count, phrases a language, percent of a longer phrase's count that drops one, longest phrase.
LEAST, TOP, DROP_PERCENT, LONGEST, SCALE = 30, 2000, 80, 4, 2_000_000
#: Phrases above a language's limit, as multiples of TOP, for which the search looks in turn; then all.
REACH = (3, 24)
#: Bits of a frontier's array for each phrase, and at most (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Bytes of text handled at once.
GROUP = 4 << 20

_BREAK, _BLANK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _BREAK
_KIND[[32, 9]] = _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Words:
    """The words of a group of texts: for each its number among the distinct ones, its text's language and whether the next is in its piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        raw = texts.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = _LOWER[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        offsets = offsets - offsets[0]
        kind = _KIND[data]
        inside = kind == 0
        self.words, self.at, starts = distinct_runs(data, inside, offsets[:-1])
        doc = np.searchsorted(offsets, starts, side="right") - 1
        names = langs.dictionary_encode()
        self.langs = names.dictionary.to_pylist()
        self.lang = names.indices.to_numpy()[doc]
        breaks = np.searchsorted(np.flatnonzero(kind == _BREAK), starts)
        self.next = np.zeros(len(starts), bool)
        self.next[:-1] = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])  # a word holds no break

    def hashes(self) -> np.ndarray:
        """Of each word with its language."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))
        lang = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs], np.uint64)
        return own[self.at] ^ (lang * _MIX[0])[self.lang] if len(self.at) else np.zeros(0, np.uint64)

    def runs(self, length: int) -> np.ndarray:
        """Numbers of the words that begin `length` words of one piece."""
        ok = np.ones(max(0, len(self.at) - length + 1), bool)
        for k in range(length - 1):
            ok &= self.next[k : k + len(ok)]
        return np.flatnonzero(ok)

    def counted(self, begins: np.ndarray, length: int) -> pa.RecordBatch:
        """lang, phrase, n of the phrases of `length` words that begin there, each once."""
        _, key = np.unique(self.lang[begins], return_inverse=True)  # dense numbers of what was seen so far, then with one word more
        for k in range(length):
            _, key = np.unique(key.astype(np.int64) * max(1, len(self.words)) + self.at[begins + k], return_inverse=True)
        n = np.bincount(key) if len(key) else np.zeros(0, np.int64)
        one = np.zeros(len(n), np.int64)
        one[key] = begins
        parts = [self.words.take(pa.array(self.at[one + k])) for k in range(length)]
        phrase = pc.binary_join_element_wise(*parts, b" ") if length > 1 else parts[0]
        return pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()).take(pa.array(self.lang[one])), phrase.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def phrase_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Of the hashes of a phrase's words, in order."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p) * _MIX[1]
        out ^= out >> np.uint64(29)
    out *= _MIX[2]
    return out ^ (out >> np.uint64(32))


def _texts(documents: DataFrame) -> DataFrame:
    """Languages and texts; a null text is empty, a null language `und`."""
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _count(texts: DataFrame, length: int, chosen: Callable[[Words], np.ndarray]) -> DataFrame:
    """lang, phrase, a: how often each phrase of `length` words occurs, of those that begin where chosen says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for group in slices(batch, "text", GROUP):
                words = Words(group["text"], group["lang"])
                yield words.counted(chosen(words), length)

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


class Frontier:
    """A set of phrases as an array of bits, sent to the workers; may hold others, never lacks one."""

    def __init__(self, phrases: DataFrame, number: int) -> None:
        """phrases: lang, phrase, all of one number of words; number: how many there are."""
        bits = min(MOST_BITS, 1 << max(10, (BITS_EACH * max(1, number) - 1).bit_length()))
        self.bits = np.uint64(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                names, phrases_ = batch["lang"].dictionary_encode(), [p.split(" ") for p in batch["phrase"].to_pylist()]
                lang = (np.array([xxhash.xxh3_64_intdigest(x) for x in names.dictionary.to_pylist()], np.uint64) * _MIX[0])[names.indices.to_numpy()]
                parts = [np.fromiter((xxhash.xxh3_64_intdigest(p[k]) for p in phrases_), np.uint64, len(phrases_)) ^ lang for k in range(len(phrases_[0]))]
                yield pa.RecordBatch.from_arrays([pa.array((phrase_hash(parts) % np.uint64(bits)).astype(np.int64))], names=["spot"])

        spots = phrases.select("lang", "phrase").mapInArrow(run, "spot long")
        # At most one row for each 8 bits of a bounded array.
        words = spots.groupBy(F.shiftright("spot", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(spot & 7 as int))")).alias("byte")).toArrow()
        array = np.zeros(bits // 8, np.uint8)
        array[words["at"].to_numpy()] = words["byte"].to_numpy().astype(np.uint8)
        self.sent = phrases.sparkSession.sparkContext.broadcast(array)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        spot = (hashes % self.bits).astype(np.int64)
        return (self.sent.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 > 0


def _grown(texts: DataFrame, length: int, begins: Frontier, ends: Frontier | None = None) -> DataFrame:
    """Counts of phrases of `length` words whose words but the last are in begins, or whose words but the first are in ends; for pairs, whose words both are in begins."""

    def chosen(words: Words) -> np.ndarray:
        hashes, at = words.hashes(), words.runs(length)
        if ends is None:
            known = begins.holds(phrase_hash([hashes])) if len(hashes) else np.zeros(0, bool)
            return at[known[at] & known[at + 1]]
        if not len(at):
            return at
        parts = [hashes[at + k] for k in range(length)]
        return at[begins.holds(phrase_hash(parts[:-1])) | ends.holds(phrase_hash(parts[1:]))]

    return _count(texts, length, chosen)


def _ratio(a: Column, total: Column) -> Column:
    """floor(SCALE * a / total), exactly."""
    scaled = (a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(31,0)")
    return F.call_function("div", scaled, total.cast("decimal(31,0)")).cast("long")


def _word(c: str, at: int) -> Column:
    return F.element_at(F.split(c, " "), at)


def _scored(grams: DataFrame, counts: DataFrame, length: int) -> DataFrame:
    """lang, phrase, length, a, l, r, score of grams (lang, phrase, a): the lowest-scoring cut, the earliest of equals.

    counts: lang, phrase, a of all shorter phrases that can be parts. A phrase with a part that is not there is not scored.
    """
    words = F.split("phrase", " ")
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), F.concat_ws(" ", F.slice(words, 1, k)).alias("left"), F.concat_ws(" ", F.slice(words, k + 1, length - k)).alias("right")) for k in range(1, length)])
    parts = grams.select("lang", "phrase", "a", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        parts = parts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    scored = parts.withColumn("score", _ratio(F.col("a"), F.col("l") + F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best"), F.count(F.lit(1)).alias("cuts"))
    return best.filter(F.col("cuts") == length - 1).select("lang", "phrase", F.lit(length).alias("length"), "a", "best.l", "best.r", "best.score")


def _bounds(grams: DataFrame, single: DataFrame) -> DataFrame:
    """lang, phrase, a, and the most that phrases begun (ahead) or ended (behind) by a phrase can score."""
    one = single.select("lang", F.col("phrase").alias("word"), F.col("a").alias("f"))
    out = grams.withColumn("first", _word("phrase", 1)).withColumn("last", _word("phrase", -1))
    for word, name in (("first", "ahead"), ("last", "behind")):
        out = out.join(one.withColumnRenamed("word", word).withColumnRenamed("f", f"f_{word}"), ["lang", word]).withColumn(name, _ratio(F.col("a"), F.col(f"f_{word}") + F.col("a")))
    return out.select("lang", "phrase", "a", "ahead", "behind")


def _level(scores: DataFrame, rank: int) -> DataFrame:
    """lang, level: the score of the rank-th phrase of each language, 0 where it has fewer; by a histogram, as scores are bounded."""
    counted = scores.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    above = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy(F.col("score").desc())))
    return above.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= rank, F.col("score"))), F.lit(0)).alias("level"))


def _survivors(scored: DataFrame, grams: dict[int, DataFrame], percent: int) -> DataFrame:
    """The scored phrases without those that a candidate one word longer drops."""
    longer = None
    for length, rows in grams.items():
        if length > 2:
            words = F.split("phrase", " ")
            parts = rows.select("lang", F.explode(F.array(F.concat_ws(" ", F.slice(words, 1, length - 1)), F.concat_ws(" ", F.slice(words, 2, length - 1)))).alias("phrase"), "a")
            longer = parts if longer is None else longer.unionByName(parts)
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return scored.join(most, ["lang", "phrase"], "left").filter(~(F.coalesce("most", F.lit(0)).cast("decimal(25,0)") * 100 >= F.col("a").cast("decimal(25,0)") * percent)).drop("most")


def mine(documents: DataFrame, least: int = LEAST, top: int = TOP, percent: int = DROP_PERCENT, reach: tuple[int, ...] = REACH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` best phrases of each language.

    A null text has no words, a null language is `und`. Rows that repeat
    count each. Ties go to the more frequent phrase, then to the first in
    byte order. A language without phrases gives no rows, nor does an empty
    table.
    """
    texts = _texts(documents)
    single = staged(_count(texts, 1, lambda w: np.arange(len(w.at))), "phrase-words")
    words = single.groupBy("lang").agg(F.sum("a").alias("n"))
    single = single.filter(F.col("a") >= least)
    pairs = staged(_grown(texts, 2, Frontier(single, single.count())).filter(F.col("a") >= least), "phrase-pairs")
    bounds = staged(_bounds(pairs, single), "phrase-bounds")
    scored2 = staged(_scored(pairs, single, 2), "phrase-scores")
    open_, found = staged(pairs.select("lang").distinct(), "phrase-languages"), []
    for wanted in (*reach, None):
        if open_.isEmpty():
            break
        own = lambda df: df.join(open_, "lang", "left_semi")
        limit = _level(own(scored2), wanted * top) if wanted else open_.withColumn("level", F.lit(0).cast("long"))
        limit = staged(limit, "phrase-limits")
        grams, edge, scores = {2: own(pairs)}, own(bounds), own(scored2)
        known = single.unionByName(grams[2])
        for length in range(3, LONGEST + 1):
            near = edge.join(limit, "lang")
            ahead, behind = near.filter(F.col("ahead") >= F.col("level")), near.filter(F.col("behind") >= F.col("level"))
            fronts = [Frontier(x, x.count()) for x in (ahead, behind)]
            grams[length] = staged(_grown(own(texts), length, *fronts).filter(F.col("a") >= least), f"phrase-{length}")
            scores = scores.unionByName(_scored(grams[length], known, length))
            known = known.unionByName(grams[length])
            if length < LONGEST:
                edge = staged(_bounds(grams[length], single), "phrase-bounds")
        left = staged(_survivors(scores, grams, percent).join(limit, "lang").filter(F.col("score") >= F.col("level")), "phrase-survivors")
        enough = left.groupBy("lang").agg(F.count(F.lit(1)).alias("k"))
        settled = staged(limit.join(enough, "lang", "left").filter((F.col("level") == 0) | (F.col("k") >= top)).select("lang"), "phrase-settled")
        found.append(left.join(settled, "lang", "left_semi"))
        open_ = staged(open_.join(settled, "lang", "left_anti"), "phrase-languages")
    rows = found[0] if found else scored2
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(_level(rows, top).withColumnRenamed("level", "least"), "lang").filter(F.col("score") >= F.col("least"))
    by = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
