"""Quality rules with cross-document line frequency.

Two kinds of rules. Within a text: its words, symbols, repeated lines and
repeated 8-word windows. Across texts: every line is normalised and hashed,
the distinct documents of a host that hold it are counted, lines above the
limit are removed, and a document that they leave depleted is rejected.
``judge`` gives the verdicts, ``select_kept`` the texts without those lines.

A line is frequent in a host if at least ``least`` distinct documents of the
host hold it, however many documents the host has, so more rows never make a
line acceptable. The first document that holds it keeps it, so that of a group
of copies the first stays whole. A document is depleted if fewer than
``left_share`` of its words stand outside removed lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import staged
from .units import forget

#: Production limits.
LEAST_DOCS, LEFT_SHARE = 100, 0.25
#: Fixed values of the base rules.
WINDOW, MIN_WORDS, REPEAT_PERCENT, SYMBOLS = 8, 20, 30, b"#*$%&|<>"

_BASE = "doc_id long, host string, text_key binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_LINES = f"{_BASE}, lines array<struct<line_key: long, words: int>>"


def repeated_words(words: list) -> int:
    """Words inside windows of WINDOW words that occur twice or more, the first one included.

    Windows are told apart exactly: ranks of 1, 2, 4 and 8 words by doubling,
    given up as soon as no window of a shorter length repeats.
    """
    n = len(words)
    if n < WINDOW + 1:
        return 0
    known: dict = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    step = 1
    while step < WINDOW:
        pairs = rank[:-step] * (n + 1) + rank[step:]
        unique, rank = np.unique(pairs, return_inverse=True)
        if len(unique) == len(pairs):
            return 0
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def line_keys(raw: bytes) -> Iterator[tuple[bytes, int | None, int]]:
    """Every line of a text with the key of its normalised form and its words; blank lines have no key."""
    for line in raw.split(b"\n"):
        parts = line.lower().split()
        yield line, int.from_bytes(hashlib.blake2b(b" ".join(parts), digest_size=8).digest(), "little", signed=True) if parts else None, len(parts)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base counts of each text, and its distinct normalised lines with their words."""
    forget()
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("text_key", pa.binary()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                        ("lines", pa.list_(pa.struct([("line_key", pa.int64()), ("words", pa.int32())])))])
    for batch in batches:
        rows: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, host, text in zip(batch["doc_id"].to_pylist(), batch["host"].to_pylist(), batch["text"].cast(pa.binary())):
            raw = text.as_py()
            words = raw.split()  # bytes split on space and 0x09 to 0x0D only
            joined = b"".join(words)
            lines, found = [], {}
            for line, key, n in line_keys(raw):
                if key is not None:
                    lines.append(line)
                    found[key] = found.get(key, 0) + n
            rows["doc_id"].append(doc_id)
            rows["host"].append(host)
            rows["text_key"].append(hashlib.md5(raw).digest())
            rows["n_words"].append(len(words))
            rows["word_chars"].append(len(joined.decode("utf-8")))
            rows["n_symbols"].append(len(joined) - len(joined.translate(None, SYMBOLS)))
            rows["n_dup_lines"].append(len(lines) - len(set(lines)))
            rows["n_repeat_words"].append(repeated_words(words))
            rows["lines"].append([{"line_key": k, "words": v} for k, v in found.items()])
        yield pa.RecordBatch.from_pydict(rows, schema=schema)


def measure(documents: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, host, text_key, the base counts, and lines (line_key, words).

    A null text is empty, a null host a host of its own. Lines are normalised
    by ASCII lower case and single spaces; blank lines have no key.
    """
    return documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(_measure, _LINES)


def frequent_lines(measured: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """host, line_key, n_docs, first_doc of the lines in at least `least` distinct documents of their host; rows without an id count as one document."""
    one = measured.select("doc_id", "host", F.explode("lines").alias("line")).select("doc_id", "host", "line.line_key").distinct()
    return one.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).filter(F.col("n_docs") >= least)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def removed_lines(measured: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """k1, k2, k3 (doc_id, text_key, host), gone (words) and gone_keys of the lines that rows lose: frequent in their host and first in another document."""
    line = measured.select("doc_id", "text_key", "host", F.explode("lines").alias("line")).select("doc_id", "text_key", "host", "line.*")
    found = line.join(frequent_lines(measured, least), ["host", "line_key"]).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = found.groupBy("doc_id", "text_key", "host", "line_key").agg(F.max("words").alias("words"))
    return gone.groupBy(F.col("doc_id").alias("k1"), F.col("text_key").alias("k2"), F.col("host").alias("k3")).agg(F.sum("words").alias("gone"), F.collect_list("line_key").alias("gone_keys"))


def judge_keys(measured: DataFrame, least: int = LEAST_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """doc_id, text_key, host, base counts, words_left (outside removed lines), base_failed, kept and gone_keys (of its removed lines), one row per row of measured.

    A row is known by doc_id and text_key, so rows that repeat whole get the
    same verdict each. A text without words fails the base rules.
    """
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0))
    joined = measured.drop("lines").join(removed_lines(measured, least), F.col("doc_id").eqNullSafe(F.col("k1")) & (F.col("text_key") == F.col("k2")) & (F.col("host") == F.col("k3")), "left")
    return joined.select(
        "doc_id", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", left.alias("words_left"), base_failed().alias("base_failed"),
        (~base_failed() & (left >= left_share * F.col("n_words"))).alias("kept"), "gone_keys")


def judge(measured: DataFrame, **limits) -> DataFrame:
    """Base counts and verdict of every row of measured, as judge_keys gives them, without the keys."""
    return judge_keys(staged(measured, "line-measures"), **limits).drop("text_key", "host", "gone_keys")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has lost the lines of gone_keys; its other lines, blank ones too, stay byte for byte."""
    forget()
    for batch in batches:
        texts = batch["text"]
        if batch["gone_keys"].null_count < len(batch):
            changed = []
            for text, keys in zip(texts.cast(pa.binary()), batch["gone_keys"]):
                raw, gone = text.as_py(), set(keys.as_py() or ())
                changed.append(b"\n".join(line for line, k, _ in line_keys(raw) if k not in gone) if gone else raw)
            texts = pa.array(changed, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch["row"], texts], names=["row", "text"])


def select_kept(documents: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows of documents that the rules keep, with all their columns, their texts without the lines removed from them.

    A text that loses no line stays as it is.
    """
    verdict = judge_keys(staged(measure(documents, key, host, text), "line-measures"), **limits).filter(~F.col("kept") | F.col("gone_keys").isNotNull())
    verdict = verdict.groupBy(F.col("doc_id").alias("v1"), F.col("text_key").alias("v2"), F.col("host").alias("v3")).agg(F.first("kept").alias("kept"), F.first("gone_keys").alias("gone_keys"))
    rows = documents.select(F.struct(*[c for c in documents.columns if c != text]).alias("row"), F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("k"),
                            F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("t"), F.coalesce(F.col(host), F.lit("")).alias("h"))
    kept = rows.join(verdict, F.col("k").eqNullSafe(F.col("v1")) & (F.col("t") == F.col("v2")) & (F.col("h") == F.col("v3")), "left").filter(F.coalesce("kept", F.lit(True)))
    fields = kept.select("row", "text", "gone_keys")
    cut = fields.mapInArrow(_without, fields.select("row", "text").schema)
    return cut.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns])
