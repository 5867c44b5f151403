"""A Merkle manifest of a table by cogrouped subtree exchange.

Rows are leaves of one tree per group (language), in order of their id; the
groups' roots are the leaves of one more tree. Positions are dealt out by a
range-partitioned sort and counts per partition, so no group is gathered.
Aligned runs of ``fan ** height`` positions are superblocks: each is a whole
subtree, whatever stands beside it. One pass reduces superblocks to their
roots; those are the nodes of a tree that is so many times smaller, climbed in
the same way. Then leaves and the outer nodes that their superblock needs are
cogrouped by superblock, and one function finishes the local reduction, joins
local and outer siblings to proofs, and folds leaves to the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import staged
from .units import forget

#: Nodes that become one, and levels of a superblock (4096 leaves).
FAN, HEIGHT = 2, 12
_NODE = "tree string, pos long, n long, digest string"
_OUTER = f"{_NODE}, top string, befores array<string>, afters array<string>"


def joined_digest(*digests: str) -> str:
    """Lowercase hex SHA-256 of the digests' hex texts, one after the other."""
    return sha256("".join(digests).encode()).hexdigest()


def field(c: Column | str) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column | str) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def levels_up(nodes: list[str], n: int, fan: int, height: int) -> list[list[str]]:
    """The levels above the nodes of one superblock, itself first.

    n nodes stand in the whole tree. A tree within one superblock ends at its
    root; a superblock of a larger one is always `height` levels high, its
    last node even alone being hashed anew at each.
    """
    made = [nodes]
    while len(made) <= height and (n > fan**height or len(made[-1]) > 1):
        last = made[-1]
        made.append([joined_digest(*last[i : i + fan]) for i in range(0, len(last), fan)])
    return made


def siblings(made: list[list[str]], i: int, fan: int) -> Iterator[tuple[str, str]]:
    """The digests before and after node i in its run, level by level, each as one text."""
    for level in made[:-1]:
        run = i - i % fan
        yield "".join(level[run:i]), "".join(level[i + 1 : run + fan])
        i //= fan


def folded(digest: str, before: list[str], after: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for b, a in zip(before, after):
        digest = joined_digest(b, digest, a)
    return digest


def ranked(rows: DataFrame, tree: str, order: list[str], partitions: int) -> DataFrame:
    """rows with pos (from 0 in each tree, in that order) and n, the rows of the tree.

    rows must be a written table. A range-partitioned sort deals equal orders
    together, so the last of `order` should tell rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            at = []
            for key in batch[tree].to_pylist():
                at.append(seen.get(key, 0))
                seen[key] = at[-1] + 1
            yield batch.append_column("part", pa.array([part] * len(at), pa.int32())).append_column("at", pa.array(at, pa.int64()))

    dealt = rows.repartitionByRange(partitions, tree, *order).sortWithinPartitions(tree, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = staged(dealt.mapInArrow(run, f"{fields}, part int, at long"), "merkle-order")
    counts = dealt.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("here"))  # a row for each tree and partition at most
    by = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(tree, "part", F.coalesce(F.sum("here").over(by), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy(tree)).alias("n"))
    return dealt.join(before, [tree, "part"]).withColumn("pos", F.col("before") + F.col("at")).drop("part", "at", "before")


def _block(size: int) -> Column:
    return F.floor(F.col("pos") / F.lit(size)).cast("long").alias("block")


def climb(nodes: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """tree, pos, n, digest of nodes, with top (the tree's root) and each node's siblings up to it (befores, afters)."""
    size = fan**height

    def inner(group: pd.DataFrame, outer: pd.DataFrame | None) -> pd.DataFrame:
        group = group.sort_values("pos", ignore_index=True)
        made = levels_up(list(group["digest"]), int(group["n"].iloc[0]), fan, height)
        top, befores, afters = (made[-1][0], [], []) if outer is None else (outer["top"].iloc[0], list(outer["befores"].iloc[0]), list(outer["afters"].iloc[0]))
        own = [list(siblings(made, i, fan)) for i in range(len(group))]
        return group[["tree", "pos", "n", "digest"]].assign(top=top, befores=[[b for b, _ in x] + befores for x in own], afters=[[a for _, a in x] + afters for x in own])

    nodes = nodes.select("tree", "pos", "n", "digest", _block(size))
    if (nodes.agg(F.max("n")).first()[0] or 0) <= size:
        return nodes.groupBy("tree", "block").applyInPandas(lambda g: inner(g, None), _OUTER)
    outer = climb(staged(reduced(nodes, fan, height), "merkle-nodes"), fan, height).withColumn("block", F.col("pos"))
    return nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(inner, _OUTER)


def reduced(nodes: DataFrame, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """The roots of the superblocks of nodes (tree, pos, n, digest, block), as nodes of a smaller tree."""
    size = fan**height

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        n = int(group["n"].iloc[0])
        return pd.DataFrame({"tree": group["tree"].iloc[:1], "pos": group["block"].iloc[:1], "n": [-(-n // size)], "digest": [levels_up(list(group["digest"]), n, fan, height)[-1][0]]})

    return nodes.groupBy("tree", "block").applyInPandas(run, _NODE)


def manifest(leaves: DataFrame, partitions: int | None = None, fan: int = FAN, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of leaves.

    leaves: doc_id, group (null is a group of its own and comes first), leaf
    and tried, the leaf to fold. Leaves of a group ascend by doc_id, null
    first, equal ids by leaf; rows that repeat whole are leaves each. An
    empty table gives no rows. verified: whether tried folds to the root.
    """
    spark, size = leaves.sparkSession, fan**height
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A null group sorts first, before the empty name.
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("")).alias("tree"), "doc_id", "leaf", "tried", F.monotonically_increasing_id().alias("row"))
    nodes = ranked(staged(rows, "merkle-leaves"), "tree", ["doc_id", "leaf", "row"], partitions).select("*", _block(size))
    blocks = staged(reduced(nodes.select("tree", "pos", "n", F.col("leaf").alias("digest"), "block"), fan, height), "merkle-blocks")
    outer = staged(climb(blocks, fan, height), "merkle-outer")
    tops = staged(outer.filter("pos = 0").select(F.lit("").alias("all"), "tree", F.col("top").alias("digest")), "merkle-subroots")
    groups = ranked(tops, "all", ["tree"], partitions).select("tree", F.col("all"), "pos", "n", "digest")
    above = climb(groups.select(F.col("all").alias("tree"), "pos", "n", "digest"), fan, height)
    above = groups.select(F.col("tree").alias("group_tree"), "pos").join(above.select("pos", F.col("top").alias("root"), F.col("befores").alias("b2"), F.col("afters").alias("a2")), "pos").drop("pos")
    needed = outer.join(above, F.col("tree") == F.col("group_tree")).select(
        "tree", F.col("pos").alias("block"), F.col("top").alias("subroot"), "root", F.concat("befores", "b2").alias("befores"), F.concat("afters", "a2").alias("afters"))

    def finish(group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", ignore_index=True)
        made = levels_up(list(group["leaf"]), int(group["n"].iloc[0]), fan, height)
        subroot, root, befores, afters = (outer[c].iloc[0] for c in ("subroot", "root", "befores", "afters"))
        tail = "".join(b + a for b, a in zip(befores, afters))
        proofs, roots = [], []
        for i, tried in enumerate(group["tried"]):
            own = list(siblings(made, i, fan))
            proofs.append(sha256(("".join(b + a for b, a in own) + tail).encode()).hexdigest())
            roots.append(folded(folded(tried, *zip(*own)) if own else tried, befores, afters))
        forget()
        return pd.DataFrame({"doc_id": group["doc_id"], "leaf": group["leaf"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": roots, "verified": [r == root for r in roots]})

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    own = nodes.select("tree", "block", "pos", "n", F.col("doc_id").cast("string").alias("doc_id"), "leaf", "tried")  # pandas has no long that can be null
    done = own.groupBy("tree", "block").cogroup(needed.groupBy("tree", "block")).applyInPandas(finish, schema)
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def document_leaves(documents: DataFrame) -> DataFrame:
    """doc_id, group, leaf, tried of documents: tried has n_chars + 1 where 7 divides crc32 of doc_id; null lengths and ids stay."""
    first = [F.col(c) for c in ("doc_id", "source", "lang")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("group"), leaf(*first, "n_chars", "text").alias("leaf"),
                            F.when(tampered & F.col("n_chars").isNotNull(), leaf(*first, F.col("n_chars") + 1, "text")).alias("tried")).withColumn("tried", F.coalesce("tried", "leaf"))
