"""Merkle manifest of a table by time-forward processing: root, roots of groups and a proof for every row.

Every row is a leaf. Within its group the leaves are numbered in a given order; runs of ``ARITY`` consecutive nodes
become their parent until one node, the group's root, is left. The groups' roots, in the groups' order, make the
table's root in the same way.

A node's label is (tree, level, number), which orders it after all its children. Nodes are taken in the order of
labels, and a digest travels to its parent as a message in a queue ordered by the label it is addressed to. The queue is
external: a round covers ``levels`` levels, its messages are dealt out by blocks of ``ARITY ** levels`` nodes of a tree
and sorted by label (a shuffle that spills), and only messages inside one block wait in a heap. The reversed sweep
takes the labels from the root down and sends to each child the suffix of its proof: its siblings and what its
parent got. A block's size does not depend on the table, a hot group has many blocks, rounds are few
(``log(rows) / log(ARITY ** levels)``) and every round is written to the shared folder.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, without
from .sharding import ROW_NUMBER, number_rows

ARITY = 8
HEX = 64  # digits of a digest
RESULTS = ("leaf", "subroot", "root", "proof", "place", "size", "group_place", "groups")
_NODE = "tree long, n long, idx long, digest binary"
_MESSAGE = "suffix string, subroot string, group_place long"


def record_digest(columns: list[Column]) -> Column:
    """Lowercase hex sha256 over the values: ``-`` for a null, else its UTF-8 byte count, ``:`` and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def combined(digests: list[bytes]) -> bytes:
    """Digest of hex digests, in hex."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def depth(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def sweep(digests: list[bytes], first: int, levels: int) -> tuple[bytes, dict[tuple[int, int], list[bytes]]]:
    """The top digest over consecutive nodes from number ``first``, and what every inner label received."""
    queue = [((0, first + k), k, d) for k, d in enumerate(digests)]  # in order, so it is a heap
    received: dict[tuple[int, int], list[bytes]] = {}
    while True:
        label, _, digest = heapq.heappop(queue)
        if label[0]:
            mine = [digest]
            while queue and queue[0][0] == label:
                mine.append(heapq.heappop(queue)[2])
            received[label] = mine
            digest = combined(mine)
        if label[0] == levels:
            return digest, received
        heapq.heappush(queue, ((label[0] + 1, label[1] // ARITY), label[1] % ARITY, digest))


def sweep_back(received: dict[tuple[int, int], list[bytes]], first: int, n: int, levels: int,
               suffix: bytes) -> list[bytes]:
    """Proof suffixes of ``n`` nodes from number ``first``; ``suffix`` belongs to the node above them."""
    queue = [((-levels, -(first // ARITY ** levels)), suffix)]
    out = [b""] * n
    while queue:
        (level, number), suffix = heapq.heappop(queue)
        level, number = -level, -number
        if not level:
            out[number - first] = suffix
            continue
        children = received[level, number]
        for k in range(len(children)):
            message = b"".join(children[:k] + children[k + 1:]) + suffix
            heapq.heappush(queue, ((1 - level, -(number * ARITY + k)), message))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (tree, block), one table a block; only the rows of one block and one batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("tree", "block")]
        cuts = (np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            key = keys[0][a], keys[1][a]
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _hexed(digests: pa.ChunkedArray) -> list[bytes]:
    return [d.hex().encode() for d in digests.to_pylist()]


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def _block(idx: Column, levels: int) -> Column:
    return F.floor(idx / ARITY ** levels).cast("long")


def forward(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and the nodes of every round above them; the last has one row a tree, its root."""
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            tree, n, first = (block.column(c)[0].as_py() for c in ("tree", "n", "idx"))
            up = min(levels, depth(n))
            top, _ = sweep(_hexed(block.column("digest")), first, up)
            width = ARITY ** up
            yield pa.RecordBatch.from_pydict({"tree": [tree], "n": [-(-n // width)], "idx": [first // width],
                                              "digest": [bytes.fromhex(top.decode())]})

    rounds = [nodes]
    while True:
        dealt = _dealt(rounds[-1].select("tree", "n", "idx", "digest").withColumn("block", _block(F.col("idx"), levels)))
        rounds.append(stored(dealt.mapInArrow(fn, _NODE)))
        if (rounds[-1].agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds


def backward(rounds: list[DataFrame], messages: DataFrame, levels: int) -> DataFrame:
    """The first nodes with their messages; ``messages`` (tree, idx, suffix, ...) are those of the last round."""
    for at in range(len(rounds) - 2, -1, -1):
        nodes = rounds[at].withColumn("block", _block(F.col("idx"), levels))
        told = messages.withColumns({"block": F.col("idx"), "idx": F.lit(-1).cast("long")})  # before its block's nodes
        schema = T.StructType([*rounds[at].schema, *T._parse_datatype_string(_MESSAGE)])
        names = schema.names

        def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                told, block = block.slice(0, 1), block.slice(1)
                n, first = block.column("n")[0].as_py(), block.column("idx")[0].as_py()
                up = min(levels, depth(n))
                _, received = sweep(_hexed(block.column("digest")), first, up)
                rows = block.num_rows
                suffixes = sweep_back(received, first, rows, up, told.column("suffix")[0].as_py().encode())
                block = block.set_column(block.schema.get_field_index("suffix"), "suffix",
                                         pa.array([s.decode() for s in suffixes], pa.string()))
                for name, kind in (("subroot", pa.string()), ("group_place", pa.int64())):
                    block = block.set_column(block.schema.get_field_index(name), name,
                                             pa.array([told.column(name)[0].as_py()] * rows, kind))
                yield from block.select(names).to_batches()

        both = _dealt(nodes.unionByName(told, allowMissingColumns=True))
        rows = both.mapInArrow(fn, schema)
        messages = rows.select("tree", "idx", "suffix", "subroot", "group_place") if at == 0 else stored(
            rows.select("tree", "idx", "suffix", "subroot", "group_place"))
    return rows


def manifest(df: DataFrame, leaf: str, order: list[str], group: str, levels: int = 3) -> DataFrame:
    """``df`` with the leaf's digest, its group's and the table's root, and a proof.

    ``leaf`` names a column of hex sha256 digests, ``order`` gives the order of leaves within ``group`` (nulls first; equal rows
    are ordered by their digests, so that a tie shows nowhere but between rows of different digests, where it is
    settled by them). Groups are ordered by their value, null first. Added columns: ``leaf``, ``subroot``, ``root``,
    ``proof`` (siblings in hex, level by level, left to right, through the group's root to the table's), ``place``
    among the ``size`` leaves of the group, ``group_place`` among ``groups``; columns of ``df`` named so are
    replaced. A lone leaf is its group's root; repeated rows are leaves of their own; an empty table gives no rows.
    All columns of ``df`` are shuffled: pass those needed later only.
    """
    names = without(df, [*RESULTS, leaf]).columns
    kept = df.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
                     + [F.unhex(F.col(f"`{leaf}`")).alias("digest")])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    numbered = number_rows(kept, [at[group], *(at[c] for c in order), "digest"], "rows")
    start, width = F.min(ROW_NUMBER).alias("tree"), F.count("*").alias("n")
    trees = stored(numbered.groupBy(F.col(at[group]).alias("of")).agg(start, width))
    # a group's rows are numbered in a row: its first number is the name of its tree
    nodes = stored(numbered.join(trees, F.col(at[group]).eqNullSafe(F.col("of"))).drop("of", "rows")
                   .withColumn("idx", F.col(ROW_NUMBER) - F.col("tree")).drop(ROW_NUMBER))
    rounds = forward(nodes, levels)
    subroots = number_rows(rounds[-1].select(F.col("tree").alias("of"), F.col("digest")), ["of"], "n")
    subroots = stored(subroots.select(F.lit(0).cast("long").alias("tree"), "n", F.col(ROW_NUMBER).alias("idx"),
                                      "digest", "of"))
    tops = forward(subroots, levels)
    root = tops[-1].select(F.lower(F.hex("digest"))).first()  # one row a tree, here one tree
    root = root[0] if root else None
    begin = tops[-1].select("tree", "idx", F.lit("").alias("suffix"), F.lit(None).cast("string").alias("subroot"),
                            F.lit(None).cast("long").alias("group_place"))
    told = stored(backward(tops, begin, levels).select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), "suffix",
        F.lower(F.hex("digest")).alias("subroot"), F.col("idx").alias("group_place"), F.col("n").alias("groups")))
    groups = told.agg(F.max("groups")).first()[0]
    found = backward(rounds, told.drop("groups"), levels)
    return found.select(
        [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
        + [F.lower(F.hex("digest")).alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
           F.col("suffix").alias("proof"), F.col("idx").alias("place"), F.col("n").alias("size"), "group_place",
           F.lit(groups).cast("long").alias("groups")])


def folded(leaf: str, proof: str, place: int, size: int, group_place: int, groups: int) -> str | None:
    """The root that a leaf and its proof lead to; None for a proof of another length."""
    digest, siblings, at = leaf.encode(), proof.encode(), 0
    for idx, n in ((place, size), (group_place, groups)):
        while n > 1:
            first = idx // ARITY * ARITY
            run = siblings[at:at + HEX * (min(ARITY, n - first) - 1)]
            cut = HEX * (idx - first)
            digest = combined([run[:cut], digest, run[cut:]])
            at, idx, n = at + len(run), idx // ARITY, -(-n // ARITY)
    return digest.decode() if at == len(siblings) else None


def folded_root(leaf: Column) -> Column:
    """``folded`` over rows of a manifest; ``leaf`` may be the digest of a row as somebody received it."""
    @F.pandas_udf(T.StringType())
    def fn(leaves: pd.Series, proofs: pd.Series, *places: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else folded(d, p, *map(int, at))
                          for d, p, *at in zip(leaves, proofs, *places)], dtype=object)

    return fn(leaf, F.col("proof"), *map(F.col, ("place", "size", "group_place", "groups")))
