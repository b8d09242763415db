"""Merkle manifest against a tree built by hand; proofs; nulls, ties, empty tables, clashing names."""

import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from arealis.llm import manifest

SCHEMA = "doc_id long, text string, lang string, leaf long"
ODD = [(1, None, None, 7), (2, "", "en", 7), (3, "é" * 5, "en", 7), (3, "é" * 5, "en", 7), (None, "x", "en", 7),
       (3, "other", "en", 7), (4, "word " * 60_000, "fr", 7)]


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root, and for every node its siblings up to it."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i // 8 * 8
            proofs[k] += [d for j, d in enumerate(nodes[first:first + 8], first) if j != i]
            at[k] = i // 8
        nodes = [sha(nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def by_hand(rows):
    """rows: (group, order, digest); returns root and a sorted list of (group, order, digest, subroot, proof)."""
    key = lambda v: (v is not None, v)
    rows = sorted(rows, key=lambda r: (key(r[0]), key(r[1]), r[2]))
    groups = [(g, list(of)) for g, of in groupby(rows, key=lambda r: r[0])]
    made = [tree([d for _, _, d in of]) for _, of in groups]
    root, above = tree([m[0] for m in made])
    return root, [(g, o, d, sub, "".join(p + above[k])) for k, ((_, of), (sub, proofs)) in enumerate(zip(groups, made))
                  for (g, o, d), p in zip(of, proofs)]


@pytest.mark.parametrize("sizes, levels", [([1], 3), ([8], 1), ([9, 1], 1), ([73, 3, 64, 65], 2), ([600, 1, 2], 3),
                                           ([1] * 70, 1)])
def test_tree_by_hand(spark, sizes, levels):
    rng = random.Random(len(sizes))
    rows = [(None if g == 0 else f"g{g:03d}", i, sha([str(rng.random())])) for g, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, doc_id long, d string").repartition(5)
    made = manifest.manifest(df, "d", ["doc_id"], "lang", levels)
    got = made.withColumn("back", manifest.folded_root(F.col("leaf"))).collect()
    root, want = by_hand(rows)
    key = lambda r: (r[0] or "", r[1])
    assert sorted(((r.lang, r.doc_id, r.leaf, r.subroot, r.proof) for r in got), key=key) == sorted(want, key=key)
    assert {r.root for r in got} == {root} == {r.back for r in got}


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    fields = [F.col(c) for c in ("doc_id", "lang", "text")]
    made = manifest.manifest(df.withColumn("hash", manifest.record_digest(fields)), "hash", ["doc_id"], "lang")
    got = made.withColumns({"back": manifest.folded_root(F.col("leaf")),
                            "forged": manifest.folded_root(F.sha2(F.col("text"), 256))}).collect()
    coded = [(r[2], r[0], sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[2], r[1]))) for r in ODD]
    root, want = by_hand(coded)
    assert sorted((r.leaf, r.subroot, r.proof) for r in got) == sorted((d, s, p) for _, _, d, s, p in want)
    assert all(r.root == root == r.back and r.forged != root for r in got)  # a null text's forged leaf is null
    assert made.columns == ["doc_id", "text", "lang", *manifest.RESULTS]  # the old column named leaf is replaced


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, d string")
    assert manifest.manifest(df, "d", ["doc_id"], "lang").count() == 0


def test_proofs_of_another_length_lead_nowhere():
    a, b = sha(["a"]), sha(["b"])
    assert manifest.folded(a, b, 0, 2, 0, 1) == sha([a, b])
    assert manifest.folded(a, b + b, 0, 2, 0, 1) is None
    assert manifest.folded(a, b, 0, 1, 0, 1) is None
