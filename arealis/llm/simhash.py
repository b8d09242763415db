"""Near copies by 64-bit SimHash: Golay-code keys find fingerprints that differ in few bits.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of the perfect [23, 12, 7] Golay
code with leading zeros. Three differing bits leave at most one error in two of the three segments (pigeonhole). A
segment is *indexed* under its nearest codeword (at most 3 bits off) and *probed* under every codeword at most 4 bits
off, 1 or 6 of them: a word one bit away has its nearest codeword among these. So for every pair of segments the
index holds one key of two codeword indices, the probes hold up to 36, an equi-join finds every pair of fingerprints
with at most three differing bits, and the exact distance is checked inside the join.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

GENERATOR = 0b101011100011  # of the binary Golay code, degree 11
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width
PAIRS = ((0, 1), (0, 2), (1, 2))
SEED = 42
_BLOCK = 1 << 16


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of a 12-bit high half, and for each syndrome up to six error patterns, the lightest first (-1: none)."""
    words = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        words ^= ((words >> bit) & 1) * (GENERATOR << (bit - 11))
    one = np.array([1 << b if b < 11 else words[1 << (b - 11)] for b in range(23)], np.int64)
    patterns = np.full((2048, 6), -1, np.int64)
    filled = np.zeros(2048, np.int64)
    patterns[0, 0], filled[0] = 0, 1
    layer = [(0, 0, -1)]
    for weight in (1, 2, 3, 4):
        layer = [(e | 1 << b, s ^ int(one[b]), b) for e, s, last in layer for b in range(last + 1, 23)]
        for e, s, _ in layer:
            # a word within two bits of a codeword has no second one within four
            if filled[s] == 0 or weight == 4 and bin(int(patterns[s, 0])).count("1") == 3:
                patterns[s, filled[s]] = e
                filled[s] += 1
    return words, patterns


def segment_codes(segment: np.ndarray) -> np.ndarray:
    """Codeword indices of 23-bit words: column 0 the nearest, the others within four bits; -1 for none."""
    high, patterns = golay_tables()
    errors = patterns[high[segment >> 11] ^ (segment & 0x7FF)]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def _codes(fingerprints: pd.Series) -> list[np.ndarray]:
    bits = fingerprints.to_numpy(np.int64).view(np.uint64)
    return [segment_codes(((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64)) for s, w in SEGMENTS]


@F.pandas_udf(T.ArrayType(T.LongType()))
def index_keys(fingerprints: pd.Series) -> pd.Series:
    codes = _codes(fingerprints)
    keys = np.stack([(k << 24) | (codes[i][:, 0] << 12) | codes[j][:, 0] for k, (i, j) in enumerate(PAIRS)], 1)
    return pd.Series(list(keys))


@F.pandas_udf(T.ArrayType(T.LongType()))
def probe_keys(fingerprints: pd.Series) -> pd.Series:
    codes, parts = _codes(fingerprints), []
    for k, (i, j) in enumerate(PAIRS):
        a, b = codes[i][:, :, None], codes[j][:, None, :]
        parts.append(np.where((a < 0) | (b < 0), -1, (k << 24) | (a << 12) | b).reshape(len(a), 36))
    keys = np.concatenate(parts, 1)
    return pd.Series([row[row >= 0] for row in keys])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles; fewer words than a shingle: of all; no word: 0."""
    words = text.encode().lower().split() if text else []  # bytes: lowers A-Z and parts at ASCII blanks only
    if not words:
        return 0
    data, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    total, n, digest = np.zeros(64, np.int64), len(ends), xxhash.xxh64_digest
    for k in range(0, n, _BLOCK):
        raw = b"".join([digest(data[a:b], SEED) for a, b in zip(starts[k:k + _BLOCK], ends[k:k + _BLOCK])])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big", signed=True)


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """SimHash of a text column as a long."""
    @F.pandas_udf(T.LongType())
    def fn(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype=np.int64)

    return fn(text)


def near_links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints that differ in at most ``bits`` (3 at most) bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find up to three differing bits")
    index = classes.select(F.col("fp").alias("v"), F.explode(index_keys("fp")).alias("key"))
    probes = classes.select(F.col("fp").alias("u"), F.explode(probe_keys("fp")).alias("key"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    joined = probes.alias("a").join(index.alias("b"), (F.col("a.key") == F.col("b.key")) & near)
    return joined.select("u", "v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node reachable over ``(u, v)`` links, for every linked node.

    Large-star and small-star steps in turn: each is a minimum by node and a join, so that a node with many links is
    never gathered; a logarithmic number of rounds, each written to the shared folder.
    """
    edges = stored(links.select("u", "v"))
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = stored(both.filter("v > u").join(least, "u").select("m", F.col("v").alias("u")).filter("u > m")
                       .select("u", F.col("m").alias("v")).distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = stored(small.select("m", F.col("v").alias("u")).union(small.select("m", "u")).filter("u > m")
                       .select(F.col("m").alias("u"), F.col("u").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 30))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def classified(rows: DataFrame, shingle_bits: int = 3) -> DataFrame:
    """``(fp, first)`` for a stored table with ``fp`` and a struct ``place``: the least place of the component."""
    classes = stored(rows.groupBy("fp").agg(F.min("place").alias("place")))
    labels = components(near_links(classes, shingle_bits)).withColumnRenamed("node", "fp")
    labelled = stored(classes.join(labels, "fp", "left").select("fp", "place",
                                                              F.coalesce("label", "fp").alias("label")))
    first = labelled.groupBy("label").agg(F.min("place").alias("first"))
    return stored(labelled.join(first, "label").select("fp", "first"))


def near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, bits: int = 3) -> DataFrame:
    """``(key, fingerprint, component_id)`` for every row.

    Equal fingerprints form one class, so that copies are never paired off. Null and empty texts have fingerprint
    zero and are linked like any other; the component's id is its smallest key (null if it has none); repeated rows
    give repeated results; an empty table gives none.
    """
    rows = stored(df.select(F.col(key).alias("key"), fingerprints(F.col(text), shingle).alias("fp")))
    rows = rows.withColumn("place", F.struct(F.col("key").isNull().alias("unkeyed"), "key"))
    groups = classified(rows, bits).select("fp", F.col("first.key").alias("component_id"))
    return rows.join(groups, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3,
                     bits: int = 3) -> DataFrame:
    """The row with the smallest key of every component, one row also where keys repeat or are null; all columns.

    Every document without words is a copy of every other one.
    """
    names = df.columns
    rows = stored(df.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
                            + [fingerprints(F.col(f"`{text}`"), shingle).alias("fp"),
                               F.monotonically_increasing_id().alias("row")]))
    order = F.col(f"c{names.index(key)}")
    placed = rows.select("fp", F.struct(order.isNull().alias("unkeyed"), order.alias("key"), "row").alias("place"))
    kept = classified(placed, bits).select(F.col("first.row").alias("row")).distinct()
    return rows.join(kept, "row", "left_semi").select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
