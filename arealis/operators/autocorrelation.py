"""Moran's I with a permutation test, on a neighbour table.

Permutations are a keyed bijection on node numbers (swap-or-not rounds), so none is written out: as long as the values
of all nodes fit into a task (``NODES_HELD``), every edge is read once, and a task adds up its edges' products under all
permutations. Tasks have the edges of neighbouring numbers, so that each node is permuted in few of them. Beyond that,
permuted values are dealt out by a shuffle, a few permutations at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..session import cut_lineage, step
from .regression import Fit, Spec, fit_many
from .spatial import spatial_lag, standardise_edges

MORAN = "n bigint, morans_i double, expected_i double, perm_p double"
NODES_HELD = 1 << 23  # nodes whose values a task may hold, two columns at a time: 128 MB
NODES_COLLECTED = 1 << 16  # nodes that are numbered by the driver
EDGES_HELD = 1 << 20  # edges that a task adds up at once
NODES_A_TASK = 1 << 13  # nodes in whose order edges are dealt to tasks
PERMUTED_AT_ONCE = 1 << 13  # node numbers, so that the rounds stay in the processor's cache
ROWS_DEALT = 1 << 25  # rows of permuted values that are written at a time
FACTORS = (1_103_515_245, 1_664_525)  # odd; products with 28-bit numbers stay in a signed long


def round_keys(n: int, permutation: int, seed: int) -> list[tuple[int, int]]:
    """(pivot, salt) of each round; permutation 0 is the identity."""
    if permutation == 0 or n < 2:
        return []
    digests = (hashlib.md5(f"{seed}|{permutation}|{r}".encode()).hexdigest() for r in range(8 + 2 * (n - 1).bit_length()))
    return [(int(d[:7], 16) % n, int(d[7:14], 16)) for d in digests]


def permuted(x: np.ndarray, n: int, keys: list[tuple[int, int]]) -> np.ndarray:
    """Positions of node numbers: in each round a number and its partner change places or do not, by one hashed bit."""
    if n >= 1 << 28:
        return _permuted_wide(np.asarray(x, np.int64), n, keys)
    out = np.array(x, np.int32)
    for k in range(0, len(out), PERMUTED_AT_ONCE):
        _permute_in_place(out[k:k + PERMUTED_AT_ONCE], n, keys)
    return out


def _permuted_wide(x: np.ndarray, n: int, keys: list[tuple[int, int]]) -> np.ndarray:
    for pivot, salt in keys:
        other = (pivot - x) % n
        h = ((np.maximum(x, other) ^ salt) * FACTORS[0] + salt) & 0x7FFFFFFF
        h = ((h ^ (h >> 15)) * FACTORS[1]) & 0x7FFFFFFF
        x = np.where((h >> 13) & 1, other, x)
    return x


def _permute_in_place(x: np.ndarray, n: int, keys: list[tuple[int, int]]) -> None:
    """The same in 32 bits: the hash's low 31 bits do not depend on higher ones."""
    other, bit, h = np.empty_like(x), np.empty_like(x), np.empty(len(x), np.uint32)
    size, first, second = np.int32(n), np.uint32(FACTORS[0]), np.uint32(FACTORS[1])
    for pivot, salt in keys:
        np.subtract(np.int32(pivot), x, out=other)
        np.right_shift(other, 31, out=bit)
        np.bitwise_and(bit, size, out=bit)
        np.add(other, bit, out=other)
        np.maximum(x, other, out=bit)
        np.bitwise_xor(bit.view(np.uint32), np.uint32(salt), out=h)
        np.multiply(h, first, out=h)
        np.add(h, np.uint32(salt), out=h)
        np.bitwise_and(h, np.uint32(0x7FFFFFFF), out=h)
        np.right_shift(h, np.uint32(15), out=bit.view(np.uint32))
        np.bitwise_xor(h, bit.view(np.uint32), out=h)
        np.multiply(h, second, out=h)
        # bit 13 as a mask of all bits or none
        np.left_shift(h, np.uint32(18), out=h)
        np.right_shift(h.view(np.int32), 31, out=bit)
        np.bitwise_xor(other, x, out=other)
        np.bitwise_and(other, bit, out=other)
        np.bitwise_xor(x, other, out=x)


def _products(edges: DataFrame, z: np.ndarray, permutations: int, seed: int) -> DataFrame:
    """(perm, s0 .., w): sums of w z z over ``edges`` (i, j, w) under each permutation; ``z`` has a row per column."""
    held, n = edges.sparkSession.sparkContext.broadcast(z), z.shape[1]
    names = [f"s{c}" for c in range(len(z))]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, total, parts, size, weight = held.value, np.zeros((permutations + 1, len(names))), [], 0, 0.0

        def add() -> None:
            i, j, w = (np.concatenate([p[c] for p in parts]) for c in range(3))
            ends, at = np.unique(np.concatenate([i, j]), return_inverse=True)  # each node is permuted once
            i, j = at[:len(i)], at[len(i):]
            for k in range(permutations + 1):
                mine = z[:, permuted(ends, n, round_keys(n, k, seed))]
                for c, v in enumerate(mine):
                    total[k, c] += (v[i] * v[j]) @ w

        for batch in batches:
            parts.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "w")))
            size, weight = size + batch.num_rows, weight + parts[-1][2].sum()
            if size >= EDGES_HELD:
                add()
                parts, size = [], 0
        if size:
            add()
        if weight:
            yield pa.RecordBatch.from_pydict({"perm": pa.array(range(permutations + 1), pa.int32()), **{
                c: total[:, k] for k, c in enumerate(names)}, "w": np.full(permutations + 1, weight)})

    sums = edges.mapInArrow(fn, f"perm int, {', '.join(f'{c} double' for c in names)}, w double")
    return sums.groupBy("perm").agg(*[F.sum(c).alias(c) for c in (*names, "w")])


def _numbered(known: DataFrame, key: str) -> DataFrame:
    """``known`` with ``at``, a number from 0 in the order of keys: places in sorted partitions and the counts of these."""
    placed = step(known.orderBy(key).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    starts, upto = {}, 0
    for r in sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts[r["p"]], upto = upto, upto + r["n"]
    offsets = F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)])
    return placed.select(*known.columns, (offsets[part] + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"))


def _rows_of_held(known: DataFrame, n: int, edges: DataFrame, key: str, columns: list[str], permutations: int, seed: int) -> list[tuple]:
    """(variable, n, I, its expectation, p) where the values of all nodes are held: numbers follow the order of keys."""
    names = [f"x{c}" for c in range(len(columns))]
    if n <= NODES_COLLECTED:
        values = known.toArrow().sort_by(key)
        values = values.append_column("at", pa.array(np.arange(n)))
        ends = edges.sparkSession.createDataFrame(values.select([key, "at"])) if n else None
    else:
        nodes = _numbered(known, key)
        values, ends = nodes.drop(key).toArrow(), nodes.select(key, "at")
    x = np.empty((len(columns), n))
    for c, name in enumerate(names):
        x[c, values.column("at").to_numpy()] = values.column(name).to_numpy()
    live = [c for c in range(len(columns)) if n >= 2 and x[c].min() != x[c].max()]
    rows = [(name, n, None, None, None) for c, name in enumerate(columns) if c not in live]
    if not live:
        return rows
    z = x[live] - x[live].mean(axis=1, keepdims=True)
    of_source = F.sum("w").over(Window.partitionBy("src"))
    inner = (edges.join(ends.withColumnsRenamed({key: "dst", "at": "j"}), "dst")
             .join(ends.withColumnsRenamed({key: "src", "at": "i"}), "src").select("i", "j", (F.col("w") / of_source).alias("w")))
    # few bytes and much work: a task for every run of nodes
    dealt = inner.repartitionById(-(-n // NODES_A_TASK), F.floor(F.col("i") / NODES_A_TASK).cast("int"))
    ei, most = -1.0 / (n - 1), max(1, 2 * NODES_HELD // n)
    for first in range(0, len(live), most):
        part = z[first:first + most]
        got = sorted(_products(dealt, part, permutations, seed).collect())
        for k, c in enumerate(live[first:first + most]):
            i = np.array([n / r["w"] * r[f"s{k}"] for r in got]) / (part[k] @ part[k])
            p = (np.sum(np.abs(i[1:] - ei) >= abs(i[0] - ei) - 1e-12) + 1) / (permutations + 1) if got else None
            rows.append((columns[c], n, float(i[0]), ei, float(p)) if got else (columns[c], n, None, None, None))
    return rows


def permuted_positions(nodes: DataFrame, key: str, permutations: int, seed: int,
                       bucket_digits: int = 2, first: int = 0) -> DataFrame:
    """(perm, key, position): for each permutation ``first``..P the nodes in the order of a hash.

    Hash order is cut by leading hex digits, so no task orders all nodes of a permutation;
    the counts of those buckets give every bucket its offset.
    """
    tagged = nodes.select(key, F.explode(F.sequence(F.lit(first), F.lit(permutations))).alias("perm"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col(key).cast("string"))
    hashed = tagged.withColumn("h", F.md5(text)).withColumn("b", F.substring("h", 1, bucket_digits))
    along = Window.partitionBy("perm").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (hashed.groupBy("perm", "b").agg(F.count(F.lit(1)).alias("c"))
               .select("perm", "b", F.coalesce(F.sum("c").over(along), F.lit(0)).alias("start")))
    place = F.row_number().over(Window.partitionBy("perm", "b").orderBy("h", key))
    return hashed.join(offsets, ["perm", "b"]).select(
        "perm", key, (F.col("start") + place).alias("position"))


def morans_i(values: DataFrame, edges: DataFrame, key: str, value: str, permutations: int = 999,
             seed: int = 42) -> DataFrame:
    """One row: n, I, its expectation and the two-sided permutation p.

    Nodes without a value are left out and the weights of the others made to sum to one
    again. Without spread or without edges the statistics are missing. Without permutations
    p is missing.
    """
    known = values.where(finite(value).isNotNull())
    return morans_of_complete(known, edges, key, [value], permutations, seed).drop("variable")


def morans_of_complete(values: DataFrame, edges: DataFrame, key: str, columns: list[str], permutations: int = 999,
                       seed: int = 42) -> DataFrame:
    """A row per column, for nodes that have a value in all of them: the permutations are drawn once."""
    spark, kind = values.sparkSession, f"variable string, {MORAN}"
    x = [f"x{i}" for i in range(len(columns))]
    known = cut_lineage(values.select(key, *[finite(c).alias(n) for c, n in zip(columns, x)]))
    held = known.count() if permutations else None
    if permutations and held <= NODES_HELD:
        rows = _rows_of_held(known, held, edges, key, columns, permutations, seed)
        names = ("variable", "n", "morans_i", "expected_i", "perm_p")
        types = (pa.string(), pa.int64(), *[pa.float64()] * 3)
        return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], of) for i, (c, of) in enumerate(zip(names, types))}))
    s = known.agg(F.count(F.lit(1)).alias("n"), *[
        f(n).alias(f"{name}_{n}") for n in x for name, f in (
            ("m", F.avg), ("v", F.var_pop), ("lo", F.min), ("hi", F.max))]).first()
    n = s["n"]
    live = [i for i, c in enumerate(x) if n >= 2 and s[f"lo_{c}"] != s[f"hi_{c}"]]
    flat = spark.createDataFrame([(c, n, None, None, None) for i, c in enumerate(columns) if i not in live], kind)
    if not live:
        return flat
    z = known.select(key, *[(F.col(x[i]) - s[f"m_{x[i]}"]).alias(f"z{i}") for i in live])
    ei = -1.0 / (n - 1)
    if not permutations:
        got = _statistics(z, edges, key, {f"z{i}": s[f"v_{x[i]}"] for i in live}, n)
        return flat.unionByName(spark.createDataFrame(
            [(columns[i], n, got[f"z{i}"], None if got[f"z{i}"] is None else ei, None) for i in live], kind))
    i_k = _statistics_of_many(z, edges, key, {f"z{i}": s[f"v_{x[i]}"] for i in live}, n, permutations, seed)
    first = i_k.where("perm = 0").first()
    if first is None:
        return flat.unionByName(spark.createDataFrame([(columns[i], n, None, None, None) for i in live], kind))
    hits = i_k.agg(*[F.count(F.when((F.col("perm") > 0) & (
        F.abs(F.col(f"i_z{i}") - ei) >= abs(first[f"i_z{i}"] - ei) - 1e-12), 1)).alias(f"k{i}") for i in live]).first()
    rows = [(columns[i], n, first[f"i_z{i}"], ei, (hits[f"k{i}"] + 1) / (permutations + 1)) for i in live]
    return spark.createDataFrame(rows, kind).unionByName(flat)


def _statistics(z: DataFrame, edges: DataFrame, key: str, spread: dict[str, float], n: int) -> dict[str, float | None]:
    """I of each column, without an order of nodes: neighbours' weighted means are one row per source."""
    lag = (edges.join(z.withColumnRenamed(key, "dst"), "dst").groupBy(F.col("src").alias(key))
           .agg(F.sum("w").alias("__w"), *[F.sum(F.col("w") * F.col(c)).alias(f"l{c}") for c in spread]))
    sums = lag.join(z, key).agg(F.count(F.lit(1)).alias("w"), *[
        F.sum(F.col(c) * F.col(f"l{c}") / F.col("__w")).alias(c) for c in spread]).first()
    return {c: n / sums["w"] * sums[c] / (v * n) if sums["w"] else None for c, v in spread.items()}


def _statistics_of_many(z: DataFrame, edges: DataFrame, key: str, spread: dict[str, float], n: int, permutations: int,
                        seed: int) -> DataFrame:
    """(perm, i_z ..) for more nodes than a task may hold: permuted values are joined with the edges.

    Permutation 0 gives every node its number; under permutation k a node takes the values of the node whose number
    is its position. As many permutations are dealt at a time as make ``ROWS_DEALT`` rows, so disk does not grow with
    their number.
    """
    zs, rows = list(spread), []
    inner = cut_lineage(standardise_edges(
        edges.join(z.select(F.col(key).alias("src")), "src", "left_semi")
        .join(z.select(F.col(key).alias("dst")), "dst", "left_semi")))
    numbered = cut_lineage(permuted_positions(z, key, 0, seed).join(z, key).select("position", *zs))
    at_once = max(1, ROWS_DEALT // n)
    for low in range(1 - at_once, permutations + 1, at_once):
        if low < 1:
            drawn = z.select(F.lit(0).alias("perm"), key, *zs)
        else:
            place = permuted_positions(z, key, min(low + at_once - 1, permutations), seed, first=low)
            drawn = place.join(numbered, "position").select("perm", key, *zs)
        src = drawn.select("perm", F.col(key).alias("src"), *[F.col(c).alias(f"s{c}") for c in zs])
        dst = drawn.select("perm", F.col(key).alias("dst"), *[F.col(c).alias(f"d{c}") for c in zs])
        # neighbours' weighted mean of each node first: one row per node and permutation remains
        lag = (inner.join(dst, "dst").groupBy("perm", "src")
               .agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"d{c}")).alias(f"l{c}") for c in zs]))
        rows += lag.join(src, ["perm", "src"]).groupBy("perm").agg(*[
            (n / F.sum("w") * F.sum(F.col(f"s{c}") * F.col(f"l{c}")) / (v * n)).alias(f"i_{c}") for c, v in spread.items()]).collect()
    return z.sparkSession.createDataFrame(rows, f"perm int, {', '.join(f'i_{c} double' for c in zs)}")


def autocorrelation_table(df: DataFrame, edges: DataFrame, key: str,
                          targets: list[tuple[str, str]], permutations: int = 999, seed: int = 42,
                          max_missing: int = 5, digits: int = 3) -> DataFrame:
    """Moran's I of each column with at most ``max_missing`` areas without a value.

    Columns without missing values share their orderings.
    """
    have = [(c, label) for c, label in targets if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(finite(c)).alias(c) for c, _ in have]).first()
    wanted = [(c, label) for c, label in have if counts[c] >= counts["__n"] - max_missing]
    whole = [c for c, _ in wanted if counts[c] == counts["__n"]]
    parts = [morans_of_complete(df, edges, key, whole, permutations, seed)] if whole else []
    parts += [morans_i(df, edges, key, c, permutations, seed).withColumn("variable", F.lit(c))
              for c, _ in wanted if c not in whole]
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "variable string, morans_i double, expected_i double, perm_p double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = F.create_map(*[F.lit(x) for pair in wanted for x in pair])
    return out.select(names[F.col("variable")].alias("variable"), *[
        F.round(c, digits).alias(c) for c in ("morans_i", "expected_i", "perm_p")])


def residual_autocorrelation(df: DataFrame, edges: DataFrame, key: str,
                             fits: dict[str, Fit | None], **kw) -> DataFrame:
    """Moran's I of the residuals of fitted models."""
    live = {n: f for n, f in fits.items() if f is not None}
    table = cut_lineage(df.select(key, *[f.residual().alias(f"r_{i}") for i, f in enumerate(live.values())]))
    return autocorrelation_table(table, edges, key,
                                 [(f"r_{i}", n) for i, n in enumerate(live)], **kw)


def lagged_model(df: DataFrame, edges: DataFrame, key: str, outcome: str, regressors,
                 lagged: list[str], **kw) -> tuple[Fit | None, DataFrame | None]:
    """The model with neighbours' means of some columns added, and its residual Moran's I."""
    lagged = [c for c in lagged if c in df.columns]
    table = cut_lineage(spatial_lag(df, edges, key, lagged))  # read by both passes of the fit and for the residuals
    spec = Spec("lagged", outcome, (*regressors, *[f"w_{c}" for c in lagged]))
    fits = fit_many(table, [spec])
    if fits["lagged"] is None:
        return None, None
    return fits["lagged"], residual_autocorrelation(table, edges, key, fits, **kw)
