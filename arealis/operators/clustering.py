"""k-means with all starts in shared passes, and the Euclidean silhouette in blocks.

``rows`` are (h, v): a hash that tells rows apart and an array of doubles. A pass reads the rows once for every live pair of
k and start; a task returns sums per cluster, never rows. Centres are small (k x dimensions a pair) and known to the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import step

Centres = np.ndarray  # (k, dimensions)
CANDIDATES = 3  # draws for each further seed, of which the one with the least cost is taken
ROUNDS, TOLERANCE = 20, 1e-4
BLOCK, ROWS_AT_ONCE = 2_048, 256  # distances of the silhouette that are taken at once
GROUP_BYTES = 32 * 1024 * 1024  # vectors that a task of the silhouette holds, twice
COLLECTED = 64  # tasks whose sums the driver adds up itself


def _matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def squared_distances(x: np.ndarray, centres: Centres) -> np.ndarray:
    """(rows, centres), never below zero."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return np.maximum(d, 0.0)


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) from row hashes and whole numbers (a 64-bit finaliser)."""
    x = h.astype(np.uint64)
    for s in salt:
        x = x + np.uint64((0x9E3779B97F4A7C15 * (s + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _pass(rows: DataFrame, fold: Callable, schema: str, merged: Callable[[DataFrame], DataFrame]) -> list:
    """One pass: ``fold(batches)`` yields a task's partial rows; few tasks' rows are merged on the driver by the caller."""
    partial = rows.mapInArrow(fold, schema)
    return (partial if rows.rdd.getNumPartitions() <= COLLECTED else merged(partial)).collect()


# -- seeding

def seeds(rows: DataFrame, k: int, starts: int, seed: int) -> list[Centres]:
    """``k`` seeds for each start by greedy weighted draws: k passes.

    A row is drawn with a chance in proportion to its squared distance from the seeds so far: it has the least of
    -ln(u) / distance, which is a minimum that tasks can share. A pass takes up the candidates of the one before, adds up
    the cost with each and draws the next ones as if each had been taken.
    """
    chosen: list[list[np.ndarray]] = [[] for _ in range(starts)]
    offered: list[list[np.ndarray]] = [[] for _ in range(starts)]
    for at in range(k + 1):
        told = [[np.array(c) if c else None for c in chosen], [np.array(o) if o else None for o in offered]]

        def fold(batches: Iterator[pa.RecordBatch], at: int = at, told: list = told) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int, int], tuple[float, np.ndarray]] = {}
            cost = np.zeros((starts, CANDIDATES))
            for batch in filter(lambda b: b.num_rows, batches):
                x, h = _matrix(batch), batch.column("h").to_numpy(zero_copy_only=False)
                for s in range(starts):
                    near = squared_distances(x, told[0][s]).min(1) if told[0][s] is not None else np.full(len(x), np.inf)
                    options = squared_distances(x, told[1][s]) if told[1][s] is not None else None
                    for o in range(CANDIDATES if options is not None else 1):
                        left = np.minimum(near, options[:, o]) if options is not None else np.ones(len(x))
                        cost[s, o] += left.sum()
                        for draw in range(CANDIDATES):
                            with np.errstate(divide="ignore"):
                                score = -np.log(_uniform(h, seed, s, at, o, draw)) / left
                            i = int(np.argmin(score))
                            if (s, o, draw) not in best or score[i] < best[s, o, draw][0]:
                                best[s, o, draw] = float(score[i]), x[i]
            out = [(s, o, d, score, cost[s, o], v) for (s, o, d), (score, v) in best.items()]
            names = ("start", "option", "draw", "score", "cost", "v")
            types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        got = _pass(rows, fold, "start int, option int, draw int, score double, cost double, v array<double>",
                    lambda p: p.groupBy("start", "option", "draw").agg(
                        F.min("score").alias("score"), F.sum("cost").alias("cost"), F.min_by("v", F.struct("score", "v")).alias("v")))
        for s in range(starts):
            mine = [r for r in got if r["start"] == s]
            cost: dict[int, float] = {}
            for r in mine:
                if r["draw"] == 0:
                    cost[r["option"]] = cost.get(r["option"], 0.0) + r["cost"]
            take = min(cost, key=lambda o: (cost[o], o))
            if offered[s]:
                chosen[s].append(offered[s][take])
            drawn = [min((r for r in mine if (r["option"], r["draw"]) == (take, d)), key=lambda r: (r["score"], r["v"]))
                     for d in range(CANDIDATES)]
            offered[s] = [np.array(r["v"]) for r in drawn]
    return [np.array(c) for c in chosen]


# -- rounds

def _sums(rows: DataFrame, pairs: dict[tuple[int, int], Centres]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float]]:
    """Counts, sums of rows by nearest centre, and cost, of every pair (k, start): one pass."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {p: [np.zeros(len(c)), np.zeros(c.shape), np.zeros(len(c))] for p, c in pairs.items()}
        for batch in filter(lambda b: b.num_rows, batches):
            x = _matrix(batch)
            for p, c in pairs.items():
                d = squared_distances(x, c)
                label = d.argmin(1)
                one = np.zeros((len(x), len(c)))
                one[np.arange(len(x)), label] = 1.0
                total[p][0] += one.sum(0)
                total[p][1] += one.T @ x
                total[p][2] += one.T @ d[np.arange(len(x)), label]
        out = [(k, s, j, [n[j], cost[j], *sums[j]]) for (k, s), (n, sums, cost) in total.items() for j in range(k)]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ("k", "start", "j", "sums"))

    def merged(partial: DataFrame) -> DataFrame:
        each = partial.select("k", "start", "j", F.posexplode("sums").alias("at", "x"))
        each = each.groupBy("k", "start", "j", "at").agg(F.sum("x").alias("x"))
        return each.groupBy("k", "start", "j").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("sums"))

    out = {p: [np.zeros(len(c)), np.zeros(c.shape), 0.0] for p, c in pairs.items()}
    for r in _pass(rows, fold, "k int, start int, j int, sums array<double>", merged):
        of, sums = out[r["k"], r["start"]], np.array(r["sums"])
        of[0][r["j"]] += sums[0]
        of[1][r["j"]] += sums[2:]
        of[2] += sums[1]
    return out


def settled(rows: DataFrame, live: dict[tuple[int, int], Centres]) -> dict[tuple[int, int], tuple[float, Centres]]:
    """(cost, centres) of every pair (k, start); a pair leaves the passes when its centres rest."""
    live, done, rounds = dict(live), {}, 0
    while live:
        rounds += 1
        sums = _sums(rows, live)
        for p, (n, total, cost) in sums.items():
            old = live[p]
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)  # an empty cluster keeps its centre
            if ((new - old) ** 2).sum(1).max() <= TOLERANCE ** 2 or rounds > ROUNDS:
                done[p] = cost, old  # the cost belongs to these
                del live[p]
            else:
                live[p] = new
    return done


def best_centres(rows: DataFrame, k_range: list[int], starts: int, seed: int) -> dict[int, Centres]:
    """For each k the centres with the least cost among ``starts``."""
    first = seeds(rows, max(k_range), starts, seed)
    done = settled(rows, {(k, s): first[s][:k] for k in k_range for s in range(starts)})
    return {k: min((done[k, s] for s in range(starts)), key=lambda d: d[0])[1] for k in k_range}


def nearest_centre(v: str, centres: Centres) -> Column:
    """Number of the nearest centre; the first on ties."""
    told = F.array(*[F.array(*map(F.lit, map(float, c))) for c in centres])
    far = F.transform(told, lambda c: F.aggregate(F.zip_with(F.col(v), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


# -- silhouette

def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances (rows of x, rows of y); with few dimensions without the rounding of products."""
    if x.shape[1] > 8:
        d = squared_distances(x, y)
    else:
        d = np.zeros((len(x), len(y)))
        for c in range(x.shape[1]):
            d += (x[:, c][:, None] - y[:, c][None, :]) ** 2
    return np.sqrt(d, out=d)


def silhouettes(rows: DataFrame, best: dict[int, Centres], block: int = BLOCK) -> dict[int, float]:
    """Mean Euclidean silhouette for every k of ``best`` over all rows.

    Equal vectors are one with a weight. Vectors are dealt into groups, and a task has two groups: it takes each distance
    once, for both ends and all k, and adds it up by cluster. So a task holds two groups, at most, and a vector is sent
    once for every group. The distances stay quadratic.
    """
    spark, ks, width = rows.sparkSession, list(best), next(iter(best.values())).shape[1]
    each = step(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(
        F.monotonically_increasing_id().alias("id"), "v", "n", F.array(*[nearest_centre("v", best[k]) for k in ks]).alias("own")))
    size = {(ks[r["at"]], r["own"]): r["n"] for r in each.select("n", F.posexplode("own").alias("at", "own")).groupBy(
        "at", "own").agg(F.sum("n").alias("n")).collect()}
    names = sorted(size)
    place = np.full((len(ks), max(len(c) for c in best.values())), -1)
    for at, (k, j) in enumerate(names):
        place[ks.index(k), j] = at
    groups = max(math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism)), -(-each.count() * width * 8 // GROUP_BYTES))
    schema = f"id bigint, {', '.join(f's{at} double' for at in range(len(names)))}"

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        group, other, ids, n = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts]) for c in ("g", "other", "id", "n"))
        v = np.concatenate([_matrix(b) for b in parts])
        own = np.concatenate([_matrix(b, "own") for b in parts]).astype(np.int64)
        del parts
        weight = np.zeros((len(ids), len(names)))  # of the clusters that a vector is in
        for at in range(len(ks)):
            weight[np.arange(len(ids)), place[at, own[:, at]]] = n
        alone = group[0] == other[0]  # a group and itself
        a, b = np.flatnonzero(group == group[0]), np.flatnonzero(group == other[0])
        sums, y, of_y, to_y = np.zeros(weight.shape), v[b], weight[b], np.zeros((len(b), len(names)))
        for i in range(0, len(a), ROWS_AT_ONCE):
            x = a[i:i + ROWS_AT_ONCE]
            for j in range(0, len(b), block):
                d = _distances(v[x], y[j:j + block])
                if alone:
                    d[x[:, None] == b[None, j:j + block]] = 0.0  # a vector itself
                sums[x] += d @ of_y[j:j + block]
                if not alone:
                    to_y[j:j + block] += d.T @ weight[x]
        sums[b] += to_y
        yield pa.RecordBatch.from_pydict({"id": ids, **{f"s{at}": sums[:, at] for at in range(len(names))}})

    pair = F.array_sort(F.array(F.col("g"), F.col("other")))
    low, high = pair[0], pair[1]
    dealt = each.withColumn("g", F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(
        groups * (groups + 1) // 2, (high * (high + 1) / 2 + low).cast("int"))
    met = dealt.select("g", "other", "id", "v", "n", "own").mapInArrow(fn, schema)
    total = met.groupBy("id").agg(*[F.sum(f"s{at}").alias(f"s{at}") for at in range(len(names))])
    scores = []
    for at, k in enumerate(ks):
        own, mine = F.col("own")[at], [(f"s{q}", j, size[k, j]) for q, (of, j) in enumerate(names) if of == k]
        inner = F.coalesce(F.lit(None).cast("double"), *[F.when(own == j, F.col(c) / F.nullif(F.lit(m - 1), F.lit(0))) for c, j, m in mine])
        outer = F.array_min(F.array(*[F.when(own != j, F.col(c) / m) for c, j, m in mine]))
        # a lone member counts as 0, like everything where there is one cluster
        score = F.coalesce((outer - inner) / F.nullif(F.greatest(inner, outer), F.lit(0.0)), F.lit(0.0))
        scores.append((F.sum(score * F.col("n")) / F.sum("n")).alias(f"k{at}"))
    got = each.select("id", "n", "own").join(total, "id").agg(*scores).first()
    return {k: got[f"k{at}"] for at, k in enumerate(ks)}
