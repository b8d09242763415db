"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled rows. A text's features are its words, their first letters, and marks for first
letters that recur (so that a text full of such words differs from one with a chance hit). Terms are the features that
go with label 1 beyond chance among the examples (a chi-square bound that grows with the number of features tried);
their document frequencies are counted over the whole corpus. The index keeps examples in blocks with the largest weight of each term per block: a query takes blocks by
falling upper bound and stops when no block can improve its k nearest, so the result is exact. Neighbours vote by
inverse squared distance, votes are calibrated on the examples themselves (each left out in turn), and the nearest ones are
returned as evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, stored

TERM = re.compile(r"[^\W\d_]+")
MAX_EXAMPLES = 16384  # labelled rows learned, about
MAX_TERMS = 4096
MIN_ROWS = 3  # examples that hold a term
CHANCE = 0.05  # of taking any term by accident
ODDS = 5  # of label 1 with a term, to those without it, at least: weaker ones say more about a text's length
NEIGHBOURS = 15
BLOCK = 256
CACHE = 100_000  # scores of feature sets that a worker keeps
NEARNESS = 0.05  # added to distances, so that equal texts do not vote without bound
EVIDENCE = 3
STEM = 5  # letters of a beginning
RECURS = (2, 4, 8)  # times a beginning recurs
THRESHOLD = 0.7


class Vocabulary(dict):
    """Features by number, with the beginnings that they need."""

    def __init__(self, names: list[str]):
        super().__init__((w, k) for k, w in enumerate(names))
        self.stems = {w.partition("*")[0] for w in names if "*" in w}


def features(text: str | None, wanted: Vocabulary | None = None) -> dict[str, int]:
    """Features with counts: words, ``ab*`` for words that begin so, ``ab*4`` for four or more such words.

    ``wanted``: only these; the recurring ones then count for the beginnings among them alone.
    """
    if not text:
        return {}
    words = Counter(TERM.findall(text.lower()))
    begun: Counter = Counter()
    for w, n in words.items():
        begun[w[:STEM]] += n
    if wanted is None:
        found = dict(words)
        begins = begun.items()
    else:
        found = {w: words[w] for w in words.keys() & wanted}
        begins = [(b, begun[b]) for b in begun.keys() & wanted.stems]
    for b, n in begins:
        found[f"{b}*"] = n
        found.update((f"{b}*{k}", 1) for k in RECURS if n >= k)
    return found if wanted is None else {f: n for f, n in found.items() if f in wanted}


class Index:
    """Unit TF-IDF vectors of the examples in blocks; ``ids`` and ``labels`` in index order."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, examples: list[tuple[int, int, dict[int, int]]]):
        self.vocabulary, self.idf = vocabulary, idf
        blank = [y for _, y, found in examples if not found]
        # examples without any term: what such a text is, with one vote for and one against
        self.blank = (sum(blank) + 1) / (len(blank) + 2) if examples else 0.0
        vectors = [(i, y, self.vector(found)) for i, y, found in examples if found]
        vectors.sort(key=lambda v: (int(v[2][0][v[2][1].argmax()]), -float(v[2][1].max()), v[0] or 0))
        self.ids = np.array([i if i is not None else -1 for i, _, _ in vectors], np.int64)
        self.labels = np.array([y for _, y, _ in vectors], np.float64)
        self.blocks, self.most = [], np.zeros((len(vocabulary), -(-len(vectors) // BLOCK)), np.float32)
        for b in range(self.most.shape[1]):
            part = [v for _, _, v in vectors[b * BLOCK:(b + 1) * BLOCK]]
            term, weight = np.concatenate([t for t, _ in part]), np.concatenate([w for _, w in part])
            np.maximum.at(self.most[:, b], term, weight.astype(np.float32))
            self.blocks.append((term, weight, np.repeat(np.arange(len(part)), [len(t) for t, _ in part]), len(part)))
        self.most *= np.float32(1 + 1e-6)  # bounds stay bounds after rounding
        self.vectors = [v for _, _, v in vectors]
        self.slope, self.shift, self.scored = 1.0, 0.0, {}
        self._calibrate()

    def vector(self, found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of term counts as sorted terms and weights."""
        term = np.array(sorted(found), np.int64)
        weight = (1 + np.log([found[t] for t in term])) * self.idf[term]
        return term, weight / np.sqrt(weight @ weight)

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, ties by position."""
        term, weight = vector
        bound = weight @ self.most[term]
        query = np.zeros(len(self.idf))
        query[term] = weight
        at, cosine = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            least = cosine[-1] if len(cosine) == NEIGHBOURS else 0.0
            if bound[b] <= 0 or bound[b] < least:
                break
            terms_, weights, row, n = self.blocks[b]
            found = np.bincount(row, query[terms_] * weights, n)
            place = np.flatnonzero((found > 0) & (found >= least - 1e-9))
            place = place[place + b * BLOCK != leave]
            at, cosine = np.concatenate([at, place + b * BLOCK]), np.concatenate([cosine, found[place]])
            best = np.lexsort((at, -cosine.round(12)))[:NEIGHBOURS]
            at, cosine = at[best], cosine[best]
        return at, cosine

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1 / (np.clip(1 - cosine, 0, 1) + NEARNESS) ** 2
        prior = 1.0  # weight of what texts without evidence are
        return float((weight @ self.labels[at] + prior * self.blank) / (weight.sum() + prior))

    def _calibrate(self) -> None:
        """Logistic fit of the labels on the log odds of left-one-out votes; kept only where it rises."""
        if len(set(self.labels)) < 2:
            return
        x = np.array([_odds(self.vote(*self.nearest(v, k))) for k, v in enumerate(self.vectors)])
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            w = p * (1 - p)
            gradient = np.array([(self.labels - p) @ x - 0.01 * (a - 1), (self.labels - p).sum() - 0.01 * b])
            hessian = np.array([[w @ (x * x) + 0.01, w @ x], [w @ x, w.sum() + 0.01]])
            step = np.linalg.solve(hessian, gradient)
            a, b = a + step[0], b + step[1]
            if abs(step).max() < 1e-9:
                break
        if a > 0 and math.isfinite(a + b):
            self.slope, self.shift = float(a), float(b)

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """Calibrated score and the ids of the nearest examples."""
        found = features(text, self.vocabulary)
        if not found or not len(self.labels):
            return self.blank, []
        return self._scored(tuple(sorted((self.vocabulary[w], n) for w, n in found.items())))

    def _scored(self, found: tuple[tuple[int, int], ...]) -> tuple[float, list[int]]:
        known = self.scored.get(found)
        if known is None:
            at, cosine = self.nearest(self.vector(dict(found)))
            odds = self.slope * _odds(self.vote(at, cosine)) + self.shift
            known = float(1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))), self.ids[at[:EVIDENCE]].tolist()
            if len(self.scored) >= CACHE:
                self.scored.clear()
            self.scored[found] = known
        return known


def _odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def examples(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, most: int) -> DataFrame:
    """``(id, label, text)`` of about ``most`` labelled rows with a text, picked by a hash of the id."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.max(label).cast("int").alias("label"))
    n = max(known.count(), 1)
    picked = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30)))
    # at most about `most` rows of two numbers
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").select(
        "id", "label", "text")


def select_terms(rows: DataFrame) -> list[str]:
    """Words that go with label 1 beyond chance, the clearest ``MAX_TERMS`` of them."""
    totals = rows.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    n, p = totals["n"], totals["p"] or 0
    if not p or p == n:
        return []

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([list(features(t)) for t in texts])

    counted = stored(rows.select("label", F.explode(distinct("text")).alias("term")).groupBy("term").agg(
        F.count("*").alias("n"), F.sum("label").alias("p")).filter(F.col("n") >= MIN_ROWS))
    tried = counted.count()
    cross = F.col("p") * (n - p - F.col("n") + F.col("p")) - (F.col("n") - F.col("p")) * (p - F.col("p"))
    chi = n * cross.cast("double") ** 2 / (F.col("n").cast("double") * (n - F.col("n")) * p * (n - p))
    with_1, with_0 = F.col("p"), F.col("n") - F.col("p")
    odds = with_1 * (n - p - with_0) >= ODDS * with_0 * (p - with_1)
    clear = counted.withColumn("chi", chi).filter((F.col("n") < n) & (cross > 0) & odds
                                                  & (F.col("chi") > 2 * math.log(max(tried, 1) / CHANCE)))
    return sorted(r["term"] for r in clear.orderBy(F.desc("chi"), "term").limit(MAX_TERMS).collect())


def corpus_frequencies(docs: DataFrame, text: str, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents: a pass over the whole corpus, a short vector per task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += 1
                for w in features(t, vocabulary):
                    found[vocabulary[w]] += 1
        yield pa.RecordBatch.from_pydict({"term": np.append(np.arange(len(found)), -1),
                                          "n": np.append(found, total)})

    sums = docs.select(F.col(text)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = {r["term"]: r["n"] for r in sums.collect()}
    return np.array([out.get(k, 0) for k in range(len(vocabulary))], np.float64), out.get(-1, 0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        most: int = MAX_EXAMPLES) -> Index:
    """Index of the labelled rows of ``labels``. Terms, vectors and index are bounded by the parameters above."""
    rows = stored(examples(docs, labels, text, key, label, most))
    vocabulary = Vocabulary(select_terms(rows))
    held, total = corpus_frequencies(docs, text, vocabulary) if vocabulary else (np.zeros(0), 0)
    idf = np.log1p(total / np.maximum(held, 1))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([[x for w, n in features(t, vocabulary).items() for x in (vocabulary[w], n)] for t in texts])

    # about `most` rows of at most MAX_TERMS pairs
    vectors = rows.select("id", "label", counted("text").alias("c")).collect()
    return Index(vocabulary, idf, [(r["id"], r["label"], dict(zip(r["c"][::2], r["c"][1::2]))) for r in vectors])


def scores(text: Column, index: Index) -> Column:
    """Struct of ``score`` and ``evidence`` (ids of the nearest examples) of a text column."""
    shared = SparkSession.active().sparkContext.broadcast(index)
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))])

    @F.pandas_udf(kind)
    def fn(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.score(t) for t in texts], columns=["score", "evidence"])

    return fn(text)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", parts: int = 3,
             held: int = 1) -> DataFrame:
    """``(key, held_out, score, predicted, evidence)`` of every row of ``docs``.

    Learned from labels whose id's crc32 modulo ``parts`` is not ``held``. Texts without a learned term, empty and null
    ones among them, get the share of label 1 among such examples; without labels every score is 0.
    """
    index = fit(docs, labels.filter(remainder(F.col(key), parts) != held), text, key)
    found = docs.select(F.col(key), F.coalesce(remainder(F.col(key), parts) == held, F.lit(False)).alias("held_out"),
                        scores(F.col(text), index).alias("s"))
    return found.select(key, "held_out", "s.score", (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"),
                        "s.evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns; learned from all labels."""
    index = fit(docs, labels, text, key)
    return docs.filter(scores(F.col(text), index)["score"] < THRESHOLD)
