"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language are learned from a bounded, stratified sample of labelled rows; the matrix
of log probabilities (buckets x languages) is broadcast and every text is scored by sparse numpy sums: one row of the
matrix per n-gram, added up by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
PER_LANGUAGE = 2000  # labelled rows learned per language, about
LANGUAGES = 256  # most frequent ones learned: bounds the broadcast matrix at 32 MB
UNKNOWN = "und"
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_CHUNK = 1 << 16


def ngram_buckets(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at every place, for each order; ends run short by order - 1."""
    for order in ORDERS:
        h = np.full(max(len(codes) - order + 1, 0), order, np.uint32)
        for k in range(order):
            h = (h ^ codes[k:len(h) + k]) * _MIX[k]
            h ^= h >> np.uint32(15)
        yield (h & np.uint32(BUCKETS - 1)).astype(np.intp)


def code_points(text: str) -> np.ndarray:
    """Lower-cased text, runs of blanks as one blank, as code points."""
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32)


def letters(text: str | None) -> bool:
    """Whether the text holds a letter."""
    return text is not None and any(map(str.isalpha, text))


def text_counts(texts: Iterator[str]) -> np.ndarray:
    """N-gram counts of texts by bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for text in texts:
        codes = code_points(text)
        for k in range(0, len(codes), _CHUNK):
            for found in ngram_buckets(codes[k:k + _CHUNK + ORDERS[-1] - 1]):
                total += np.bincount(found, minlength=BUCKETS)
    return total


def labelled(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE,
             languages: int = LANGUAGES, key: str = "doc_id") -> DataFrame:
    """``(text, lang)`` of about ``per_language`` rows of each of the most frequent languages.

    Rows are picked by a hash of key and text, whatever files they lie in. A language beyond the ``languages`` most
    frequent ones is not learned and never predicted.
    """
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    # at most `languages` rows; a row's language is looked up in it
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    drawn = F.pmod(F.xxhash64("text", "key"), F.lit(1 << 40)) / float(1 << 40)
    share = drawn * F.col("n") < per_language
    return rows.join(F.broadcast(sizes), "lang").filter(share).select("text", "lang")


class Model:
    """Learned languages in order, and the matrix of log probabilities with one column each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + SMOOTHING
        self.matrix = np.ascontiguousarray(np.log(p / p.sum(0)).astype(np.float32))

    def score(self, texts: pd.Series) -> pd.DataFrame:
        """Best language and its probability; the log odds count per square root of the length, else all are sure."""
        out = []
        for text in texts:
            if not self.languages or not letters(text):
                out.append((UNKNOWN, 0.0))
                continue
            codes, sums, n = code_points(text), np.zeros(len(self.languages)), 0
            for k in range(0, len(codes), _CHUNK):
                for found in ngram_buckets(codes[k:k + _CHUNK + ORDERS[-1] - 1]):
                    sums += np.ones(len(found), np.float32) @ self.matrix[found]
                    n += len(found)
            odds = np.exp((sums - sums.max()) / np.sqrt(n))
            best = int(sums.argmax())
            out.append((self.languages[best], float(odds[best] / odds.sum())))
        return pd.DataFrame(out, columns=["lang_pred", "score"])


def fit(examples: DataFrame) -> Model:
    """Learn from ``(text, lang)``. Tasks send counts by language: a matrix of bounded size per task of the sample."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for lang, texts in frame.groupby("lang")["text"]:
                found[lang] = found.get(lang, 0) + text_counts(iter(texts))
        yield pa.RecordBatch.from_pydict({"lang": list(found), "counts": [c.tobytes() for c in found.values()]},
                                         schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist())
        return pa.table({"lang": table["lang"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    # a matrix per task of the sample, which holds a bounded number of rows: few tasks, few matrices
    parts = examples.repartition(8).mapInArrow(count, schema)
    rows = parts.groupBy("lang").applyInArrow(add, schema).orderBy("lang").collect()
    columns = [np.frombuffer(r["counts"], np.int64) for r in rows]
    return Model([r["lang"] for r in rows], np.stack(columns, 1) if columns else np.zeros((BUCKETS, 0)))


def predictions(text: Column, model: Model) -> Column:
    """``lang_pred`` and ``score`` of a text column as a struct."""
    shared = SparkSession.active().sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def fn(texts: pd.Series) -> pd.DataFrame:
        return shared.value.score(texts)

    return fn(text)


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", parts: int = 4,
             held: int = 2) -> DataFrame:
    """``(key, held_out, lang_pred, score)`` of every row; learned from rows whose id's crc32 modulo ``parts`` is not ``held``.

    Texts that are null or have no letter are ``und`` with score 0, as is everything where no row is labelled. Rows
    without an id are neither learned from nor held out.
    """
    left = remainder(F.col(key), parts)
    model = fit(labelled(df.filter(left != held), text, lang, key=key))
    found = df.select(F.col(key), F.coalesce(left == held, F.lit(False)).alias("held_out"),
                      predictions(F.col(text), model).alias("p"))
    return found.select(key, "held_out", "p.lang_pred", "p.score")
