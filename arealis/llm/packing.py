"""Packing of documents into windows of tokens by lexical retrieval.

Document frequencies and the mean length are those of the whole table. Documents are ordered by terms drawn by idf and
saturated count, each of ``DRAWS`` times with the same random numbers for all (consistent weighted sampling): two
documents share a draw with the probability of their weighted Jaccard similarity, whatever files they come from. In that
order, those with the same first term stand together, among them those with the same second, and so on, so a frequent
term's documents are parted by their next terms. The order is cut into partitions at sampled places and within them
into shards of about ``SHARD_TOKENS``. A shard has a BM25 inverted index over all its documents: a window starts with
a seed document and is filled with the unused documents nearest to the seed; what does not fit is the next window's
seed. An open window goes on in the next shard, so only a partition's last window is padded.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

WINDOW = 2048
END = 1  # id after every document
SHARD_TOKENS = 1 << 20
DRAWS = 4
CUT_ROWS = 100  # rows sampled for each cut of the order
ENCODED_ROWS = 256  # texts encoded at a time
K1, B = 1.2, 0.75
#: Characters beyond these, and what may be a special token, go to the tokenizer as whole texts.
_OTHER = re.compile(r"[^\x00-ɏ]")
# The tokenizer's pre-token rule with its classes written out for the characters above: letters, numbers, blanks.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_WORDS = rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+"
_SPLIT = rf"{_WORDS}|[{_S}]+(?![^{_S}])|[{_S}]+"
# Where no two blanks meet the rule needs no look ahead, without which texts are split much sooner.
_SINGLE, _BLANKS = rf"{_WORDS}|[{_S}]", re.compile(rf"[{_S}][{_S}]")
_AS_BLANK = bytes(32 if re.match(f"[{_S}]", chr(k)) else k for k in range(256))  # of Latin-1
_UNUSED = "<|unused|>"  # without a special token the search for such stops at each character


class Encoder:
    """Ids of texts by a byte-level BPE file. ``ranks`` is the same vocabulary as ranks of byte strings, with which texts
    of the characters that ``_SPLIT`` knows are encoded sooner."""

    def __init__(self, path: str, ranks: str | None = None):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.short = Tokenizer.from_file(path), None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.short, self.single = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=table, special_tokens={
                _UNUSED: 1 + max(table.values())}) for p in (_SPLIT, _SINGLE))

    def _of(self, text: str):
        """The encoding by ranks that gives the tokenizer's ids of ``text``, if one does."""
        if self.short is None or "<|" in text:
            return None
        try:
            blanks = b"  " in text.encode("latin-1").translate(_AS_BLANK)
        except UnicodeEncodeError:
            if _OTHER.search(text):
                return None
            blanks = _BLANKS.search(text)
        return self.short if blanks else self.single

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        whole = []
        for k, t in enumerate(texts):
            if t and (ranks := self._of(t)):
                out[k] = ranks.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False)
            elif t:
                whole.append(k)
        for k, e in zip(whole, self.tokenizer.encode_batch([texts[k] for k in whole], add_special_tokens=False)):
            out[k] = np.array(e.ids, "<u4")
        return out


@lru_cache(1)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One per worker, so that its tasks load the files once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, ranks)


class Terms:
    """Distinct ids of each document, found when they are asked for: only seeds need them."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs = docs

    def __getitem__(self, doc: int) -> np.ndarray:
        return distinct(self.docs[doc])[0]


class ShardIndex:
    """BM25 over the documents of a shard, given as arrays of ids, none of them empty.

    ``corpus`` are the document frequencies, number of documents and mean length to use, else those of the shard.
    """

    def __init__(self, docs: list[np.ndarray], corpus: tuple[np.ndarray, int, float] | None = None):
        self.terms, self.n, size = Terms(docs), len(docs), np.array([len(d) for d in docs])
        # one sort for all: by id, then by document
        pairs = np.concatenate(docs).astype(np.uint64) << np.uint64(32)
        pairs |= np.repeat(np.arange(self.n, dtype=np.uint64), size)
        pairs, tf = distinct(pairs)
        term, self.doc = pairs >> 32, pairs & 0xFFFFFFFF
        self.length = np.bincount(term)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        # terms of many documents are added as whole rows, which have at most 16 cells for each entry of the index
        self.rows, self.most = {}, 100 + self.n // 16
        df, n, mean = corpus or (self.length, self.n, size.mean())
        norm = K1 * (1 - B + B * size / max(mean, 1))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 score of every document for a set of ids."""
        terms = terms[terms < len(self.begin) - 1]
        many = self.length[terms] > self.most
        total = np.zeros(self.n)
        for t in terms[many].tolist():
            if (row := self.rows.get(t)) is None:
                at = slice(self.begin[t], self.begin[t + 1])
                row = self.rows[t] = np.zeros(self.n)
                row[self.doc[at]] = self.weight[at]
            total += row
        few = terms[~many]
        begin, length = self.begin[few], self.length[few]
        place = np.repeat(begin - (np.cumsum(length) - length), length)
        place += np.arange(len(place))
        total += np.bincount(self.doc.take(place), self.weight.take(place), self.n)
        return total


class Packer:
    """Windows of one task: ``add`` a shard of ``(ids)`` documents at a time, get ``(doc, start, length, window, offset)``."""

    def __init__(self, window: int = WINDOW, corpus: tuple[np.ndarray, int, float] | None = None):
        self.size, self.window, self.filled, self.corpus = window, 0, 0, corpus
        self.seed = np.empty(0, np.int64)  # ids of the open window's seed

    def add(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        index, unused, pieces = ShardIndex(docs, self.corpus), np.ones(len(docs), bool), []
        ranked: Iterator[int] = iter(())
        if self.filled:
            ranked = self._ranked(index, self.seed, unused)
        following = iter(range(len(docs)))
        for _ in range(len(docs)):
            doc = next((k for k in (ranked if self.filled else following) if unused[k]), None)
            unused[doc] = False
            if not self.filled:
                self.seed = index.terms[doc]
                ranked = self._ranked(index, self.seed, unused)
            start, total = 0, len(docs[doc])
            while start < total:
                length = min(total - start, self.size - self.filled)
                pieces.append((doc, start, length, self.window, self.filled))
                start, self.filled = start + length, self.filled + length
                if self.filled == self.size:
                    self.window, self.filled = self.window + 1, 0
                    if start < total:
                        self.seed = index.terms[doc]
                        ranked = self._ranked(index, self.seed, unused)
        return pieces

    @staticmethod
    def _ranked(index: ShardIndex, terms: np.ndarray, unused: np.ndarray) -> Iterator[int]:
        """Unused documents from the nearest on, ties in order: a few are found at first, more if they are asked for."""
        left = np.flatnonzero(unused)
        scores, most = index.scores(terms)[left], 16
        while len(left):
            if len(left) <= most:
                near = np.ones(len(left), bool)
            else:
                near = scores >= np.partition(scores, len(left) - most)[len(left) - most]
            best = left[near]
            yield from best[np.argsort(-scores[near], kind="stable")].tolist()
            left, scores, most = left[~near], scores[~near], 4 * most


def _ids(row: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(row, "<u4" if wide else "<u2").astype("<u4")


def _encoded(df: DataFrame, tokenizer: str, ranks: str | None, text: str, key: str) -> DataFrame:
    """``(key, ids, wide, tokens, counted)``: the ids with the end id, of two bytes each, or of four where one needs them.

    A task's last row is no document: ``counted`` has the ids it has seen and in how many documents, in pairs.
    """
    schema = T.StructType([T.StructField("key", df.select(key).schema[key].dataType), T.StructField("ids", T.BinaryType()),
                           T.StructField("wide", T.BooleanType()), T.StructField("tokens", T.LongType()),
                           T.StructField("counted", T.ArrayType(T.LongType()))])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, df, kind = np.array([END], "<u4"), np.zeros(1 << 16, np.int64), None
        for batch in batches:
            kind = batch.column(0).type
            for k in range(0, batch.num_rows, ENCODED_ROWS):
                part = batch.slice(k, ENCODED_ROWS)
                docs = [np.concatenate([ids, end]) for ids in encoder(tokenizer, ranks).encode(part.column(1).to_pylist())]
                wide = [bool(d.max() >= 1 << 16) for d in docs]
                rows = [d if w else d.astype("<u2") for d, w in zip(docs, wide)]
                for ids in rows:
                    terms = np.unique(ids)
                    if terms[-1] >= len(df):
                        df = np.pad(df, (0, int(terms[-1]) + 1 - len(df)))
                    df[terms] += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(wide, pa.bool_()),
                     pa.array([len(d) for d in docs], pa.int64()), pa.nulls(len(docs), pa.list_(pa.int64()))], names=schema.names)
        if kind is not None:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), *[pa.nulls(1, t) for t in (pa.binary(), pa.bool_(), pa.int64())],
                 pa.array([np.stack([at, df[at]], 1).ravel()], pa.list_(pa.int64()))], names=schema.names)

    return df.select(F.col(key), F.col(text)).mapInArrow(fn, schema)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order and their counts."""
    ids = np.sort(ids, kind="stable" if ids.itemsize <= 2 else None)  # by digits, if there are few
    at = np.concatenate([[True], ids[1:] != ids[:-1], [True]]).nonzero()[0]
    return ids[at[:-1]].astype(np.int64), at[1:] - at[:-1]


def corpus_statistics(encoded: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency of every id, number of documents and their mean length, from what the encoding tasks counted."""
    total = encoded.filter("tokens is not null").agg(F.count("*").alias("n"), F.avg("tokens").alias("mean")).first()
    pairs = encoded.filter("counted is not null").select(F.col("counted"), F.explode(F.sequence(
        F.lit(0), (F.size("counted") / 2).cast("int") - 1)).alias("k")).select(
        F.get("counted", 2 * F.col("k")).alias("term"), F.get("counted", 2 * F.col("k") + 1).alias("n"))
    # as many rows as the vocabulary has ids, at most
    rows = pairs.groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 + max((r["term"] for r in rows), default=0), np.int64)
    for r in rows:
        df[r["term"]] = r["n"]
    return df, total["n"], total["mean"] or 0.0


class Placer:
    """A document's place in the order: its drawn terms, then a checksum, as bytes that compare like the numbers."""

    def __init__(self, corpus: tuple[np.ndarray, int, float], seed: int = 7):
        df, n, _ = corpus
        drawn = -np.log(np.random.default_rng(seed).uniform(1e-12, 1, (DRAWS, len(df))))
        self.drawn = (drawn / np.log1p((n - df + 0.5) / (df + 0.5))).astype(np.float32)

    def terms(self, ids: np.ndarray) -> np.ndarray:
        terms, tf = distinct(ids)
        return terms[np.argmin(self.drawn.take(terms, axis=1) * ((tf + K1) / tf).astype(np.float32), axis=1)]

    def place(self, ids: np.ndarray) -> bytes:
        return self.terms(ids).astype(">u4").tobytes() + zlib.crc32(ids.tobytes()).to_bytes(4, "big")


def cuts(sample: list[tuple[bytes, int]], parts: int) -> list[bytes]:
    """Places that cut an order into ``parts`` of about as many tokens, from sampled ``(place, tokens)``."""
    sample = sorted(sample)
    upto = np.cumsum([n for _, n in sample]) if sample else np.zeros(0)
    at = [int(np.searchsorted(upto, upto[-1] * k / parts)) for k in range(1, parts)] if sample else []
    return sorted({sample[k][0] for k in at})


def pack(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", window: int = WINDOW,
         ranks: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per piece: ``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    A document is its ids and the end id; a null or empty text is the end id alone. Every id lies in one piece,
    repeated rows are packed each, ``sequence_id`` is the partition's number and a count within it, offsets are
    gapless. An empty table gives no rows. Windows do not depend on files or row order; equal documents are ordered by
    their keys. There are as many partitions as the session's shuffles have, fewer where the table has fewer shards; the
    sample only says where to cut, so that partitions are about even.
    """
    kind = df.select(key).schema[key].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(c, T.LongType()) for c in names])
    stored_rows = stored(_encoded(df, tokenizer, ranks, text, key))
    encoded = stored_rows.filter("tokens is not null").select("key", "ids", "wide", "tokens")
    spark = encoded.sparkSession
    statistics = corpus_statistics(stored_rows)
    shared = spark.sparkContext.broadcast(statistics)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, int(statistics[1] * statistics[2] // shard_tokens)))

    def placed(ids: pd.Series, wide: pd.Series, tie: pd.Series) -> list[bytes]:
        placer = Placer(shared.value)
        # equal documents differ in their ties
        return [placer.place(np.frombuffer(i, "<u4" if w else "<u2")) + (int(t) & (2 ** 64 - 1)).to_bytes(8, "big")
                for i, w, t in zip(ids, wide, tie)]

    @F.pandas_udf(T.BinaryType())
    def place(ids: pd.Series, wide: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(placed(ids, wide, tie), dtype=object)

    tie = F.xxhash64("key")
    one_in = max(1, statistics[1] // (CUT_ROWS * parts))
    sample = encoded.filter(F.pmod(F.xxhash64("ids", "key"), F.lit(one_in)) == 0) if parts > 1 else encoded.limit(0)
    bounds = spark.sparkContext.broadcast(cuts([tuple(r) for r in sample.select(place("ids", "wide", tie), "tokens").collect()], parts))

    @F.pandas_udf(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("place", T.BinaryType())]))
    def part_and_place(ids: pd.Series, wide: pd.Series, tie: pd.Series) -> pd.DataFrame:
        found = placed(ids, wide, tie)
        return pd.DataFrame({"part": np.array([bisect_right(bounds.value, p) for p in found], np.int32),
                             "place": pd.Series(found, dtype=object)})

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, docs, size = Packer(window, shared.value), [], [], 0
        part = TaskContext.get().partitionId() << 32

        def shard() -> pa.RecordBatch:
            rows = np.array(packer.add(docs), np.int64).reshape(-1, 5)
            crc = [zlib.crc32(docs[d][s:s + n].tobytes()) for d, s, n in rows[:, :3].tolist()]
            columns = [rows[:, 1], rows[:, 2], np.array(crc, np.int64), np.array([len(d) for d in docs])[rows[:, 0]],
                       part + rows[:, 3], rows[:, 4]]
            return pa.RecordBatch.from_arrays(
                [pa.chunked_array(held).combine_chunks().take(pa.array(rows[:, 0]))] + [pa.array(c, pa.int64()) for c in columns],
                names=[key, *names])

        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            first = 0
            for k, (ids, wide) in enumerate(rows):
                docs.append(_ids(ids, wide))
                size += len(docs[-1])
                if size >= shard_tokens:
                    held.append(batch.column(0).slice(first, k + 1 - first))
                    yield shard()
                    held, docs, size, first = [], [], 0, k + 1
            if first < batch.num_rows:
                held.append(batch.column(0).slice(first))
        if docs:
            yield shard()

    sent = encoded.withColumn("at", part_and_place("ids", "wide", tie)).select("key", "ids", "wide", "at.part", "at.place")
    # keys tell apart what hashes of keys do not
    dealt = sent.repartitionById(parts, "part").sortWithinPartitions("place", "key")
    return dealt.select("key", "ids", "wide").mapInArrow(fn, schema)
