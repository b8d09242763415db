"""Benchmark decontamination: rare word pairs of the items find the places, exact edit distance settles them.

An edit spoils at most two word pairs (a word and the next one), so a passage within ``d`` edits of an item of ``n``
words still holds ``n - 1 - 2d`` of its pairs, and of any ``2d + t`` of them at least ``t``. Every item is listed under
its ``2d + t`` pairs that are rarest among the items; a text is looked at where ``t`` of them stand within the length of
a passage and enough of all the item's pairs around them. Both tests are necessary conditions, whatever the length of
the item and the kind of the edits, so that nothing is lost. What is left is held against the text by exact edit
distance in words. Where the similarity is so low that no pair need survive, single words stand for the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scripts without blanks between words (Thai to Myanmar, Khmer, kana, ideographs): every letter is a word.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{_UNSPACED}]+|(?=\w)[{_UNSPACED}]")
SIMILARITY = 0.8  # 1 - edits / words of the item, at least
BLOCK_WORDS = 1 << 20  # words of the items that one pass over the corpus takes, which bounds the broadcast index
BATCH_WORDS = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Items:
    """Items by their rarest pairs of words."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float = SIMILARITY):
        if not 0 < similarity <= 1:
            raise ValueError("a similarity above 0 and at most 1 is asked for")
        parsed = [(i, w) for i, t in rows if (w := words(t))]
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in parsed]
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64)
                      for _, w in parsed]
        self.allowed = [int((1 - similarity) * len(w) + 1e-9) for w in self.words]
        # pairs that survive at least; where that is none, words
        self.paired = [len(w) - 1 - 2 * d > 0 for w, d in zip(self.words, self.allowed)]
        self.need = [len(w) - 1 - 2 * d if p else len(w) - d
                     for w, d, p in zip(self.words, self.allowed, self.paired)]
        self.held = [_pair_hash(w) if p else _word_hash(w) for w, p in zip(self.words, self.paired)]
        self.tables = [self._table([k for k, p in enumerate(self.paired) if p == kind]) for kind in (True, False)]

    def _table(self, members: list[int]) -> dict | None:
        """Distinct hashes in order with the items under each."""
        if not members:
            return None
        values, inverse, counts = np.unique(np.concatenate([self.held[k] for k in members]), return_inverse=True,
                                            return_counts=True)
        keys, owners, hits, at = [], [], np.zeros(len(self.words), np.int64), 0
        for k in members:
            n, need = len(self.held[k]), self.need[k]
            hits[k] = min(need, 2 + n // 20)
            rarest = np.argsort(counts[inverse[at:at + n]], kind="stable")[:n - need + hits[k]]
            keys.append(np.unique(inverse[at:at + n][rarest]))
            owners.append(np.full(len(keys[-1]), k))
            at += n
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        used, begin = np.unique(key[order], return_index=True)
        t = {"keys": values[used], "begin": np.append(begin, len(order)), "owners": owner[order], "hits": hits,
             "reach": np.array([len(w) + d for w, d in zip(self.words, self.allowed)]),
             "bits": 16 + (len(used) // 4096).bit_length()}
        t["filled"] = np.zeros(1 << t["bits"], bool)
        t["filled"][t["keys"] >> np.uint64(64 - t["bits"])] = True
        return t

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, start, end, edits)`` of the best place of every item found in each text, in words."""
        found, batch, ids, total = [], [], [], 0
        known = self.vocabulary.get
        if not self.words:
            return found
        reach = 2 * max(map(len, self.words))  # parts of a long text overlap by more than any passage
        for k, text in enumerate(texts):
            w = words(text)
            for part in range(0, max(len(w), 1), BATCH_WORDS):
                begin = max(part - reach, 0)
                piece = w[begin:part + BATCH_WORDS]
                batch.append((k, begin))
                ids.append(np.fromiter((known(x, 0) for x in piece), np.int64, len(piece)))
                total += len(piece)
                if total >= BATCH_WORDS:
                    found += self._search(batch, ids)
                    batch, ids, total = [], [], 0
        found += self._search(batch, ids)
        best: dict[tuple[int, int], tuple] = {}
        for row in found:
            here = best.get(row[:2])
            if here is None or (row[4], row[2]) < (here[4], here[2]):
                best[row[:2]] = row
        return [best[k] for k in sorted(best)]

    def _search(self, batch: list[tuple[int, int]], parts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        if not parts:
            return []
        offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
        ids = np.zeros(offsets[-1] + 1, np.int64)
        for o, p in zip(offsets, parts):
            ids[o:o + len(p)] = p
        found = []
        for table, hashed in zip(self.tables, (_pair_hash, _word_hash)):
            if table is not None:
                hashes = hashed(ids)
                item, at = self._places(table, hashes)
                found += self._verified(batch, parts, offsets, hashes, item, at)
        return found

    @staticmethod
    def _places(table: dict, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places of their rare hashes, so many of which lie within the reach of a passage."""
        at = np.flatnonzero(table["filled"][hashes >> np.uint64(64 - table["bits"])])
        key = np.minimum(np.searchsorted(table["keys"], hashes[at]), len(table["keys"]) - 1)
        same = table["keys"][key] == hashes[at]
        at, key = at[same], key[same]
        first = table["begin"][key]
        count = table["begin"][key + 1] - first
        row = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        item, at = table["owners"][row], np.repeat(at, count)
        order = np.argsort(item, kind="stable")  # places rise already
        item, at = item[order], at[order]
        last = np.arange(len(item)) + table["hits"][item] - 1
        inside = np.minimum(last, len(item) - 1)
        opens = (last < len(item)) & (item[inside] == item) & (at[inside] - at < table["reach"][item])
        # a hit counts when it lies between the first and the last of such a run
        depth = np.zeros(len(item) + 1, np.int64)
        np.add.at(depth, np.flatnonzero(opens), 1)
        np.add.at(depth, last[opens] + 1, -1)
        kept = np.cumsum(depth[:-1]) > 0
        return item[kept], at[kept]

    def _verified(self, batch, parts, offsets, hashes, item, at) -> list[tuple[int, int, int, int, int]]:
        doc = np.searchsorted(offsets, at, "right") - 1
        order = np.lexsort((at, item, doc))
        doc, item, at = doc[order].tolist(), item[order].tolist(), at[order].tolist()
        found, k = [], 0
        while k < len(doc):
            here, n, d, first = (doc[k], item[k]), len(self.words[item[k]]), self.allowed[item[k]], at[k]
            while k < len(doc) and (doc[k], item[k]) == here and at[k] - first <= 4 * n:
                last = at[k]
                k += 1
            begin, end = int(offsets[here[0]]), int(offsets[here[0]]) + len(parts[here[0]])
            lo, hi = max(first - n - d, begin), min(last + n + d, end)  # holds every passage with one of the places
            if self._most(here[1], hashes[lo:hi], n + d) < self.need[here[1]]:
                continue
            hit = best_place(self.words[here[1]], parts[here[0]][lo - begin:hi - begin])
            if hit[2] <= d:
                text, shift = batch[here[0]]
                found.append((text, here[1], lo - begin + hit[0] + shift, lo - begin + hit[1] + shift, hit[2]))
        return found

    def _most(self, item: int, hashes: np.ndarray, length: int) -> int:
        """Most places within a length at which a hash of the item stands."""
        upto = np.concatenate([[0], np.cumsum(np.isin(hashes, self.held[item]))])
        return int((upto[length:] - upto[:-length]).max()) if len(upto) > length else int(upto[-1])


def _pair_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one; of unknown words something that the benchmark hardly has."""
    a, b = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
    h = (a * _ODD ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(32))) * _ODD


def _word_hash(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(32))) * _ODD


def _last_row(item: np.ndarray, text: np.ndarray, free: bool) -> np.ndarray:
    """Edit distance of ``item`` to what ends at each place of ``text`` (from any place, or from the first)."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64) if free else steps.copy()
    for k, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(new - steps) + steps
    return row


def best_place(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """``(start, end, edits)`` of the part of ``text`` nearest to ``item``, the first such end."""
    row = _last_row(item, text, True)
    end = int(row.argmin())
    back = _last_row(item[::-1], text[:end][::-1], False)
    return end - int(back.argmin()), end, int(row[end])


def item_blocks(benchmark: DataFrame, text: str, key: str | None, similarity: float = SIMILARITY) -> Iterator[Items]:
    """Indexes of all items, in blocks of at most about ``BLOCK_WORDS`` words each; those without an id only if no
    key is named."""
    rows = benchmark.select((F.col(key) if key else F.lit(0)).alias("id"), F.col(text).alias("text")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    blocks = 1 + size // (4 * BLOCK_WORDS)
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        yield Items([tuple(r) for r in part.orderBy("id", "text").collect()], similarity)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
          item_key: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """``(key, item, start, end, edits, item_words)``: the nearest place of each item in each text, where near enough.

    Case, punctuation and line breaks do not count; ``start`` and ``end`` count words. Null and empty texts hold
    nothing; repeated texts and items are reported each; items without an id or a word are not looked for, those of
    so few words that the similarity allows no edit must stand there word for word; an empty table on either side gives
    no rows. A letter of a script without blanks counts as a word.
    """
    kind = docs.select(key).schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("item", T.LongType())] + [
        T.StructField(c, T.LongType()) for c in ("start", "end", "edits", "item_words")])
    out = None
    for items in item_blocks(benchmark, item_text, item_key, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = index.search(batch.column(1).to_pylist())
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in (
                    [index.ids[r[1]] for r in rows], [r[2] for r in rows], [r[3] for r in rows],
                    [r[4] for r in rows], [len(index.words[r[1]]) for r in rows])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        found = docs.select(F.col(key), F.col(text)).mapInArrow(find, schema)
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("item", item_key)


def holds_item(text: Column, items: Items) -> Column:
    """Whether a text holds any of the items."""
    shared = SparkSession.active().sparkContext.broadcast(items)

    @F.pandas_udf(T.BooleanType())
    def fn(texts: pd.Series) -> pd.Series:
        hit = {r[0] for r in shared.value.search(list(texts))}
        return pd.Series([k in hit for k in range(len(texts))], dtype=bool)

    return fn(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with their columns."""
    for items in item_blocks(benchmark, "text", None):
        docs = docs.filter(~holds_item(F.col(text), items))
    return docs
