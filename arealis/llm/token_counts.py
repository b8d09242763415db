"""Token counts under a unigram model by dynamic programming on a trie of pre-tokens.

The best segmentation of a string ends in some vocabulary piece, so the best score of every prefix follows from those
of shorter ones. Distinct pre-tokens go into a trie: a node holds the forward score and the token count of its prefix,
computed once for all words that share it, and the count at a word's last node is kept. Both are bounded per task and
begun anew when full.

The model: the pieces of a public vocabulary in their order of rank, with probability in proportion to
``1 / (rank + 10)``; a character without a piece costs ``FALLBACK`` and a token per UTF-8 byte. Scores are whole
numbers, ties go to fewer tokens.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"  # begins a pre-token
SCALE = 10_000
FALLBACK = -20 * SCALE  # per byte
NODES, WORDS = 500_000, 400_000  # kept by a worker
LONG = 64  # characters of a word beyond which it is not put into the trie


def load_scores(path: str) -> dict[str, int]:
    """Scores of the pieces of a vocabulary file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 10) for r in range(len(pieces))))
    return {p: round(-SCALE * (math.log(r + 10) + total)) for r, p in enumerate(pieces)}


class Counter(dict):
    """Token count of a word, computed on first sight.

    A forward value is ``(score << 32) - tokens``, so that one comparison ranks scores and then fewer tokens.
    """

    def __init__(self, scores: dict[str, int]):
        super().__init__()
        self.weights = {p: (s << 32) - 1 for p, s in scores.items()}
        self.lengths: dict[str, list[int]] = {}  # of the pieces that end in three given characters
        for length in sorted({len(p) for p in scores}):
            for p in scores:
                if len(p) == length > 2:
                    self.lengths.setdefault(p[-3:], []).append(length)
        self.lengths = {e: sorted(set(n)) for e, n in self.lengths.items()}
        self.children: dict[tuple[int, str], int] = {}
        self.values = [0]  # forward value of each node

    def step(self, word: str, end: int, path: list[int]) -> int:
        """Forward value of ``word[:end]`` from those of its prefixes."""
        weight, char, before = self.weights.get, word[end - 1], path[end - 1]
        n = 1 if char < "\x80" else len(char.encode("utf-8", "replace"))
        best = before + n * ((FALLBACK << 32) - 1)
        w = weight(char)
        if w is not None and before + w > best:
            best = before + w
        if end > 1:
            w = weight(word[end - 2:end])
            if w is not None and path[end - 2] + w > best:
                best = path[end - 2] + w
        for length in self.lengths.get(word[end - 3:end], ()) if end > 2 else ():
            if length > end:
                break
            w = weight(word[end - length:end])
            if w is not None and path[end - length] + w > best:
                best = path[end - length] + w
        return best

    def __missing__(self, word: str) -> int:
        marked, path = MARK + word, [0]
        if len(self) >= WORDS:
            self.clear()
        if len(marked) > LONG:
            for end in range(1, len(marked) + 1):
                path.append(self.step(marked, end, path))
            return -path[-1] & 0xFFFFFFFF
        if len(self.values) >= NODES:
            self.children, self.values = {}, [0]
        node, children, values = 0, self.children, self.values
        for end, char in enumerate(marked, 1):
            child = children.get((node, char))
            if child is None:
                child = children[node, char] = len(values)
                values.append(self.step(marked, end, path))
            node = child
            path.append(values[node])
        count = self[word] = -path[-1] & 0xFFFFFFFF
        return count


@lru_cache(1)
def counter(path: str) -> Counter:
    """One per worker, so that tasks share what it has seen."""
    return Counter(load_scores(path))


def counts(text: Column, path: str) -> Column:
    """Struct of ``n_words`` and ``n_tokens`` of a text column."""
    @F.pandas_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
    def fn(texts: pd.Series) -> pd.DataFrame:
        out, known = [], counter(path)
        for t in texts:
            # bytes part at ASCII blanks only
            words = [w.decode("utf-8", "replace") for w in t.encode("utf-8", "replace").split()] if t else []
            out.append((len(words), sum(map(known.__getitem__, words))))
        return pd.DataFrame(out, columns=["n_words", "n_tokens"], dtype="int64")

    return fn(text)


def token_counts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_words, n_tokens)`` of every row; null, empty and blank texts have none; repeated rows repeat."""
    return df.select(F.col(key), counts(F.col(text), path).alias("c")).select(key, "c.n_words", "c.n_tokens")
