"""Spelling variants: words one edit apart, found by composing a vocabulary's acceptor with a one-edit transducer.

The machine "acceptor, one edit, acceptor" accepts the pairs of words that differ by one inserted, deleted or replaced
code point. It is not built for the whole vocabulary but by initial states. For two words the shorter of which has
``m`` code points, the edit lies in a stretch ``low .. high`` of it; what stands before and behind is the same in both, so
both acceptors are in the same state when the stretch begins (and, read from the end, when it ends). That state, named by
the strings around the stretch, is the partition: its residual words make a minimised acceptor, and the composition is
enumerated from there. A word starts with the two halves of its length; a state with more than ``limit`` words is
split at the middle of its stretch, down to stretches of one code point, whose words are bounded by the alphabet. The
edit's place is that of the first difference, so a pair is accepted in one partition.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 6, 5
DOMINANCE = 5  # a form has this many times the word's occurrences
LIMIT = 20_000  # words of an initial state
HELD = 1 << 18  # distinct words that a task counts before it hands them on
_STATE = ("low", "high", "m", "before", "behind")


def dropped_letter(every: int) -> Callable[[str, str], str]:
    """Take one code point out of every ``every``-th run of a document, by a checksum of both."""
    def fn(key: str, run: str) -> str:
        h = zlib.crc32(f"{key}:{run}".encode())
        at = h % len(run)
        return run if h % every else run[:at] + run[at + 1:]

    return fn


def word_counts(df: DataFrame, text: str, key: str, change: Callable[[str, str], str] | None = None,
                least_length: int = LEAST_LENGTH) -> DataFrame:
    """``(word, n)``: lower-cased (A-Z only) runs of letters, each passed through ``change(key, run)``, then counted.

    Only runs of at least ``least_length`` code points are passed on: a change may shorten, never lengthen.
    """
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for k, body in zip(batch["key"], batch["body"]):
                # bytes: lowers A-Z only
                runs = Counter(RUN.findall(body.encode("utf-8", "replace").lower().decode()))
                for run, n in runs.items():
                    if len(run) >= least_length:
                        word = change(k, run) if change else run
                        if len(word) >= least_length:
                            total[word] += n
                if len(total) >= HELD:
                    yield pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})
                    total.clear()
        yield pd.DataFrame({"word": pd.Series(list(total.keys()), dtype=object),
                            "n": pd.Series(list(total.values()), dtype=np.int64)})

    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"),
                     F.col(f"`{text}`").alias("body")).filter(F.col("body").isNotNull())
    return rows.mapInPandas(fn, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- machines

class Acceptor:
    """Minimal acceptor of sorted distinct words; ``size`` numbers a state's words, in order, from 0."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        register: dict[tuple, int] = {}
        path = [0]  # states of the last word
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._settle(path, last, same, register)
            for c in word[same:]:
                self.arcs.append({})
                self.final.append(False)
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        self._settle(path, last, 0, register)
        self.size: dict[int, int] = {}
        todo = [0]
        while todo:
            state = todo[-1]
            missing = [s for s in self.arcs[state].values() if s not in self.size]
            if missing:
                todo += missing
            else:
                self.size[state] = self.final[state] + sum(self.size[s] for s in self.arcs[state].values())
                todo.pop()

    def _settle(self, path: list[int], last: str, keep: int, register: dict[tuple, int]) -> None:
        """Replace states behind ``keep`` symbols of the last word by equal ones that are registered."""
        for depth in range(len(path) - 1, keep, -1):
            state = path.pop()
            sign = (self.final[state], *self.arcs[state].items())
            self.arcs[path[-1]][last[depth - 1]] = register.setdefault(sign, state)

    def steps(self, state: int, number: int) -> Iterator[tuple[str, int, int]]:
        """Arcs in order, with the number of the first word behind each."""
        number += self.final[state]
        for c, to in self.arcs[state].items():
            yield c, to, number
            number += self.size[to]


def common_words(a: Acceptor, p: int, q: int, i: int, j: int, but: str | None = None) -> Iterator[tuple[int, int]]:
    """Numbers of the words that are accepted from both states, from ``i`` and ``j``; none that begins with ``but``."""
    todo = [(p, q, i, j, but)]
    while todo:
        p, q, i, j, but = todo.pop()
        if p == q and but is None:
            for k in range(a.size[p]):
                yield i + k, j + k
            continue
        if a.final[p] and a.final[q]:
            yield i, j
        if not a.arcs[p].keys() & a.arcs[q].keys():
            continue
        other = {c: (to, k) for c, to, k in a.steps(q, j)}
        for c, to, k in a.steps(p, i):
            if c != but and c in other:
                todo.append((to, other[c][0], k, other[c][1], None))


def one_edit_pairs(a: Acceptor) -> Iterator[tuple[int, int, int]]:
    """Pairs (u, v, place) of the composed machine: v has one code point more than u, or another one and u < v."""
    todo = [(0, 0, 0)]
    while todo:
        state, number, depth = todo.pop()
        steps = list(a.steps(state, number))
        for k, (c, to, first) in enumerate(steps):
            todo.append((to, first, depth + 1))
            for u, v in common_words(a, state, to, number, first, c):  # c is inserted
                yield u, v, depth
            for _, to2, second in steps[k + 1:]:  # c is replaced
                for u, v in common_words(a, to, to2, first, second):
                    yield u, v, depth


# -- partitions

def states(words: DataFrame, limit: int) -> DataFrame:
    """``words`` (word, n) once for every initial state that they belong to, as columns of ``_STATE``."""
    length = F.length("word")
    m = F.explode(F.array(length, length - 1))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("low"), F.floor(F.col("m") / 2).cast("int").alias("high")),
                               F.struct(F.floor(F.col("m") / 2).cast("int").alias("low"), F.col("m").alias("high"))))

    def named(df: DataFrame) -> DataFrame:
        rest = F.col("m") - F.col("high")
        return df.withColumns({
            "before": F.substring(F.col("word"), F.lit(1), F.col("low")),
            "behind": F.substring(F.col("word"), F.length("word") - rest + 1, rest)})

    # a stretch of a shorter word than any in the vocabulary has no second word
    shortest = words.agg(F.min(length)).first()[0] or 0
    keyed = named(words.withColumn("m", m).filter(F.col("m") >= shortest).withColumn("half", halves)
                  .select("word", "n", "m", "half.low", "half.high"))
    while True:
        crowded = stored(keyed.groupBy(*_STATE).agg(F.count("*").alias("words")).filter(
            (F.col("words") > limit) & (F.col("high") - F.col("low") > 1)).drop("words"))
        if crowded.isEmpty():
            return keyed
        crowd = keyed.join(crowded, list(_STATE), "left_semi")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        parts = F.explode(F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high")))
        split = named(crowd.withColumn("half", parts).select("word", "n", "m", "half.low", "half.high"))
        keyed = stored(keyed.join(crowded, list(_STATE), "left_anti").unionByName(split))


def _near_in_state(words: list[str], counts: list[int], m: int, low: int, high: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest n among them, its word) from one state, for words that have any there."""
    rest = m - high
    residual = sorted((w[low:len(w) - rest], k) for k, w in enumerate(words))
    places = [k for _, k in residual]
    near: dict[int, int] = {}
    best: dict[int, tuple[int, str]] = {}
    for u, v, at in one_edit_pairs(Acceptor([r for r, _ in residual])):
        u, v = places[u], places[v]
        # of words that are both the longer kind, the pair belongs to their own m; at the end of the stretch, to the next
        if len(words[u]) > m and len(words[v]) > m or at >= high - low and rest:
            continue
        for a, b in ((u, v), (v, u)):
            near[a] = near.get(a, 0) + 1
            found = (-counts[b], words[b])
            if a not in best or found < best[a]:
                best[a] = found
    for k, n in near.items():
        yield words[k], n, -best[k][0], best[k][1]


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(word, n_near, form_n, form)``: near words of each word that has any, and the one with the largest ``n``."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, held = None, []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                m, low, high = state[2], state[0], state[1]
                out.extend(_near_in_state([w for w, _ in held], [n for _, n in held], m, low, high))

        for batch in batches:
            for *of, word, n in zip(*(batch[c].tolist() for c in (*_STATE, "word", "n"))):
                if of != state:
                    close()
                    state, held = of, []
                held.append((word, n))
            if out:
                yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])

    dealt = states(words, limit).repartition(*_STATE).sortWithinPartitions(*_STATE)
    found = dealt.mapInPandas(fn, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("rank"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.rank")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from a stored table (word, form or null): forms followed to the last one, by pointer doubling."""
    at = stored(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = at.select(F.col("word").alias("of"), F.col("root").alias("next"))
        further = stored(at.join(step, F.col("root") == F.col("of")).select("word", "root", "next"))
        settled = further.filter("next <> root").isEmpty()
        at = further.select("word", F.col("next").alias("root"))
        if settled:
            return at


def spelling_variants(df: DataFrame, text: str = "text", key: str = "doc_id",
                      change: Callable[[str, str], str] | None = None, least_length: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, dominance: int = DOMINANCE, limit: int = LIMIT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of enough length and occurrences.

    Near words differ by exactly one code point; the form is the near word with the largest ``n`` (ties: the smallest in
    code-point order) if that is at least ``dominance`` times the word's, else null; the root follows forms to
    the last. Null and empty texts have no words, a null key is an empty one for ``change``, repeated rows count
    again, other columns are not read, an empty table gives no rows.
    """
    words = stored(word_counts(df, text, key, change, least_length).filter(F.col("n") >= least_count))
    near = near_words(words, limit).withColumnsRenamed({"form": "near", "form_n": "near_n"})
    is_form: Column = F.col("near_n") >= dominance * F.col("n")
    joined = stored(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n")))
    return joined.join(roots(joined), "word").select("word", "form", "root", "n", "n_near", "form_n")
