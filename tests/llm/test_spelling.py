"""Spelling variants against all pairs by hand, whole and split states; machines; odd rows."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arealis.llm import spelling

SCHEMA = "doc_id long, text string, n long, word string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(counts):
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if one_edit(w, v)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = [form, None, n, len(near), -best[0] if form else None]
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        row[1] = at
    return {w: tuple(row) for w, row in out.items()}


@given(st.sets(st.text("abé", max_size=5), max_size=25))
@settings(max_examples=80, deadline=None)
def test_composed_machine(words):
    words = sorted(words)
    pairs = [(u, v) for u, v, _ in spelling.one_edit_pairs(spelling.Acceptor(words))]
    assert len(pairs) == len(set(pairs))  # each path once
    want = {frozenset((a, b)) for a in words for b in words if a != b and one_edit(a, b)}
    assert {frozenset((words[u], words[v])) for u, v in pairs} == want and len(pairs) == len(want)


def test_acceptor_is_minimal():
    a = spelling.Acceptor(sorted(x + y + "ing" for x in "abc" for y in "xyz"))
    alive, todo = {0}, [0]
    while todo:
        for s in a.arcs[todo.pop()].values():
            if s not in alive:
                alive.add(s)
                todo.append(s)
    assert len(alive) == 6 and a.size[0] == 9


@pytest.mark.parametrize("limit", [20_000, 5])
def test_variants_by_hand(spark, limit):
    rng = random.Random(limit)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8]))): rng.choice([5, 6, 25, 30, 150]) for _ in range(220)}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    df = spark.createDataFrame([(1, text, 0, "x")], SCHEMA)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n)
           for r in spelling.spelling_variants(df, limit=limit).collect()}
    assert got == by_hand(words)
    assert any(v[1] not in (k, v[0]) for k, v in got.items())  # chains of forms


def test_counts_with_dropped_letters(spark):
    texts = [(k, f"Quelque-chose ÉTÉS straße {'abcdefgh' * 3} word{k}word " * 9, 0, "x") for k in range(300)]
    rows = [*texts, (None, "nothing nothing", 0, None), (7, None, 0, None), (8, "", 0, None), texts[0],
            (9, "verylong" * 60_000, 0, "x")]
    want = Counter()
    for k, text, *_ in rows:
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for run in spelling.RUN.findall(lowered):
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            word = run if h % 7 else run[:h % len(run)] + run[h % len(run) + 1:]
            if len(word) >= 6:
                want[word] += 1
    got = spelling.word_counts(spark.createDataFrame(rows, SCHEMA), "text", "doc_id", spelling.dropped_letter(7))
    assert {r.word: r.n for r in got.collect()} == want
    assert "nothing" in want and any(len(w) == 23 for w in want)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_variants(empty).count() == 0
    alone = spark.createDataFrame([(1, "single " * 5, 0, "x"), (2, None, 0, "x")], SCHEMA)
    assert [tuple(r) for r in spelling.spelling_variants(alone).collect()] == [("single", None, "single", 5, 0, None)]
