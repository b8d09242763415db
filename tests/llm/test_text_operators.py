"""Text operators against brute force, exact round trips and held-out accuracy; nulls, empty tables, clashing names."""

import math
import pathlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arealis.llm import (chat, decontamination, language, licenses, packing, quality, queries, sharding, simhash,
                         token_counts, toxicity)
from tools.compare import compare

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="tables absent")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "été 日本 " * 9, None, "a", 0),
       (4, "été 日本 " * 9, None, "a", 0), (None, "one two three four five six", "en", "b", 1), (None, None, "en", "b", 1),
       (5, "word " * 60_000, "fr", "a", 1), (6, "1234 5678", "fr", "a", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    result, _ = compare(spark, FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert result.startswith("ok"), result


# -- sharding

@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation_goes_both_ways(n):
    x = np.arange(n)
    y = sharding.permuted(x, n, 7)
    assert sorted(y) == list(x)
    assert (sharding.permuted(y, n, 7, back=True) == x).all()
    if n >= 64:
        assert (sharding.permuted(x, n, 8) != y).any()


def test_shards_do_not_depend_on_the_layout(spark):
    rows = spark.range(1000).select((F.col("id") % 700).alias("k"), F.lit(1).alias("slot"))
    got = [sorted(map(tuple, sharding.shard_rows(rows.repartition(n), 8, ["k"]).select("k", "shard", "slot").collect()))
           for n in (1, 7)]
    assert got[0] == got[1]
    by = defaultdict(list)
    for _, shard, slot in got[0]:
        by[shard].append(slot)
    assert all(sorted(v) == list(range(125)) for v in by.values()) and len(by) == 8


def test_shards_of_odd_rows(odd, empty):
    got = sharding.shard_rows(odd.select("doc_id", "text"), 4, ["doc_id"]).collect()
    assert sorted(r["row_number"] for r in got) == list(range(len(ODD)))
    assert sharding.shard_rows(empty.select("doc_id"), 4, ["doc_id"]).count() == 0


# -- decontamination

def edit_distance(a, b):
    """Least edits between ``a`` and any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return min(row)


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        rng.choice((lambda: words.__setitem__(at, f"new{at}"), lambda: words.insert(at, f"more{at}"),
                    lambda: words.pop(at)))()
    return words


def test_leaks_agree_with_brute_force(spark):
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(8, 60)))) for i in range(30)] + [(99, "too short")]
    docs = []
    for k in range(150):
        words = rng.choices(pool, k=rng.randrange(0, 200))
        if k % 2:
            item = items[rng.randrange(30)][1].split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, item, rng.randrange(0, 1 + len(item) // 4))
        docs.append((k, " ".join(words).upper() if k % 3 else ",\n".join(words)))
    want = {}
    for k, t in docs:
        for i, x in items[:30]:
            d = edit_distance(x.split(), decontamination.words(t))
            if d <= int(0.2 * len(x.split()) + 1e-9):
                want[k, i] = d
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and len(want) > 40


def test_leaks_at_any_place_of_a_long_text_and_of_odd_rows(spark, odd, empty, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog again and again until it is dark"
    items = spark.createDataFrame([(1, item), (None, item), (2, None), (3, "")], "item_id long, text string")
    monkeypatch.setattr(decontamination, "BATCH_WORDS", 100)
    index = decontamination.Items([(1, item)])
    for at in (0, 50, 83, 95, 99, 100, 101, 199, 500):
        found = index.search([" ".join(["pad"] * at + item.split() + ["pad"] * 300)])
        assert [(r[2], r[3], r[4]) for r in found] == [(at, at + 16, 0)]
    assert decontamination.leaks(odd, items).count() == 0
    assert decontamination.leaks(empty, items).count() == 0
    assert decontamination.leaks(odd, items.limit(0)).count() == 0
    clash = odd.withColumnRenamed("lang", "item_id").withColumn("edits", F.lit(1))
    assert decontamination.drop_contaminated(clash, items).count() == len(ODD)


@pytest.mark.parametrize("length", [5, 20, 60, 200, 1200])
def test_items_of_any_length_are_found_at_the_bound(length):
    rng = random.Random(length)
    pool = [f"w{k}" for k in range(2000)]
    items = [rng.choices(pool, k=length) for _ in range(4)]
    index, most = decontamination.Items([(k, " ".join(x)) for k, x in enumerate(items)]), length // 5
    for k, item in enumerate(items):
        gone = set(rng.sample(range(length), most))
        for part in (item[most:], item[:length - most], [w for i, w in enumerate(item) if i not in gone],
                     [w if i not in gone else f"new{i}" for i, w in enumerate(item)], edited(rng, item, most)):
            found = index.search([" ".join(rng.choices(pool, k=30) + part + rng.choices(pool, k=30))])
            assert [r[1] for r in found] == [k] and found[0][4] <= most


def test_low_similarities_lose_nothing():
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(60)]
    for similarity in (0.3, 0.5, 0.6):
        items = [rng.choices(pool, k=rng.randrange(5, 30)) for _ in range(20)]
        index = decontamination.Items([(k, " ".join(x)) for k, x in enumerate(items)], similarity)
        for _ in range(20):
            text = rng.choices(pool, k=40) + edited(rng, rng.choice(items), 3) + rng.choices(pool, k=20)
            want = {(k, d) for k, x in enumerate(items)
                    if (d := edit_distance(x, text)) <= int((1 - similarity) * len(x) + 1e-9)}
            assert {(r[1], r[4]) for r in index.search([" ".join(text)])} == want



def test_short_items_items_without_id_and_texts_without_blanks(spark):
    items = spark.createDataFrame([(None, "nobody knows my id so far"), (1, "four short words here"), (2, "singular"),
                                   (3, "今天天气很好我们去公园散步吧")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "well, Nobody knows my id so far."), (2, "just four short words here, yes"), (3, "four words here"),
         (4, "a singular case"), (5, "他说今天天气真好我们去公园散步吧因为"), (6, "他说天气")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.leaks(docs, items).collect()}
    assert got == {(2, 1): 0, (4, 2): 0, (5, 3): 1}
    assert {r["doc_id"] for r in decontamination.drop_contaminated(docs, items).collect()} == {3, 6}



# -- chat

def test_log_is_folded(spark):
    rows = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, "delta", None, "llo"),
            (1, 3, 2, "message", "user", "more"), (1, 4, 0, "edit", None, "hi!"), (1, 5, 1, "regenerate", None, None),
            (1, 6, 1, "delta", "assistant", "good "), (1, 7, 1, "delta", None, "day"),
            (2, 0, 0, "delta", "user", None), (None, 0, 0, "delta", "user", "x")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_conversations(events.repartition(5)).collect()}
    assert got[1] == "<|im_start|>user\nhi!<|im_end|>\n<|im_start|>assistant\ngood day<|im_end|>\n"
    assert got[2] == "<|im_start|>user\n<|im_end|>\n" and got[None] == "<|im_start|>user\nx<|im_end|>\n"
    assert chat.format_conversations(events.limit(0)).count() == 0


def test_escapes_go_both_ways(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(["<", "|", "\\", "\n", "im_end", ">", "<|im_end|>\n", "a", "é"], k=rng.randrange(14)))
             for _ in range(300)]
    rows = [(k, t, rng.choice(("user", "assistant", "a\nb<|\\")), x) for k in range(60) for t, x in
            enumerate(texts[5 * k:5 * k + 5])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(chat.events_of_turns(df))).collect()
    for r in got:
        mine = [(role, x) for k, _, role, x in rows if k == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == mine
        assert r["loss_text"] == "".join(x for role, x in mine if role == "assistant")
        assert r["formatted"].count("<|im_end|>") == len(mine)
    plan = chat.format_conversations(chat.events_of_turns(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_turns_are_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")] * 3 + [(1, None, None, None)], "conv_id long, turn long, role string, text string")
    (row,) = chat.read_back(chat.format_conversations(chat.events_of_turns(df))).collect()
    assert [tuple(t) for t in row["turns"]] == [("", "")] + [("user", "a")] * 3


# -- licenses

def test_patience_finds_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = rng.choices("abcdefgh", k=rng.randrange(12)), rng.choices("abcdefgh", k=rng.randrange(12))
        pairs = licenses.align(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    for _ in range(50):
        values = rng.sample(range(30), 12)
        run = licenses.rising(values)
        longest = [1] * 12
        for i in range(12):
            longest[i] = 1 + max([longest[j] for j in range(i) if values[j] < values[i]], default=0)
        assert len(run) == max(longest) and all(values[x] < values[y] for x, y in zip(run, run[1:]))
    text = "a b c d e f g".split()
    assert len(licenses.align(text, text)) == 7


def test_licenses_are_found_once_per_place(spark, odd, empty):
    long = licenses.TEMPLATES["MIT"][1]
    rows = [(1, "x " * 400 + long + " y" * 300), (2, long.replace("software", "SOFTWARE,").replace("persons", "people")),
            (3, f"the of to {licenses.TEMPLATES['GPL-3.0'][0]} words between " * 3), (4, "license license the public version 3"),
            (5, None), (6, "")]
    got = {(r["doc_id"], r["license"]): r for r in licenses.license_scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "GPL-3.0")}
    assert got[1, "MIT"]["start"] == 400 and got[1, "MIT"]["coverage"] == 1.0
    assert 0.9 < got[2, "MIT"]["coverage"] < 1.0
    assert got[3, "GPL-3.0"]["places"] == 3 and got[3, "GPL-3.0"]["start"] == 3
    assert licenses.license_scan(odd).count() == 0 and licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize("inserted", [0, 10, 30, 60, 400, 5000])
def test_interrupted_notices_are_found_whole(inserted):
    rng = random.Random(inserted)
    notice, scanner = licenses.words(licenses.TEMPLATES["MIT"][1]), licenses.Scanner({"MIT": [licenses.TEMPLATES["MIT"][1]]})
    block = [f"page{k}" for k in range(inserted)]
    for cut in (10, len(notice) // 2, len(notice) - 10):
        text = ["before"] * 20 + notice[:cut] + block + notice[cut:] + ["after"] * 20
        whole = len(licenses.align(text, notice)) / len(notice)
        (got,) = scanner.scan(" ".join(text))
        assert got[1] == whole == 1.0 or inserted < 10
        assert got[2:] == (20, 20 + len(notice) + inserted, 1)
        assert scanner.scan(" ".join(text * 2 + notice))[0][4] == 3
    thin = notice[:20] + block + [x for x in notice[20:40] if rng.random() < 0.9] + block + notice[40:]
    # what stands beside a run counts, a lone word in the block does not
    assert scanner.scan(" ".join(thin))[0][1] > (len(licenses.align(thin, notice)) - licenses.RUN) / len(notice)


def test_long_texts_collect_no_notice():
    from pydoc_data.topics import topics

    rng, scanner = random.Random(3), licenses.Scanner(licenses.TEMPLATES)
    manual = " ".join(topics.values())
    assert len(licenses.words(manual)) > 50_000 and scanner.scan(manual) == []
    common = licenses.words(manual)[:3000]
    theirs = sorted(scanner.vocabulary)
    text = [rng.choice(common) if rng.random() < 0.4 else rng.choice(theirs) if rng.random() < 0.1 else f"w{rng.randrange(9999)}" for _ in range(200_000)]
    assert scanner.scan(" ".join(text)) == []
    notice = licenses.words(licenses.TEMPLATES["MIT"][1])
    text[1000:1000], text[150_000:150_000] = notice[:30], notice[30:]  # the same text with a notice in two parts
    ((name, share, start, end, places),) = scanner.scan(" ".join(text))
    assert (name, share, places) == ("MIT", 1.0, 1) and start == 1000 and end == 150_000 + len(notice) - 30


def test_places_agree_with_whole_text_patience():
    rng = random.Random(9)
    notice, scanner = licenses.words(licenses.TEMPLATES["MIT"][1]), licenses.Scanner({"MIT": [licenses.TEMPLATES["MIT"][1]]})
    for _ in range(150):
        text, at = [f"a{k}" for k in range(rng.randrange(60))], 0
        while at < len(notice):  # parts of seven words or more, some words changed, blocks between
            step = rng.randrange(7, 40)
            text += [x if rng.random() < 0.97 else "changed" for x in notice[at:at + step]] + [f"b{rng.randrange(10 ** 6)}" for _ in range(rng.choice([0, 0, 3, 50, 900]))]
            at += step
        whole = len(licenses.align(text, notice)) / len(notice)
        got = scanner.scan(" ".join(text))
        if whole >= 0.9:
            assert len(got) == 1 and whole - 0.08 < got[0][1] <= whole, (whole, got)
        if whole < licenses.COVERAGE:
            assert got == []


def test_scattered_words_are_no_notice():
    filler = " x" * 50
    text = filler.join(["it was released", "under it", "the driver", "mit", "had no license"])
    assert licenses.Scanner(licenses.TEMPLATES).scan(text) == []



# -- packing

def check_packing(rows, ids, window):
    """Every id in one piece, offsets gapless, windows full but for the last of a task."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for k, got in pieces.items():
        at = 0
        for start, length, crc, total in sorted(got):
            assert start == at and total == len(ids[k]) and length > 0
            assert zlib.crc32(np.array(ids[k][start:start + length], "<u4").tobytes()) == crc
            at += length
        assert at == len(ids[k])
    for got in windows.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= window
    return windows


@needs_tables
def test_pieces_hold_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = documents(spark) | {-1: None, -2: "", -3: "<|endoftext|> x", -4: "日本 語 a", -5: "\x1ca b\x85  c 's²"}
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    check_packing(packing.pack(df, path).collect(), ids, packing.WINDOW)
    windows = check_packing(packing.pack(df, path, ranks=queries.vocabulary("byte_bpe_50k.tiktoken")).collect(), ids,
                            packing.WINDOW)
    assert sum(sum(n for _, n in w) < packing.WINDOW for w in windows.values()) <= 2
    assert packing.pack(df.limit(0), path).count() == 0


def test_bm25_agrees_with_the_formula_and_neighbours_come_first():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, rng.integers(1, 30)) for _ in range(30)]
    index, size = packing.ShardIndex(docs), np.mean([len(d) for d in docs])
    got = index.scores(index.terms[4])
    for k, d in enumerate(docs):
        want = 0.0
        for t in set(docs[4].tolist()):
            df = sum(t in x for x in docs)
            tf = int((d == t).sum())
            want += math.log(1 + (30 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / size))
        assert math.isclose(got[k], want)
    docs = [np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([1, 2, 4]), np.array([7, 8, 6])]
    assert [p[0] for p in packing.Packer(6).add(docs)] == [0, 2, 1, 3]


def test_blanks_choose_the_rule_and_ids_are_the_tokenizers():
    encoder = packing.Encoder(queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("byte_bpe_50k.tiktoken"))
    rng, pool = random.Random(6), ["a", "It's", "we'll", "'", "''s", "12", "é", "ÿx", "ő", "²", ".", "\t", "\n", " ", "  ", "\x1c", "\x85", "\xa0"]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(800)]
    texts += ["one blank at a time\n", "two  blanks", "x\n\ny", "x \xa0y", "\x85ő", "漢字", packing._UNUSED, f"a {packing._UNUSED}"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encoder._of("ça va, it's one blank\n") is encoder.single and "(?!" not in packing._SINGLE
    assert all(encoder._of(t) is encoder.short for t in ("a  b", "x\n\ny", "x \xa0y", "ő \n"))


def test_terms_of_many_documents_are_added_as_rows():
    rng = np.random.default_rng(8)
    docs = [np.unique(np.append(rng.integers(2, 3000, 20), 1)) for _ in range(400)]
    index = packing.ShardIndex(docs)
    got, want = index.scores(index.terms[0]), np.zeros(len(docs))
    assert list(index.rows) == [1]
    for t in docs[0]:
        at = slice(index.begin[t], index.begin[t + 1])
        want[index.doc[at]] += index.weight[at]
    assert np.allclose(got, want, rtol=1e-12)


def test_neighbours_meet_from_any_place_of_the_table(spark):
    rng = random.Random(5)
    pool = [f"{a}{b}" for a in ("stone", "river", "cloud", "paper") for b in range(400)]
    topics = [rng.sample(pool, 60) for _ in range(600)]
    texts = [(k, " ".join(rng.choices(topics[k % 600], k=80))) for k in range(1200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")

    def windows(df, shard_tokens=packing.SHARD_TOKENS):
        found = defaultdict(set)
        for r in packing.pack(df, queries.vocabulary("byte_bpe_50k.json"), window=1024, shard_tokens=shard_tokens).collect():
            found[r["sequence_id"]].add(r["doc_id"])
        return sorted(map(sorted, found.values()))

    def met(found):
        return sum(any(k in w and k + 600 in w for w in found) for k in range(600))

    got = windows(df.coalesce(1))
    several = met(windows(df, 1 << 14))
    assert met(got) > 120, met(got)  # 600 rows apart; about one document in six begins a window, by chance there were 2
    assert several > 40, several
    assert windows(df.orderBy(F.xxhash64("doc_id")).repartition(7)) == got


def test_cuts_part_tokens_evenly():
    sample = [(bytes([k]), 10) for k in range(100)] + [(bytes([200]), 1000)]
    assert packing.cuts(sample, 4) == [bytes([49]), bytes([99]), bytes([200])]
    assert packing.cuts([], 4) == [] and packing.cuts(sample, 1) == []


def test_ranked_documents_are_those_of_a_full_sort():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 12, rng.integers(1, 9)) for _ in range(300)]
    index, unused = packing.ShardIndex(docs), rng.random(300) < 0.7
    for k in range(20):
        scores = index.scores(index.terms[k])
        want = [d for d in np.argsort(-scores, kind="stable").tolist() if unused[d]]
        assert list(packing.Packer._ranked(index, index.terms[k], unused)) == want


# -- quality

def plain_counts(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if any(c not in " \t\x0b\x0c\r" for c in x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered), len(lines))


def test_counts_agree_with_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "a a a", "a a a a", "\x1ca\xa0b c", "é é é é # <b>"]
    texts += ["".join(rng.choices(["a", "b", " ", "  ", "\n", "\t", "é", "|", "\x85"], k=rng.randrange(80))) for _ in range(300)]
    for t in texts:
        assert quality.text_counts(t) == plain_counts(t), t


def test_sketch_quantiles_are_near(spark):
    rng = random.Random(6)
    values = [int(rng.paretovariate(1) * 50) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket(F.col("v")).alias("b"))
    rows = df.collect()
    span = defaultdict(list)
    for r in rows:
        span[r["b"]].append(r["v"])
    ordered = sorted(span)
    assert all(max(span[a]) < min(span[b]) for a, b in zip(ordered, ordered[1:]))
    assert all(max(v) - min(v) <= min(v) / 32 for v in span.values())


def test_junk_goes_and_odd_rows_have_verdicts(spark, odd, empty):
    rng = random.Random(8)
    clean = [(k + 2000, " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(120)), "en", f"s{k % 2}", 1)
             for k in range(500)]
    junk = [(1000, " ".join("###" + w for w in clean[0][1].split()), "en", "s0", 1),
            (1001, "\n".join([" ".join(clean[1][1].split()[:12])] * 2 + clean[2][1].split() * 1), "xx", None, 1),
            (1002, "\n".join(["one line of words here " + "q" * k for k in (1, 2)] * 20), "en", "s1", 1)]
    df = spark.createDataFrame(clean + junk + ODD, SCHEMA)
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert sum(got[k]["kept"] for k in range(2000, 2500)) >= 498
    assert not got[1000]["kept"] and not got[1002]["kept"]
    assert all(not got[k]["kept"] and got[k]["base_failed"] for k in (1, 2, 3, 5, 6))
    kept = quality.keep_good(df.withColumn("n_words", F.lit("own")).withColumn("kept", F.lit(0)))
    assert set(kept.columns) == {*df.columns, "n_words", "kept"} and {r["n_words"] for r in kept.collect()} == {"own"}
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


# -- token counts

def plain_tokens(scores, word):
    word, best = token_counts.MARK + word, [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * token_counts.FALLBACK, best[end - 1][1] - n)]
        options += [(best[b][0] + scores[word[b:end]], best[b][1] - 1) for b in range(end) if word[b:end] in scores]
        best.append(max(options))
    return -best[-1][1]


def test_trie_agrees_with_plain_dynamic_programming(monkeypatch):
    rng = random.Random(9)
    scores = {"".join(rng.choices("abc▁", k=rng.randrange(1, 5))): -rng.randrange(1, 90) for _ in range(60)}
    words = ["".join(rng.choices("abcdé", k=rng.randrange(0, 12))) for _ in range(500)] + ["a" * 200]
    monkeypatch.setattr(token_counts, "NODES", 300)
    monkeypatch.setattr(token_counts, "WORDS", 200)
    counter = token_counts.Counter(scores)
    assert [counter[w] for w in words] == [plain_tokens(scores, w) for w in words]


def test_token_counts_of_odd_rows(odd, empty):
    path = queries.vocabulary("piece_bpe_32k.model")
    got = token_counts.token_counts(odd, path).collect()
    assert [(r["n_words"], r["n_tokens"]) for r in got[:3]] == [(0, 0)] * 3
    scores = token_counts.load_scores(path)
    assert got[5]["n_tokens"] == sum(plain_tokens(scores, w) for w in "one two three four five six".split())
    assert token_counts.token_counts(empty, path).count() == 0


# -- toxicity

def test_block_maxima_give_the_exact_neighbours(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    names = [f"t{k}" for k in range(40)]
    examples = [(k, rng.randrange(2), {t: rng.randrange(1, 4) for t in rng.sample(range(40), rng.randrange(0, 9))})
                for k in range(300)]
    index = toxicity.Index(toxicity.Vocabulary(names), np.array([rng.uniform(0.5, 4) for _ in range(40)]), examples)
    dense = np.zeros((len(index.vectors), 40))
    for k, (t, w) in enumerate(index.vectors):
        dense[k, t] = w
    for _ in range(100):
        vector = index.vector({t: 1 for t in rng.sample(range(40), rng.randrange(1, 9))})
        at, cosine = index.nearest(vector)
        every = dense[:, vector[0]] @ vector[1]
        want = sorted(range(len(every)), key=lambda k: (-round(every[k], 12), k))[:toxicity.NEIGHBOURS]
        want = [k for k in want if every[k] > 0]
        assert at.tolist() == want and np.allclose(cosine, every[want])


def test_learned_words_decide(spark, odd, empty):
    rng = random.Random(12)
    pool = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = []
    for k in range(1200):
        words = rng.choices(pool, k=60)
        toxic = k % 6 == 0
        if toxic:
            words += rng.choices(["vile", "nasty", "awful"], k=3)
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 0, r[2]) for r in rows] + [(None, 1, 1), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[k]["predicted"] == y for k, _, y in rows)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = zlib.crc32(b"6") % 3 == 1
    assert got[6]["held_out"] == held
    assert toxicity.keep_clean(docs.withColumn("score", F.lit("x")), labels).count() == 1000
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(odd, labels).count() == len(ODD)
    assert toxicity.toxicity(empty, labels).count() == 0


# -- SimHash

def test_golay_keys_meet_within_one_bit():
    rng = np.random.default_rng(13)
    words = rng.integers(0, 1 << 23, 3000)
    codes = simhash.segment_codes(words)
    assert ((codes >= 0).sum(1)[:, None] == [1, 6]).any(1).all()
    for bit in range(23):
        nearest = simhash.segment_codes(words ^ (1 << bit))[:, 0]
        assert (codes == nearest[:, None]).any(1).all()


def plain_fingerprint(text, shingle=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + shingle]).encode(), 42) for k in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_components(texts):
    """Smallest key reachable over fingerprints that differ in at most 3 bits; and the fingerprints."""
    prints = {k: plain_fingerprint(t) for k, t in texts.items()}
    label = {k: k for k in texts}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}, prints


@needs_tables
def test_components_agree_with_brute_force(spark):
    texts = documents(spark) | {-1: None, -2: "", -3: "A B", -4: "a b", -5: "É x Y z"}
    base = texts[min(k for k, t in texts.items() if t and len(t.split()) > 300)].split()
    rng = random.Random(14)
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"x{k}"
        texts[10_000 + k] = " ".join(words)
    roots, prints = plain_components(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in simhash.near_copies(df).collect()}
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == prints
    assert {k: r["component_id"] for k, r in got.items()} == roots
    assert len(set(roots.values())) < len(texts) - 40
    kept = simhash.drop_near_copies(df.withColumn("fp", F.lit("own")).withColumn("row", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))
    assert kept.columns == ["doc_id", "text", "fp", "row"]


def test_components_of_long_chains(spark):
    rng = random.Random(15)
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1300)]
    rng.shuffle(links)
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1300)}


def test_near_copies_of_odd_rows(odd, empty):
    got = simhash.near_copies(odd).collect()
    assert len(got) == len(ODD)
    blank = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert blank == {1}
    assert simhash.drop_near_copies(odd).count() == 5  # blank, été, six words, word word, numbers
    assert simhash.near_copies(empty).count() == 0 and simhash.drop_near_copies(empty).count() == 0


# -- language

@needs_tables
def test_held_out_languages(spark, odd, empty):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language.identify(df).join(df.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    both = df.unionByName(odd)
    found = language.identify(both.withColumn("score", F.lit(1))).collect()
    assert len(found) == both.count() and all(0 <= r["score"] <= 1 for r in found)
    assert language.identify(odd).count() == len(ODD)
    got = [r["lang_pred"] for r in language.identify(odd.filter("doc_id in (1, 2, 3, 6)")).collect()]
    assert got == ["und"] * 4
    assert language.identify(empty).count() == 0


def buckets_by_hand(text):
    codes = [ord(c) for c in f" {' '.join(text.lower().split())} "]
    for order in (1, 2, 3):
        for k in range(len(codes) - order + 1):
            h = order
            for c, mix in zip(codes[k:k + order], (2654435761, 2246822519, 3266489917)):
                h = ((h ^ c) * mix) & 0xFFFFFFFF
                h ^= h >> 15
            yield h % language.BUCKETS


def test_naive_bayes_by_hand(spark):
    rng = random.Random(6)
    pools = {"xx": "aeiou xyz", "yy": "bcdfg hij", "zz": "aeiou bcd"}
    rows = [(k, "".join(rng.choices(pools[lang], k=40)), lang) for k, lang in enumerate(rng.choices(list(pools), k=90))]
    df = spark.createDataFrame(rows + [(200, "aeiou", None), (201, "12 34", "xx"), (202, None, "yy")], "doc_id long, text string, lang string")
    learned = [r for r in rows + [(201, "12 34", "xx")] if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {lang: Counter(b for _, t, of in learned if of == lang for b in buckets_by_hand(t)) for lang in sorted(pools)}
    for r in language.identify(df.repartition(3)).collect():
        text = dict((k, t) for k, t, _ in df.collect())[r.doc_id] if r.doc_id in (200, 201, 202) else rows[r.doc_id][1]
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        found = list(buckets_by_hand(text))
        logs = {lang: sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * language.BUCKETS)) for b in found) for lang, c in counts.items()}
        best = max(logs, key=logs.get)
        odds = [math.exp((v - logs[best]) / math.sqrt(len(found))) for v in logs.values()]
        assert r.lang_pred == best and math.isclose(r.score, 1 / sum(odds), rel_tol=1e-3)


def test_the_sample_does_not_depend_on_the_layout(spark):
    df = spark.createDataFrame([(k, f"text {k}", "ab"[k % 2]) for k in range(400)], "doc_id long, text string, lang string")
    drawn = [sorted(map(tuple, language.labelled(d, per_language=50).collect())) for d in (df.coalesce(1), df.orderBy("text").repartition(7))]
    assert drawn[0] == drawn[1] and 60 < len(drawn[0]) < 140


def test_counts_of_a_text_in_parts(monkeypatch):
    text = "Straße und Übung, " * 50
    whole = language.text_counts(iter([text]))
    monkeypatch.setattr(language, "_CHUNK", 64)
    assert abs(whole - language.text_counts(iter([text]))).sum() < 60  # ends of parts


# -- pipeline

@needs_tables
def test_pipeline_stages_keep_the_columns_and_do_their_work(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, kept = docs.columns, [documents(spark)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == names, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    start, good, clean, single, texts = kept
    assert len(start) > len(good) >= len(clean) > len(single) >= len(texts) > 0.5 * len(start)
    for k, t in start.items():
        n, _, symbols, dup, repeated, _ = plain_counts(t)
        if n < 50 or 2 * repeated > n or symbols > 2 * n:
            assert k not in good
        elif not symbols and not dup and 20 * repeated < n:
            assert k in good
    predicted = {r["doc_id"]: r["score"] for r in toxicity.toxicity(
        spark.createDataFrame(list(good.items()), "doc_id long, text string"), spark.read.parquet(f"{FOLDER}/labels.parquet"),
        parts=1, held=1).collect()}
    assert set(clean) == {k for k, p in predicted.items() if p < toxicity.THRESHOLD}
    roots, _ = plain_components(clean)
    assert set(single) == set(roots.values())
    items = [" ".join(decontamination.words(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {k for k, t in single.items() if any(i in " ".join(decontamination.words(t)) for i in items)}
    assert set(texts) == set(single) - held
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [1] for k, t in texts.items()}
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect(), ids, packing.WINDOW)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()} == set(texts)
