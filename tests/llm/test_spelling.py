import random
import zlib

import numpy as np
import pytest

from opquality.llm.spelling import Ranges, TrieNumbers, count_words, runs_of, spelling_variants, with_planted_deletions


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def expected(counts, ratio=10):
    form = {}
    for w in counts:
        best = min((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, form[w], root, sum(near(w, v) for v in counts), counts[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "n", "form", "root", "n_near", "form_n").collect())


def table(spark, counts, parts=3):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(parts)


def test_variants_equal_a_plain_search(spark):
    rng = random.Random(2)
    counts = {}
    for _ in range(40):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 8)))
        for _ in range(12):
            counts.setdefault(word, rng.choice([1, 2, 3, 30, 300, 3000]))
            at, how = rng.randint(0, len(word)), rng.randint(0, 2)
            word = word[:at] + ("" if how == 0 else rng.choice("abé😀")) + word[at + (how != 1):]
    assert found(spelling_variants(table(spark, counts))) == expected(counts)


@pytest.mark.parametrize("counts", [
    {"aaaa": 100, "aaaaa": 10, "aaa": 1}, {"": 10, "a": 1, "b": 100, "c": 100}, {"abcd": 5, "abdc": 5, "wxyz": 9}, {"one": 1},
    {"abc": 2000, "abd": 200, "abe": 20, "abf": 2, "xbf": 1}, {"a" * 70_000: 20, "a" * 70_001: 2, "a" * 69_999 + "b": 2, "b" + "a" * 70_000: 1},
])
def test_runs_of_equal_letters_ties_chains_and_long_words(spark, counts):
    assert found(spelling_variants(table(spark, counts))) == expected(counts)


def test_no_words_and_null_words(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert found(spelling_variants(empty)) == []
    odd = spark.createDataFrame([(None, 5, "x"), ("word", 7, "y")], "word string, n long, rank string")
    assert found(spelling_variants(odd)) == [("word", 7, None, "word", 0, None)]


def test_numbers_do_not_depend_on_where_ranges_are_cut():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(150)})
    for cuts in ([], [1, 2, 3], [40, 41, 90], list(range(1, len(words), 7))):
        names, rows = {}, []
        for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(words)])):
            numbers = TrieNumbers()
            own = words[lo:hi]
            pieces = [numbers.add(own[k:k + 5]) for k in range(0, len(own), 5)]
            nodes = np.concatenate([p[0] for p in pieces])
            row = type("Row", (), {"part": part, "first": words[lo], "last": words[hi - 1], "path": numbers.path.tolist(), "nodes": numbers.count, "words": numbers.words})
            rows.append((row, own, nodes))
        ranges = Ranges([r for r, _, _ in rows])
        for row, own, nodes in rows:
            whole, at = ranges.numbers(row.part, nodes), 0
            for word in own:
                for depth in range(1, len(word) + 1):
                    assert names.setdefault(word[:depth], int(whole[at])) == whole[at]
                    at += 1
        assert len(set(names.values())) == len(names)


def test_words_of_whole_texts(spark):
    docs = [(1, "Straßen straßen, ÜBERMUT über-mut naïvely NAÏVELY"), (2, None), (None, "ABCDEFGH abcdefgh"), (3, ""), (4, "x" * 300_000 + " ok"), (4, "again again again")]
    frame = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, id string")
    counts = {}
    import re
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 3 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    got = count_words(with_planted_deletions(runs_of(frame, 5), every=3), 5, 1)
    assert {r.word: r.n for r in got.collect()} == counts
