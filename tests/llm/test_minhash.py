import numpy as np
import pytest
from plain_words import words

from opquality.llm.common import map_arrow
from opquality.llm.jaccard_join import jaccard_components, marks, signatures
from opquality.llm.minhash import band_keys, bin_values, densified, near_duplicates
from opquality.llm.settle import settle


def expected(rows, percent=85):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    least = list(range(len(rows)))

    def top(n):
        while least[n] != n:
            n = least[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    first = {}
    for n, (doc, _) in enumerate(rows):
        if doc is not None:
            first[top(n)] = min(doc, first.get(top(n), doc))
    out = [(doc, len(sets[n]), first.get(top(n)) if sets[n] else doc) for n, (doc, _) in enumerate(rows)]
    return sorted([(*r, r[0] == r[2]) for r in out], key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_components_equal_a_plain_search(make, prose):
    short = "one two three four five six seven eight nine ten"
    rows = [(n + 100, t) for n, t in prose] + [
        (1, None), (2, ""), (3, " \n"), (4, "Just Three Words"), (5, "just three\twords"), (6, "just three"), (7, short), (8, short + " eleven"),
        (9, short.upper()), (9000, short), (9000, short), (None, short), (None, "nobody else says this"), ((1 << 63) - 1, "nor this"), (-(1 << 63), short + " eleven"),
    ]
    assert found(near_duplicates(make(rows, "n", "id", "row", "key", "label").repartition(3))) == expected(rows)


def test_a_large_group_with_outliers(make):
    base = [f"w{n}" for n in range(120)]
    rng = np.random.default_rng(4)
    rows = []
    for n in range(200):
        changed = list(base)
        for k in range(int(rng.integers(0, 5))):
            changed[int(rng.integers(0, 120))] = f"x{n}-{k}"
        rows.append((n, " ".join(changed)))
    assert found(near_duplicates(make(rows))) == expected(rows)
    joined = jaccard_components(make(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in joined) == sorted((r[0], r[2]) for r in expected(rows, 75))


def test_large_sets_are_compared_whole(make):
    rng = np.random.default_rng(9)
    base = [f"w{n}" for n in rng.integers(0, 10**6, 3000)]
    rows = []
    for n, changes in enumerate((0, 20, 40, 60, 90, 130, 300, 700)):
        changed = list(base)
        for k in rng.choice(3000, changes, replace=False):
            changed[k] = f"x{n}-{k}"
        rows.append((n, " ".join(changed)))
    rows.append((50, " ".join(base[:1700])))
    assert found(near_duplicates(make(rows))) == expected(rows)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(make(rows)).collect()) == sorted((r[0], r[2]) for r in expected(rows, 75))


def test_an_empty_table(make):
    assert near_duplicates(make([])).collect() == []
    assert found(near_duplicates(make([(1, None)]))) == [(1, 0, 1, True)]


def test_bins_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    for n, kept in ((400, 0.9), (12, 0.75), (7, 6 / 7)):
        same = total = 0
        for _ in range(60):
            a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
            b = np.sort(rng.choice(a, round(n * kept), replace=False))
            values = densified(bin_values(np.concatenate((a, b)), np.array([0, n, n + len(b)]), 128))
            same, total = same + int((values[0] == values[1]).sum()), total + 128
        assert abs(same / total - kept) < 0.05
    keys = band_keys(values, 4)
    assert keys.shape == (2, 32) and len(set(keys[0].tolist())) == 32
    assert (densified(bin_values(np.zeros(0, dtype=np.uint64), np.array([0, 0]), 128)) == np.uint64((1 << 64) - 1)).all()


@pytest.mark.parametrize("size", [1, 40, 900, 5000])
def test_signatures_and_marks_differ_in_no_more_bits_than_sets_in_elements(size):
    rng = np.random.default_rng(size)
    a = np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    b = np.sort(np.concatenate((a[size // 9:], rng.integers(0, 1 << 63, size // 12, dtype=np.uint64))))
    both, at = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
    differ = len(set(a.tolist()) ^ set(b.tolist()))
    for of in (signatures, marks):
        x, y = (np.array(v, dtype=np.int64).view(np.uint64) for v in of(both, at).to_pylist())
        while len(x) != len(y):
            x, y = (v[:len(v) // 2] ^ v[len(v) // 2:] if len(v) == max(len(x), len(y)) else v for v in (x, y))
        assert int(np.bitwise_count(x ^ y).sum()) <= differ


def test_rounds_give_few_candidates_and_lose_no_link(spark):
    """One list of points on a line; two link if they lie next to each other. Signatures rule
    nothing out, so rounds alone must find every link."""
    points = list(range(60)) + list(range(100, 140))
    lists = spark.createDataFrame([(k, p, 10) for k in range(2) for p in points], "key long, id long, n int")
    compared = []

    def verify(pairs):
        compared.append(pairs.count())
        return pairs.where("abs(a - b) = 1")

    def same(ids):
        return ids.selectExpr("id", "10 AS n", "array(0L, 0L) AS signature")

    for block in (4096, 16):
        labels = {r.node: r.label for r in settle(lists, same, verify, 75, block=block).collect()}
        assert labels == {p: 0 if p < 60 else 100 for p in points}
    assert max(compared) <= 100 * 99 // 2


def test_tasks_give_a_candidate_once_and_not_once_a_list(spark, monkeypatch):
    """200 lists, each of 30 of the same 40 sets, which are alike but do not link."""
    lists = spark.createDataFrame([(k, (k + p) % 40, 10) for k in range(200) for p in range(30)], "key long, id long, n int")
    made = []

    def counted(df, function, schema):
        out = map_arrow(df, function, schema)
        made.append(out.count())
        return out

    monkeypatch.setattr("opquality.llm.settle.map_arrow", counted)
    same = lambda ids: ids.selectExpr("id", "10 AS n", "array(0L, 0L) AS signature")
    for block in (4096, 16):
        assert settle(lists, same, lambda pairs: pairs.where("false"), 75, block=block).isEmpty()
    assert made and max(made) <= 16 * 40 * 39 // 2


def test_a_group_that_its_hub_does_not_tie_gives_few_candidates(spark):
    """All sets of a list link but with its hub; a round gives fewer candidates than sets,
    not every pair of them."""
    lists = spark.createDataFrame([(k, p, 10) for k in range(3) for p in range(300)], "key long, id long, n int")
    given = []

    def thin(pairs):
        given.append(pairs.count())
        return pairs

    same = lambda ids: ids.selectExpr("id", "10 AS n", "array(0L, 0L) AS signature")
    for block in (4096, 64):
        labels = {r.node: r.label for r in settle(lists, same, lambda pairs: pairs.where("b > 0"), 75, block=block, thin=thin).collect()}
        assert labels == {p: 1 for p in range(1, 300)}
    # Each of up to 25 squares of a list ties its own sets.
    assert sum(given) < 25 * 300
