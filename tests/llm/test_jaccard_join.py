import numpy as np
import pytest
from plain_words import words

from opquality.llm.components import components, least_labels
from opquality.llm.jaccard_join import _shared_lists, boundary, jaccard_components, one_per_component, prefix
from opquality.llm.settle import forest


def expected(rows):
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
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    first = {}
    for n, (doc, _) in enumerate(rows):
        if doc is not None:
            first[top(n)] = min(doc, first.get(top(n), doc))
    return sorted(((doc, len(sets[n]), first.get(top(n)) if sets[n] else doc) for n, (doc, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def cases(prose):
    short = "one two three four five six seven eight nine ten"
    chain = short.split() + ["eleven", "twelve"]
    return [(n + 100, t) for n, t in prose] + [
        (1, None), (2, ""), (3, " \n"), (4, "Just Three Words"), (5, "just three\twords"), (6, "just three"), (7, short), (8, short + " eleven"),
        (9, " ".join(chain)), (10, " ".join(chain + ["13"])), (11, short.upper()), (12, "a b c d e"), (13, "a b c d e f"), (9000, short), (9000, short), (None, short),
    ]


@pytest.mark.parametrize("edge", [None, 1, 60, 10_000])
def test_components_equal_a_plain_search(make, prose, edge):
    rows = cases(prose)
    assert found(jaccard_components(make(rows, "n", "id", "label").repartition(3), edge=edge)) == expected(rows)


def test_a_large_group_of_near_copies_is_one(make):
    base = [f"w{n}" for n in range(120)]
    rows = [(n, " ".join(base[:n % 100] + [f"x{n}"] + base[n % 100:])) for n in range(150)]
    assert found(jaccard_components(make(rows))) == expected(rows)


def test_one_row_of_each_group_stays(make, prose):
    rows = cases(prose)
    kept = one_per_component(make(rows, "component_id", "n"))
    assert kept.columns == ["doc_id", "text", "component_id", "n"]
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for d, _, c in expected(rows) if c is not None})


def kept(df):
    return sorted(((r.doc_id, r.text) for r in one_per_component(df).collect()), key=str)


def test_rows_that_share_an_id_are_rows_of_their_own(make, prose):
    a, b, c = (prose[n][1] for n in (0, 1, 2))
    near = a + " and more"
    # (5, near) goes with (3, a), (5, b) is linked to nothing; (7, c) and (7, near c) are one.
    got = kept(make([(3, a), (5, near), (5, b), (7, c), (7, c + " and more"), (8, ""), (8, None), (9, None)]))
    assert [r for r in got if r[0] != 7] == sorted([(3, a), (5, b), (8, ""), (8, None), (9, None)], key=str)
    assert [r[1] in (c, c + " and more") for r in got if r[0] == 7] == [True]


def test_rows_without_an_id_go_before_all_others(make, prose):
    a, b = prose[0][1], prose[1][1]
    near = a + " and more"
    assert kept(make([(None, a), (7, a), (None, near), (9, near), (None, None), (None, "")])) == sorted([(7, a), (None, None), (None, "")], key=str)
    # Of rows without an id one stays, and the largest id is an id like any other.
    assert [r[0] for r in kept(make([(None, a), (None, near)]))] == [None]
    assert kept(make([((1 << 63) - 1, a), (None, near), (4, b)])) == sorted([((1 << 63) - 1, a), (4, b)], key=str)
    assert kept(make([((1 << 63) - 1, a), (4, near)])) == [(4, near)]


def test_empty_table(make):
    assert jaccard_components(make([])).collect() == []


def test_prefixes_hold_common_shingles():
    assert [int(prefix(np.int64(n), 75, 1)) for n in (1, 4, 8, 100)] == [1, 2, 3, 26]
    assert [int(prefix(np.int64(n), 75, 2)) for n in (1, 4, 8, 100)] == [1, 3, 4, 27]
    # Reading long lists costs more than listing pairs, so more sets are small.
    sizes = {n: 10 for n in range(2, 200)}
    assert boundary(sizes, 0.0, 75) <= boundary(sizes, 5.0, 75) <= boundary(sizes, 500.0, 75)


def test_components_of_paths_and_stars(spark):
    links = [(n, n + 1) for n in range(50)] + [(100, n) for n in range(101, 130)] + [(7, 7), (300, 301), (301, 300)]
    out = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{n: 0 for n in range(51)}, **{n: 100 for n in range(100, 130)}, 300: 300, 301: 300}


def test_keys_of_the_same_sets_are_one_list(spark):
    """Sets 5 and 6 share 300 keys, 5, 6 and 7 one more: two lists, whatever the buckets."""
    rows = []
    for bucket in range(3):
        key = np.arange(bucket * 100, bucket * 100 + 100)
        entries = [(k, s) for k in key.tolist() for s in (5, 6)] + [(1000, s) for s in (5, 6, 7) if bucket == 1] + [(2000 + bucket, 8)]
        keys, sets = (np.array(x, dtype=np.int64) for x in zip(*entries))
        rows.append((bucket, bytearray(keys.tobytes()), bytearray(sets.tobytes()), bytearray((sets * 10).astype(np.int32).tobytes())))
    lists = _shared_lists(spark.createDataFrame(rows, "bucket int, keys binary, sets binary, sizes binary")).collect()
    by_list = {}
    for r in lists:
        by_list.setdefault(r.key, []).append((r.id, r.n, r.times))
    assert sorted(sorted(x) for x in by_list.values()) == [[(5, 50, 1), (6, 60, 1), (7, 70, 1)], [(5, 50, 300), (6, 60, 300)]]


def test_a_forest_ties_what_all_links_tie():
    rng = np.random.default_rng(2)
    for nodes, links in ((2, 1), (40, 30), (40, 400), (300, 20_000)):
        a, b = rng.integers(0, nodes, (2, links)) * 7 - 3
        kept = forest(a, b)
        two = a != b
        every, of_all = least_labels(a[two], b[two])
        some, of_kept = least_labels(a[kept], b[kept])
        assert np.array_equal(every, some) and np.array_equal(of_all, of_kept)
        assert len(kept) == len(every) - len(np.unique(of_all))
    assert forest(np.array([1, 1, 2]), np.array([2, 3, 3])).tolist() == [0, 1]
