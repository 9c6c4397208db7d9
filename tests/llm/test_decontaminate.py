import re

import numpy as np
import pyarrow as pa
from opquality.llm import decontaminate
from opquality.llm.decontaminate import scan, without_contaminated, without_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(rows, items):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add("" if name is None else str(name))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(make, prose):
    body = [t for _, t in prose]
    items = [(1, " ".join(body[0].split()[:20])), (2, " ".join(body[0].split()[5:40]).upper()), (10, "short item"), (11, "Short, ITEM!"), (3, None), (4, "?!"), (None, " ".join(body[7].split()[:15]))]
    rows = prose + [
        (500, "Before. " + items[0][1] + " after"), (501, "a short  item and a SHORT-item"), (502, None), (503, ""), (504, "- . -"),
        (505, ("filler " * 400) + "short item"), (505, ("filler " * 400) + "short item"), (None, items[1][1]),
    ]
    return rows, items


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=str)


def test_hits_equal_a_plain_search(spark, make, prose):
    rows, items = case(make, prose)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make(rows, "n_words", "spans", "source")
    assert found(scan(docs, benchmark)) == expected(rows, items)
    # The same in several blocks, one scan after the other.
    assert found(scan(docs, benchmark, block_bytes=60)) == expected(rows, items)


def test_documents_and_spans_go(spark, make, prose):
    rows, items = case(make, prose)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    bad = [r[0] for r in expected(rows, items) if r[4]]
    kept = without_contaminated(make(rows, "n_words"), benchmark)
    assert kept.columns == ["doc_id", "text", "n_words"] and {r.n_words for r in kept.collect()} == {"own"}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in bad), key=str)
    cut_out = {r.doc_id: r.text for r in without_spans(make(rows, "n_hit"), benchmark).collect()}
    assert cut_out[500] == "Before.  after" and cut_out[501] == "a  and a " and cut_out[502] is None


def test_repeated_items_make_no_larger_block(spark, make, prose, monkeypatch):
    rows, items = case(make, prose)
    benchmark = spark.createDataFrame(items + items[:1] * 40 + [(100 + n, f"word{n} item") for n in range(30)], "item_id long, text string")
    taken, build = [], decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda names, texts, window: taken.append(list(zip(names, texts))) or build(names, texts, window))
    assert found(scan(make(rows), benchmark, block_bytes=300)) == expected(rows, items)
    assert len(taken) > 2 and all(sum(len(t.encode()) for _, t in block) <= 300 or len(block) == 1 for block in taken)
    every = [i for block in taken for i in block]
    assert len(every) == len(set(every)) == len({i for i in items if i[1]}) + 30


def test_empty_tables(spark, make, prose):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in scan(make(prose[:5]), nothing).collect()} == {0}
    assert scan(make([]), nothing).collect() == []


def test_windows_with_equal_hashes_are_told_apart(make, prose, monkeypatch):
    rows, items = case(make, prose)
    right = decontaminate.window_hashes
    monkeypatch.setattr(decontaminate, "window_hashes", lambda words, n: right(words, n) % np.uint64(5))
    index = decontaminate.build_index([str(n) for n, _ in items], [t for _, t in items], 13)
    for w in index.windows:
        texts = [index.normal[a:b] for a, b in zip(w.starts, w.ends)]
        assert len(texts) == len(set(texts)) and all(t.count(b" ") == w.words - 1 for t in texts)
        assert all(len(set(x)) == len(x) > 0 for x in (w.items[a:b].tolist() for a, b in zip(w.item_at[:-1], w.item_at[1:])))
    data, text_at = decontaminate.raw_bytes(pa.array([t for _, t in rows], pa.string()))
    found_words, hit, pairs = decontaminate.scan_block(data, text_at, index)
    plain = expected([(n, t) for n, (_, t) in enumerate(rows)], [(str(n), t) for n, t in items])
    total = np.concatenate(([0], np.cumsum(hit)))
    got = [(n, int(total[found_words.at[n + 1]] - total[found_words.at[n]]), sorted(index.names[i] for d, i in pairs if d == n)) for n in range(len(rows))]
    assert sorted(got, key=str) == sorted(((d, n_hit, names) for d, _, n_hit, names, _ in plain), key=str)


def test_empty_benchmark_and_long_texts(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(scan(make([(1, "a b"), (2, None)]), none)) == [(1, 2, 0, [], False), (2, 0, 0, [], False)]
    assert scan(make([]), none).collect() == []
    items = [(1, " ".join(f"w{n}" for n in range(13)))]
    rows = [(1, "filler " * 700_000 + items[0][1]), (2, items[0][1] + " end")]
    assert found(scan(make(rows), spark.createDataFrame(items, "item_id long, text string"))) == expected(rows, items)
