import random

import pytest

from opquality.llm.suffix_dedup import remove_repeats


def expected(rows, length=100):
    seen, out = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if seen.setdefault(raw[p:p + length], (doc, p)) != (doc, p):
                gone[p:p + length] = b"\x01" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((doc, len(raw), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, len(r.runs), bytes(r.kept)) for r in df.collect()), key=str)


def odd():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé") for _ in range(500))
    return [
        (1, ""), (2, None), (3, "a" * 350), (4, base), (5, base[:99]), (6, base[50:149]), (7, base[50:150]), (8, "x" + base[10:300] + "y" + base[5:200]), (9, base),
        (10, "a" * 99), (11, "a" * 100), (12, "ab" * 300), (13, ("z" * 120 + base[100:230]) * 3), (None, base[200:420]),
        *((100 + n, base[:60] + "".join(rng.choice("fghi") for _ in range(80)) + base[60:90]) for n in range(30)),
    ]


@pytest.mark.parametrize("many", [(128, 4096), (2, 4096), (2, 2), (128, 2)])
def test_removed_bytes_equal_a_plain_search(make, prose, many):
    rows = odd() + [(1000 + i, t) for i, t in prose]
    out = remove_repeats(make(rows, "doc", "runs", "lo", "_spans").repartition(3), many=many[0], many_in_all=many[1])
    assert out.columns == ["doc_id", "text", "doc", "lo", "_spans", "n_bytes", "runs", "kept"]
    assert found(out) == expected(rows)


def test_repeated_rows_are_one_document(make):
    text = "".join(chr(97 + n * n % 26) + str(n) for n in range(100))
    out = remove_repeats(make([(5, text), (5, text), (9, text)])).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in out) == [(5, len(text)), (5, len(text)), (9, 0)]


def test_as_text_and_empty_tables(make):
    one, two = "x" * 3 + "q1w2e3r4t5" * 12 + "é", "q1w2e3r4t5" * 12 + "è"
    out = {r.doc_id: r.kept for r in remove_repeats(make([(1, one), (2, two), (3, None)]), as_text=True).collect()}
    assert out[3] == "" and out[1].endswith("é") and out[2] == ""
    assert remove_repeats(make([])).collect() == []


def test_no_id_and_the_least_id_are_two_documents(make):
    text = "".join(chr(97 + n * n % 26) + str(n) for n in range(100))
    out = remove_repeats(make([(-(2 ** 63), text), (None, text), (1, "x")])).collect()
    assert {r.doc_id: len(r.kept) for r in out} == {None: len(text), -(2 ** 63): 0, 1: 1}


def test_texts_of_several_slices(make):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(1_300_000))
    rows = [(1, "begin " + long), (2, long[700_000:700_400]), (3, long[1_200_000:] + " end"), (4, "z" * 99)]
    got = found(remove_repeats(make(rows)))
    assert [(d, n, k) for d, n, k, _ in got] == [(1, len(rows[0][1]), 0), (2, 400, 1), (3, len(rows[2][1]), 1), (4, 99, 0)]
    assert [kept for *_, kept in got] == [rows[0][1].encode(), b"", b" end", b"z" * 99]
