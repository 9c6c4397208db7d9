import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opquality.llm import bpe, token_files, units

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = P.path("byte_bpe_50k.json")


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS).rank, special_tokens={})


def test_ids_are_those_of_the_library(odd_texts):
    ranks, known = bpe.load_ranks(RANKS), reference()
    found = []
    for cache in (None, units.Cache(), units.Cache(3)):
        found.append([])
        for _ in range(2):
            for lo, hi, ids, at in units.encode_texts(pa.array(odd_texts), bpe.encoder(ranks, P.PATTERN), ranks.lengths, cache):
                found[-1] += [ids[at[k]:at[k + 1]].tolist() for k in range(hi - lo)]
    expected = [known.encode_ordinary(t) for t in odd_texts] * 2
    assert found == [expected] * 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=9), min_size=20, max_size=40))
def test_side_by_side_merges_equal_single_ones(pieces):
    ranks = bpe.load_ranks(RANKS)
    ids, counts = bpe.merge_many(pieces, ranks, 8)
    at = units.bounds(counts)
    assert [ids[at[k]:at[k + 1]].tolist() for k in range(len(pieces))] == [bpe.merge_one(p, ranks) for p in pieces]


def test_round_trip_of_rows(make, odd_texts):
    rows = [(n, t) for n, t in enumerate(odd_texts[:60])] + [(7, "twice"), (7, "twice"), (None, None), (900, "x" * 200_000 + " y")]
    out = bpe.bpe_roundtrip(make(rows, "ids", "decoded", "id"), RANKS, P.PATTERN).collect()
    known = reference()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.ids, bytes(r.decoded)) for r in out)
    assert got == sorted((-1 if i is None else i, known.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert bpe.bpe_roundtrip(make([]), RANKS, P.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=70))
def test_values_come_back(values):
    control, data = token_files.pack(np.array(values, dtype=np.uint32))
    assert len(control) == -(-len(values) // 4)
    got = token_files.unpack(np.frombuffer(control, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8), len(values))
    assert got.tolist() == values


def test_frequent_ids_take_a_byte():
    ids = np.array([40000] * 50 + [7] * 20 + list(range(100, 500)), dtype=np.uint32)
    raw = token_files.file_bytes([3, 4], [70, 400], ids)
    docs, counts, back = token_files.parse_file(raw)
    assert (docs.tolist(), counts.tolist(), back.tolist()) == ([3, 4], [70, 400], ids.tolist())
    by_rank = np.frombuffer(raw, dtype="<u4", count=2, offset=8 + 12 + 2 * 8 + 2 * 4)
    assert by_rank.tolist() == [40000, 7]


def test_files_hold_all_documents_in_order(make, odd_texts):
    rows = [(3 * n - 50, t) for n, t in enumerate(odd_texts[:80])] + [(None, None), (4000, "z " * 30_000), (4000, "z " * 30_000)]
    files = token_files.write_token_files(make(rows, "start", "ids", "path").repartition(5), TOKENIZER, end_id=2)
    found = sorted(((r.start, r.doc_id, bytes(r.ids)) for r in token_files.read_token_files(files).collect()), key=lambda r: r[0])
    tokenizer, start, expected = Tokenizer.from_file(TOKENIZER), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((start, i, zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [(s, i, zlib.crc32(b)) for s, i, b in found] == expected


def test_no_documents_no_files(make):
    files = token_files.write_token_files(make([]), TOKENIZER, end_id=2)
    assert files.count() == 0 and token_files.read_token_files(files).collect() == []
