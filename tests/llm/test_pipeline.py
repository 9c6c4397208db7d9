import numpy as np
import public_tokenizers as P
import pyarrow as pa
import test_decontaminate
import test_fertility
import test_jaccard_join
import test_suffix_dedup
import tiktoken
from opquality.llm import suffix_dedup
from opquality.llm.bpe import load_ranks
from opquality.llm.fertility import BANDS
from opquality.llm.units import encode_texts

import corpus_pipeline


def by_hand(rows, items):
    """The stages by the plain forms of their tests."""
    kept = []
    for doc, text in rows:
        *_, failed, (_, chars, fallback, entropy) = test_fertility.plain(text)
        band = BANDS["latin"]
        if not failed and band.min_chars <= chars <= band.max_chars and fallback <= band.max_fallback and entropy >= band.min_entropy:
            kept.append((doc, text))
    least = {doc: c for doc, _, c in test_jaccard_join.expected(kept)}
    kept = [(doc, text) for doc, text in kept if least[doc] == doc]
    kept = [(doc, raw.decode("utf-8", "ignore")) for doc, _, _, raw in test_suffix_dedup.expected(kept)]
    kept = [(doc, text) for doc, text in kept if text]
    bad = {r[0] for r in test_decontaminate.expected(kept, items) if r[4]}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")).rank, special_tokens={})
    return sorted((doc, known.encode_ordinary(text)) for doc, text in kept if doc not in bad)


def test_stages_equal_plain_forms(spark, prose, tmp_path):
    rows = prose + [(900, None), (901, ""), (902, "too short"), (903, prose[3][1].upper()), (904, prose[4][1])]
    items = [(1, " ".join(prose[8][1].split()[:30])), (2, "not to be found anywhere at all")]
    full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == by_hand(rows, items) and 20 < len(got) < len(rows) - 10
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["_key", "_spans", "kept", "runs", "n_words", "spans", "contaminated", "_k"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_missing_and_repeated_ids_and_clashing_columns(spark, prose, tmp_path):
    items = [(1, " ".join(prose[8][1].split()[:30]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = sorted({t for _, t in prose})[:12]
    ids = [None, None, 5, 5, 5, -(2 ** 63), *range(10, 10 + len(texts) - 6)]
    rows = [(i, t, "en", "src", len(t), *(f"{c} {k}" for c in CLASHING)) for k, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, DOCUMENTS + "".join(f", `{c}` string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {tuple(r[c] for c in CLASHING): r for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        kept = out.collect()
        assert 0 < len(kept) <= len(before)
        for r in kept:
            was = before[tuple(r[c] for c in CLASHING)]
            assert (r.doc_id, r.lang, r.source) == (was.doc_id, was.lang, was.source) and r.n_chars == len(r.text)
            assert r.text == was.text or name == "suffix_dedup"


def test_a_worker_holds_the_words_and_samples_of_a_small_part_of_a_batch(monkeypatch):
    texts = pa.array([" ".join(f"{n}x{k}" for k in range(25_000)) for n in range(40)])
    words, scanned, tasks = [], [], []

    def encode(pieces):
        words.append(sum(map(len, pieces)))
        data = b"".join(p.encode() for p in pieces)
        return np.frombuffer(data, dtype=np.uint8).astype(np.int64), np.cumsum([0, *map(len, pieces)])

    assert sum(len(ids) for _, _, ids, _ in encode_texts(texts, encode, np.ones(256, dtype=np.int64))) == sum(map(len, texts.to_pylist()))
    assert max(words) < 4 << 20
    monkeypatch.setattr(suffix_dedup, "map_arrow", lambda docs, function, ddl: tasks.append(function))
    monkeypatch.setattr(suffix_dedup, "per_bucket", lambda *_: None)
    whole = suffix_dedup.samples
    monkeypatch.setattr(suffix_dedup, "samples", lambda data, *rest: scanned.append(len(data)) or whole(data, *rest))
    suffix_dedup._rank_samples(None, 64, 100, 24, 128, 4096)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([0] * 40), texts], names=["doc", "version", "text"])
    assert list(tasks[0](iter([batch])))
    assert max(scanned) < 1 << 19
