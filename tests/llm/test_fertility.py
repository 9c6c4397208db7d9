import math
from collections import Counter

import public_tokenizers as P
import tiktoken

from opquality.llm.bpe import load_ranks
from opquality.llm.fertility import BANDS, Band, kept_rows, quality

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
VOCABULARIES = {"multi": RANKS}


def split(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def plain(text):
    """All counts and the verdict, by loops over words and tokens of the public library."""
    text = text or ""
    w = split(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {k + d for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for d in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if split(line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    ranks = load_ranks(RANKS)
    ids = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={}).encode_ordinary(text)
    whole = sum(ranks.bytes[i].decode("utf-8", "ignore").encode() == ranks.bytes[i] for i in ids)
    share = [n / len(ids) for n in Counter(ids).values()]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(repeated), failed,
        (len(ids), len(text) / max(1, len(ids)), (len(ids) - whole) / max(1, len(ids)), -sum(s * math.log2(s) for s in share)),
    )


def rows(prose, odd_texts):
    clean = prose[0][1]
    return [*((100 + i, t) for i, t in prose), *((1000 + n, t) for n, t in enumerate(odd_texts[:60])), (1, None), (2, ""), (3, clean.upper() + " !!" * 9),
            (4, " ".join(["again and again"] * 40)), (5, "\n".join(["same line here"] * 30 + [clean])), (6, " ".join(chr(0x4E00 + n * 37 % 5000) for n in range(120))), (3, clean)]


def test_counts_and_measures_equal_plain_ones(make, prose, odd_texts):
    given = rows(prose, odd_texts)
    out = quality(make(given, "script", "kept", "lang").repartition(2), VOCABULARIES, P.PATTERN)
    assert out.columns[:3] == ["doc_id", "text", "lang"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    for doc, text in given:
        r, (n, chars, symbols, lines, repeated, failed, tokens) = got[doc, text], plain(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeated, failed)
        assert all(abs(a - b) < 1e-9 for a, b in zip(r.tokens["multi"], tokens))
        band = BANDS[r.script]
        inside = band.min_chars <= tokens[1] <= band.max_chars and tokens[2] <= band.max_fallback and tokens[3] >= band.min_entropy
        assert r.kept == (not failed and inside)


def test_bands_reject_by_script(make, prose):
    clean = prose[0][1]
    docs = make([(1, clean), (2, " ".join(chr(0x4E00 + n * 37 % 5000) for n in range(120)))])
    script = {r.doc_id: (r.script, r.kept) for r in quality(docs, VOCABULARIES, P.PATTERN).collect()}
    assert script == {1: ("latin", True), 2: ("cjk", True)}
    strict = {**BANDS, "latin": Band(100.0, 200.0, 1.0, 0.0)}
    assert {r.doc_id for r in quality(docs, VOCABULARIES, P.PATTERN, bands=strict).where("kept").collect()} == {2}


def test_kept_rows_keep_their_columns(make, prose, odd_texts):
    given = rows(prose, odd_texts)
    out = kept_rows(make(given, "kept", "n_words"), VOCABULARIES, P.PATTERN)
    assert out.columns == ["doc_id", "text", "kept", "n_words"] and {r.kept for r in out.collect()} == {"own"}
    # Short texts, repetition and repeated lines go, clean prose stays.
    assert {r.doc_id for r in out.collect() if r.doc_id >= 100} == {100 + i for i, t in prose}
    assert kept_rows(make([]), VOCABULARIES, P.PATTERN).collect() == []
