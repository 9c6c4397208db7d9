"""Quality rules on word counts and on how a public vocabulary breaks a text up.

Clean prose of a script comes apart into tokens of a usual length. Shouting, symbols and
noise need more tokens for the same characters, text of a foreign encoding falls back to
single bytes, and boilerplate repeats a few tokens. So each script has a band of
characters per token, a largest share of byte tokens and a least entropy of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.llm.bpe import encoder, load_ranks
from opquality.llm.common import map_arrow, vocabulary_cache
from opquality.llm.units import blocks, bounds, encode_texts
from opquality.llm.wordhash import find_words, mix, range_hashes, raw_bytes, text_of_word, window_hashes

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SCAN_BYTES = 2 << 20


@dataclass(frozen=True)
class Band:
    """What a kept text may show: characters per token, share of tokens that are not
    whole characters, entropy of its tokens in bits."""

    min_chars: float
    max_chars: float
    max_fallback: float
    min_entropy: float


# Bands for byte-level vocabularies of about 50,000 tokens; an alphabet that the
# vocabulary hardly knows has few characters per token and many byte tokens.
BANDS = {
    "latin": Band(2.0, 10.0, 0.10, 4.0),
    "greek": Band(0.6, 10.0, 0.60, 3.5),
    "cyrillic": Band(0.8, 10.0, 0.50, 4.0),
    "hebrew": Band(0.5, 10.0, 0.60, 3.5),
    "arabic": Band(0.5, 10.0, 0.60, 3.5),
    "indic": Band(0.25, 10.0, 0.95, 2.5),
    "cjk": Band(0.3, 6.0, 0.95, 3.0),
    "hangul": Band(0.3, 6.0, 0.95, 3.0),
    "none": Band(0.2, 10.0, 0.95, 2.5),
}
SCRIPTS = [*BANDS][:-1]

# The script that a byte of UTF-8 begins a letter of (0: latin), 255 for all others.
LEAD = np.full(256, 255, dtype=np.uint8)
LEAD[0x41:0x5B] = LEAD[0x61:0x7B] = LEAD[0xC3:0xCA] = 0
for _script, _first, _last in (("greek", 0xCE, 0xCF), ("cyrillic", 0xD0, 0xD3), ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDB), ("indic", 0xE0, 0xE0), ("cjk", 0xE3, 0xE9), ("hangul", 0xEA, 0xED)):
    LEAD[_first:_last + 1] = SCRIPTS.index(_script)

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[0x20] = IS_WORD[0x09:0x0E] = False
IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
IS_CHARACTER = np.arange(256) & 0xC0 != 0x80

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["n_tokens", "chars_per_token", "fallback_share", "token_entropy"]


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = bounds(flags)
    return total[at[1:]] - total[at[:-1]]


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def count_words(data: np.ndarray, text_at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that only look at words, per text, and its main script."""
    words = find_words(data, text_at, IS_WORD)
    text_of = text_of_word(words.at)
    window = window_hashes(range_hashes(data, words.starts, words.ends), 3)
    first = np.flatnonzero(text_of[:len(window)] == text_of[2:2 + len(window)])
    # A window is looked for in its own text only.
    own = mix(window[first] + text_of[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, code, often = np.unique(own, return_inverse=True, return_counts=True)
    again = first[often[code] > 1]
    change = np.zeros(len(text_of) + 1, dtype=np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + 3, -1)
    script = LEAD[data]
    letters = np.zeros((len(text_at) - 1, len(SCRIPTS)), dtype=np.int64)
    letters[:, 0] = _sums(script == 0, text_at)
    others = np.flatnonzero((script > 0) & (script < 255))
    where = np.searchsorted(text_at, others, side="right") - 1
    np.add.at(letters, (where, script[others]), 1)
    return {
        "n_words": np.diff(words.at),
        "word_chars": _sums(IS_WORD[data] & IS_CHARACTER[data], text_at),
        "n_symbols": _sums(IS_SYMBOL[data], text_at),
        "n_repeat_words": _sums(np.cumsum(change[:-1]) > 0, words.at),
        "script": np.where(letters.any(axis=1), letters.argmax(axis=1), len(SCRIPTS)),
        "chars": _sums(IS_CHARACTER[data], text_at),
    }


@vocabulary_cache
def _fallback(vocabulary: str) -> np.ndarray:
    """Which ids are not whole characters."""
    flags = []
    for token in load_ranks(vocabulary).bytes:
        try:
            token.decode()
            flags.append(False)
        except UnicodeDecodeError:
            flags.append(True)
    return np.array(flags)


def token_measures(ids: np.ndarray, at: np.ndarray, fallback: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of tokens that are not whole characters, and entropy of the tokens in bits."""
    n = np.diff(at)
    text_of = np.repeat(np.arange(len(n)), n)
    pair, often = np.unique(text_of * np.int64(len(fallback)) + ids, return_counts=True)
    owner = pair // len(fallback)
    share = often / n[owner]
    entropy = np.bincount(owner, -share * np.log2(share), minlength=len(n))
    return _sums(fallback[ids], at) / np.maximum(n, 1), entropy


def quality(
    df: DataFrame, vocabularies: dict[str, str], pattern: str, bands: dict[str, Band] = BANDS, text_col: str = "text",
    min_words: int = MIN_WORDS, max_repeated_percent: int = MAX_REPEATED_PERCENT,
) -> DataFrame:
    """Every row of df with all its columns, and

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words   counts over the whole text
    script           that of most letters (none without letters)
    tokens           per vocabulary (its name): n_tokens, chars_per_token, fallback_share,
                     token_entropy
    base_failed      too few words, or too many of them in repeated three-word windows
    kept             not base_failed, and inside its script's band for every vocabulary

    A null or empty text has no words and fails. Columns of df named like a new one are
    replaced; rows are judged one by one, repeated ones too. vocabularies: names and files
    of byte-level ranks that executors can open; pattern: their pre-tokenisation.
    """
    new = {*COUNTS, "script", "tokens", "base_failed", "kept"}
    columns = [c for c in df.columns if c not in new]
    kept = df.select(columns)
    at_column = columns.index(text_col)
    added = T.StructType.fromDDL(
        ", ".join(f"{c} long" for c in COUNTS) + ", script string, tokens map<string,struct<n_tokens:long,chars_per_token:double,fallback_share:double,token_entropy:double>>, base_failed boolean, kept boolean"
    ).fields
    measures = pa.struct([("n_tokens", pa.int64()), *((m, pa.float64()) for m in MEASURES[1:])])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at_column), "")
            found = {c: [] for c in [*COUNTS, "script", "chars"]}
            for lo, hi in blocks(pc.binary_length(texts).to_numpy(), SCAN_BYTES):
                for name, values in count_words(*raw_bytes(texts.slice(lo, hi - lo))).items():
                    found[name].append(values)
                found["n_dup_lines"].append(np.array([repeated_lines(t) for t in texts.slice(lo, hi - lo).to_pylist()], dtype=np.int64))
            c = {name: np.concatenate(values) if values else np.zeros(0, dtype=np.int64) for name, values in found.items()}
            base_failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeated_percent * c["n_words"])
            names = [*BANDS]
            script = np.array(names)[c["script"]] if len(texts) else np.zeros(0, dtype=str)
            limits = np.array([[getattr(bands.get(s, BANDS["none"]), f) for f in ("min_chars", "max_chars", "max_fallback", "min_entropy")] for s in names])[c["script"]]
            good = ~base_failed
            per_vocabulary = []
            for vocabulary in vocabularies.values():
                ranks = load_ranks(vocabulary)
                fallback = _fallback(vocabulary)
                n, share, entropy = [], [], []
                for _, _, ids, at in encode_texts(texts, encoder(ranks, pattern), ranks.lengths, ranks.cache):
                    f, e = token_measures(ids, at, fallback)
                    n.append(np.diff(at)), share.append(f), entropy.append(e)
                n, share, entropy = (np.concatenate(x) if x else np.zeros(0) for x in (n, share, entropy))
                chars = c["chars"] / np.maximum(n, 1)
                good &= (limits[:, 0] <= chars) & (chars <= limits[:, 1]) & (share <= limits[:, 2]) & (limits[:, 3] <= entropy)
                per_vocabulary.append(pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(chars), pa.array(share), pa.array(entropy)], fields=list(measures)))
            # One map per row, its entries in the order of the vocabularies.
            k, rows = len(per_vocabulary), len(texts)
            order = np.arange(k * rows).reshape(k, rows).T.reshape(-1)
            values = pa.concat_arrays(per_vocabulary).take(pa.array(order))
            tokens = pa.MapArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * k), pa.array([*vocabularies] * rows, pa.string()), values)
            out = [pa.array(c[name].astype(np.int64)) for name in COUNTS] + [pa.array(script.tolist(), pa.string()), tokens, pa.array(base_failed), pa.array(good)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*columns, *(f.name for f in added)])

    return map_arrow(kept, tasks, T.StructType([kept.schema[c] for c in columns] + added), vocabularies=True)


def kept_rows(df: DataFrame, vocabularies: dict[str, str], pattern: str, **options) -> DataFrame:
    """Rows of df that pass, with the columns they came with."""
    names = {c: f"_own_{n}" for n, c in enumerate(df.columns) if c != options.get("text_col", "text")}
    judged = quality(df.withColumnsRenamed(names), vocabularies, pattern, **options)
    return judged.where("kept").select([F.col(names.get(c, c)).alias(c) for c in df.columns])
