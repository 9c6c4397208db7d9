"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a linear classifier over hashed byte n-grams
tells the languages with that bit from the others. A text goes to the codeword of least
loss, each bit weighted by how well its classifier does on that language. Texts whose
two nearest codewords lie close together are flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opquality.llm.common import map_arrow
from opquality.llm.wordhash import LOWER, raw_bytes

BITS = 12
SIZE = 1 << BITS
MAX_TEXTS = 4000
MAX_EXHAUSTIVE = 7
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
# Bytes that are no letters count as one space.
PLAIN = np.where((LOWER >= 0x61) & (LOWER <= 0x7A) | (LOWER >= 0x80), LOWER, 0x20).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # n-gram buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits


def ngram_shares(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams of a text's bytes."""
    b = PLAIN[data]
    counts = np.zeros(SIZE)
    grams = b
    for n in range(1, 4):
        if len(b) < n:
            break
        if n > 1:
            grams = grams[:-1] * 257 + b[n - 1:]
        counts += np.bincount((((grams + n) * 0x9E3779B1) >> 11) & (SIZE - 1), minlength=SIZE)
    counts[_SPACES] = 0
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


# Single and repeated spaces say nothing of a language.
_SPACES = [((0x20 + 1) * 0x9E3779B1 >> 11) & (SIZE - 1), ((0x20 * 257 + 0x20 + 2) * 0x9E3779B1 >> 11) & (SIZE - 1)]


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """All ways to part few languages in two; for many, the random code of those tried
    whose codewords are farthest apart."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= MAX_EXHAUSTIVE:
        parts = np.arange(2 ** (languages - 1) - 1)
        rest = (parts[None, :] >> np.arange(languages - 1)[:, None]) & 1
        return np.concatenate((np.ones((1, len(parts))), 2.0 * rest - 1))
    rng, bits, best = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages))), None
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        same = code @ code.T - 2 * bits * np.eye(languages)
        across = np.abs(code.T @ code) - 2 * languages * np.eye(bits)
        if abs(code.sum(axis=0)).max() < languages and across.max() < languages:
            if best is None or same.max() < best[0]:
                best = (same.max(), code)
    return best[1] if best else code


def train(features: np.ndarray, labels: list[str], steps: int = 300, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Logistic classifiers for all bits at once, by Adam over the whole sample."""
    languages = sorted(set(labels))
    index = {name: n for n, name in enumerate(languages)}
    y = np.array([index[name] for name in labels], dtype=np.int64)
    code = codewords(len(languages))
    x = features.astype(np.float32)
    target = code[y].astype(np.float32)
    # Each language weighs the same, however many texts it has.
    weight = (1 / np.bincount(y, minlength=len(languages))[y] / max(1, len(languages))).astype(np.float32)[:, None]
    w, b = np.zeros((SIZE, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    mw, sw, mb, sb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        z = x @ w + b
        g = -target / (1 + np.exp(np.clip(z * target, -30, 30))) * weight
        gw, gb = x.T @ g + decay * w, g.sum(axis=0)
        mw, sw = 0.9 * mw + 0.1 * gw, 0.999 * sw + 0.001 * gw * gw
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        up, down = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= rate * (mw / up) / (np.sqrt(sw / down) + 1e-8)
        b -= rate * (mb / up) / (np.sqrt(sb / down) + 1e-8)
    right = (x @ w + b) * target > 0
    trust = np.array([right[y == n].mean(axis=0) for n in range(len(languages))]).reshape(len(languages), -1)
    trust = np.where(trust.sum(axis=1, keepdims=True) > 0, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9), 1 / code.shape[1])
    return Model(languages, code, w, b, trust)


def decode(model: Model, features: np.ndarray, margin: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, of each row of features."""
    z = features @ model.weights + model.bias
    loss = np.stack([(np.logaddexp(0, -z * c) * t).sum(axis=1) for c, t in zip(model.code, model.trust)], axis=1)
    weight = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    share = np.sort(weight / weight.sum(axis=1, keepdims=True), axis=1)
    second = share[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
    return [model.languages[n] for n in loss.argmin(axis=1)], share[:, -1], share[:, -1] - second < margin


def _features(texts: pa.StringArray) -> Iterator[np.ndarray]:
    for n in range(len(texts)):
        yield ngram_shares(raw_bytes(texts.slice(n, 1))[0])


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_texts: int = MAX_TEXTS) -> Model | None:
    """Learns from the rows of docs that have a language and a text, max_texts of them:
    the same number for each language, those of the least hashes of id and text; rows that
    have both in common count once. None if there are no such rows."""
    usable = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h")
    )
    different = usable.select("lang", "h").distinct()
    counts = {r.lang: r["count"] for r in different.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, max_texts // len(counts))
    # A first cut by hash leaves about twice the wanted rows of each language.
    near = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, (2 * each + 50) / n)
        near = near | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))))
    ranked = different.where(near).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = ranked.where(F.col("n") <= each).select("lang", "h")
    sample = usable.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [f.astype("<f2").tobytes() for f in _features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["lang", "features"])

    rows = sorted(map_arrow(sample, tasks, "lang string, features binary").collect(), key=lambda r: (r.lang, bytes(r.features)))
    return train(np.array([np.frombuffer(r.features, dtype="<f2") for r in rows], dtype=np.float32), [r.lang for r in rows])


def identify(df: DataFrame, model: Model | None, text_col: str = "text", margin: float = 0.1) -> DataFrame:
    """Every row of df with all its columns, and

    lang_pred   the language of the whole text; und if it is null or has no letter, or
                if nothing was learned
    lang_score  0 to 1, the weight of the nearest codeword among all
    ambiguous   the second codeword is less than margin behind, or there is no language

    Columns of df named like a new one are replaced.
    """
    new = ["lang_pred", "lang_score", "ambiguous"]
    rows = df.drop(*new)
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = rows.columns
    at_column = columns.index(text_col)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(at_column)
                lettered = np.array([known is not None and t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], dtype=bool)
                names, scores, unsure = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, dtype=bool)
                where = np.flatnonzero(lettered)
                if len(where):
                    found, scores[where], unsure[where] = decode(known, np.stack([*_features(texts.take(pa.array(where)))]).astype(np.float32), margin)
                    for n, name in zip(where, found):
                        names[n] = name
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(unsure)], names=[*columns, *new])

    return map_arrow(rows, tasks, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("lang_pred string, lang_score double, ambiguous boolean").fields]))
