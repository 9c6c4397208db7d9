"""Token ids in binary files: ids ranked by frequency, in byte-aligned variable length.

File, all numbers little-endian: the magic, then docs, values and ranked ids as uint32;
doc ids (int64) and token counts (uint32) of the documents; the ids by falling
frequency in this file (uint32); control bytes; data bytes. Two bits of a control byte
give the length of a value, 1 to 4 bytes, so a control byte serves four values and is
decoded by one look into a table. A file holds whole documents in ascending id order
and needs no other file to be read.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opquality.llm.common import cut, map_arrow, new_folder, vocabulary_cache
from opquality.llm.units import Cache, Encoded, bounds, encode_texts

MAGIC = b"OQTOK1\0\0"
NO_ID = -(1 << 63)
VALUES_A_FILE = 4 << 20
CONTROLS_A_STEP = 1 << 16
TEXTS_A_CALL = 8
# The library encodes a word at more cost, so each is encoded once in more bytes of text.
SHARED_BYTES = 16 << 20

# For each control byte: the bytes of its four values, and for each of the sixteen
# bytes of four decoded values its place in the data and whether it is there.
_LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
_GROUP = _LENGTHS.sum(axis=1)
_THERE = (np.arange(4) < _LENGTHS[:, :, None]).reshape(256, 16)
_PLACE = np.where(_THERE, np.cumsum(_THERE, axis=1) - 1, 0)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of uint32 values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[:len(values)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    """The values again. The last control byte may cover fewer than four."""
    out = np.empty(len(control) * 4, dtype="<u4")
    at = 0
    data = np.concatenate((data, np.zeros(16, dtype=np.uint8)))
    for lo in range(0, len(control), CONTROLS_A_STEP):
        c = control[lo:lo + CONTROLS_A_STEP]
        ends = at + np.cumsum(_GROUP[c])
        picked = data[((ends - _GROUP[c])[:, None] + _PLACE[c])] * _THERE[c]
        out[lo * 4:(lo + len(c)) * 4] = picked.astype(np.uint8).view("<u4").reshape(-1)
        at = int(ends[-1])
    return out[:count]


def file_bytes(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    often = np.bincount(ids)
    distinct = np.flatnonzero(often)
    order = np.lexsort((distinct, -often[distinct]))
    rank = np.empty(len(often), dtype=np.uint32)
    rank[distinct[order]] = np.arange(len(order))
    control, data = pack(rank[ids])
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(ids), len(order)], dtype="<u4").tobytes(),
        np.array(doc_ids, dtype="<i8").tobytes(), np.array(counts, dtype="<u4").tobytes(),
        distinct[order].astype("<u4").tobytes(), control, data,
    ])


def parse_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, token counts and all ids of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    at = 8

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, dtype=kind, count=n, offset=at)
        at += found.nbytes
        return found

    docs, values, ranked = map(int, take("<u4", 3))
    doc_ids, counts, by_rank = take("<i8", docs), take("<u4", docs), take("<u4", ranked)
    control = take("u1", -(-values // 4))
    return doc_ids, counts, by_rank[unpack(control, np.frombuffer(raw, dtype=np.uint8, offset=at), values)]


class Tokens:
    """A tokenizer file as a function from texts to ids, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = Cache()
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # In byte-level vocabularies each character of a token stands for one byte.
        self.lengths = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i] = len(added[i].encode()) if i in added else len(token)

    def encode(self, texts: list[str]) -> Encoded:
        # The library's own records of a token are large, so few texts at a time.
        found = []
        for n in range(0, len(texts), TEXTS_A_CALL):
            found += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts[n:n + TEXTS_A_CALL], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype=np.uint32), *found]), bounds([len(x) for x in found])


@vocabulary_cache
def load_tokens(path: str) -> Tokens:
    return Tokens(path)


def write_token_files(
    df: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Encodes every whole text, appends end_id and writes files in ascending id order
    below folder (a URL that driver and executors share; new if not given).

    Returns one row per file: path, part, number (their order is the order of the files),
    docs, tokens. Only files in that list count: a task that is run again writes new ones.
    A null text counts as empty and gives end_id alone; a null id is written as -2^63 and
    sorts first; rows with equal ids stand in the order of their texts. Other columns are
    left out. A file ends after 4 Mi ids, so that one batch of documents is held at a time.
    """
    spark = df.sparkSession
    folder = folder or new_folder(spark, "tokens")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load_tokens(tokenizer)
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        doc_ids, counts, held, number = [], [], [], 0

        def written() -> pa.RecordBatch:
            nonlocal number
            name = f"part-{part:06d}-{number:06d}-{uuid4().hex}.oqtok"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(doc_ids, counts, np.concatenate(held)))
            row = {"path": f"{folder}/{name}", "part": part, "number": number, "docs": len(doc_ids), "tokens": sum(counts)}
            number += 1
            doc_ids.clear(), counts.clear(), held.clear()
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", "string"), ("part", "int32"), ("number", "int32"), ("docs", "int64"), ("tokens", "int64")]))

        for batch in batches:
            own = batch.column(0).to_pylist()
            for lo, hi, ids, at in encode_texts(batch.column(1), tokens.encode, tokens.lengths, tokens.cache, SHARED_BYTES):
                doc_ids += own[lo:hi]
                counts += (np.diff(at) + 1).tolist()
                held.append(np.insert(ids, at[1:], end_id))
                if sum(map(len, held)) >= VALUES_A_FILE:
                    yield written()
        if doc_ids:
            yield written()

    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Equal ids may fill more than one range, hence the hash.
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    return cut(map_arrow(ordered, tasks, "path string, part int, number int, docs long, tokens long", vocabularies=True))


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the listed files: doc_id, start (ids of all documents before it)
    and ids (binary: all its ids as little-endian uint32)."""
    by_part = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = by_part.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("_before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    listed = files.withColumn("_within", within).join(before, "part")
    count = max(1, files.count())

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place) as file:
                    doc_ids, counts, ids = parse_file(file.read())
                ends = bounds(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(start + ends[:-1]),
                    pa.Array.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]),
                ], names=["doc_id", "start", "ids"])

    spread = listed.select("path", (F.col("_before") + F.col("_within")).alias("start")).repartition(count)
    return map_arrow(spread, tasks, "doc_id long, start long, ids binary")
