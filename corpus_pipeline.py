"""A corpus pipeline: each stage is written as Parquet and reread as the next one's documents.

Stages take and return the columns of documents; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opquality.llm.bpe import bpe_roundtrip
from opquality.llm.common import table, write_parquet
from opquality.llm.decontaminate import without_contaminated
from opquality.llm.fertility import kept_rows
from opquality.llm.jaccard_join import one_per_component
from opquality.llm.suffix_dedup import remove_repeats

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; a null, empty or wordless text is rejected, rows that are
    equal are judged alike, and an empty table stays empty."""
    return kept_rows(docs, {VOCABULARY: public_tokenizers.path(VOCABULARY)}, public_tokenizers.PATTERN)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of least id stays; of rows that share an
    id, or have none, each text is a document of its own, and one with an id goes first.
    A null or empty text is linked with nothing, and an empty table stays empty."""
    return one_per_component(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that occur earlier, in the order of the ids with a missing one first, are cut
    out of the texts; documents of which nothing is left, null and empty ones too, go. n_chars
    follows the text, other columns stay, and an empty table stays empty."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("n_bytes", "runs", "kept")}
    cut_out = remove_repeats(docs.withColumnsRenamed(aside), as_text=True).where(F.col("kept") != "")
    changed = cut_out.withColumns({"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")})
    return changed.select([F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go; each row is judged alone, a null or
    empty text stays, and an empty table or benchmark takes nothing out."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, and the hash of the bytes they decode to; a null or empty
    text has no ids."""
    coded = bpe_roundtrip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

# The first and the last stage call a tokeniser, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the result of the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_parquet(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
