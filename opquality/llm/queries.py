"""The queries of this folder's operators, in the columns that their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opquality.llm import language, toxicity
from opquality.llm.bpe import bpe_roundtrip
from opquality.llm.common import table, text_of, write_parquet
from opquality.llm.decontaminate import scan
from opquality.llm.fertility import quality
from opquality.llm.jaccard_join import jaccard_components
from opquality.llm.minhash import near_duplicates
from opquality.llm.sharding import histogram_sort
from opquality.llm.spelling import count_words, runs_of, spelling_variants, with_planted_deletions
from opquality.llm.suffix_dedup import remove_repeats
from opquality.llm.warc import assemble, page_id, write_warc
from opquality.llm.token_files import read_token_files, write_token_files
from opquality.llm.whitening import whiten


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = assemble(write_warc(table(spark, sf_dir, "pages")))
    # The payload is dropped here; what the records say of it stays.
    pages = captures.select("capture_id", "capture.type", "capture.payload_bytes", "capture.payload_digest", F.col("capture.refers_to").alias("refers_id"), page_id().alias("page_id"))
    pages = write_parquet(pages, "warc-pages")
    targets = pages.where("type = 'response'").groupBy(F.col("capture_id").alias("refers_id")).agg(F.max("page_id").alias("refers_to"))
    return pages.join(targets, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_sort(docs, shards=8).select(
        "doc_id", "size", F.crc32(text_of("text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


VOCABULARIES = {"byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, VOCABULARIES, public_tokenizers.PATTERN).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def _crc_of_id(divisor: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where((_crc_of_id(5) != 0) & F.col("toxic").isNotNull())
    prior = labels.agg(F.coalesce(F.avg(F.col("toxic").cast("double")), F.lit(0.0))).head()[0]
    model = toxicity.fit(docs.where(_crc_of_id(5) != 0), labels.where("toxic = 1"), prior)
    return toxicity.score(docs, model).select(
        "doc_id", (_crc_of_id(5) == 0).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(_crc_of_id(3) != 1))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (_crc_of_id(3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "ambiguous",
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(files).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_of(table(spark, sf_dir, "documents"), least_length=7)
    return spelling_variants(count_words(with_planted_deletions(runs, every=31), least_length=7, least_count=2), ratio=10)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened, model, error = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    each = whitened.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_histogram_sort": op3_histogram_sort,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_minhash": op13_minhash,
}

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BASE32 = " || ".join(f"lpad(to_base(cast('0x' || substr(h, {n}, 5) AS BIGINT), 32), 4, '0')" for n in range(1, 41, 5))

SPACED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
CRC_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"



def _linked_sql(percent: int, more: str = "") -> str:
    """Components of documents that link at this percentage."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACED} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
reached AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id{more}
FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS keep FROM p GROUP BY h)
SELECT page_id, payload_bytes, translate(upper({BASE32}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM p JOIN k USING (h)""",
    "op2_decontaminate": f"""
WITH b AS (SELECT coalesce(cast(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bn AS (SELECT *, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bn),
d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
dn AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dn),
hits AS (SELECT doc_id, n, i, item FROM dw JOIN bw USING (n, g)),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op3_histogram_sort": f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {CRC_STEP})) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
b AS (SELECT *, substr(md5(text), 1, 15) AS k, sum(size) OVER () AS total,
             coalesce(sum(size) OVER (ORDER BY substr(md5(text), 1, 15), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d),
s AS (SELECT *, cast(8 * below // total AS INTEGER) AS shard,
             list_transform(range(size - 1), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM b)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot, cast(NULL AS INTEGER) AS grown_shard
FROM s, crc""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(n - 99)) AS pos, h FROM d WHERE n >= 100),
k AS (SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 200)) AS name FROM p),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id, pos) AS place FROM k) WHERE place > 1),
marked AS (SELECT *, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100, -1) AS fresh FROM later),
numbered AS (SELECT *, sum(cast(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
runs AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 100 AS hi FROM numbered GROUP BY doc_id, run),
per_doc AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM runs GROUP BY doc_id),
edges AS (SELECT d.doc_id, h, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_prepend(0, coalesce(his, [])) AS starts, list_append(coalesce(los, []), n) AS ends
          FROM d LEFT JOIN per_doc USING (doc_id))
SELECT doc_id, n AS n_bytes, cast(n_removed AS BIGINT) AS n_removed, n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(starts) + 1), lambda i: substr(h, 2 * starts[i] + 1, 2 * (ends[i] - starts[i]))), ''))) AS kept_sha256
FROM edges""",
    "op8_jaccard_join": _linked_sql(75),
    "op11_spelling_variants": f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {CRC_STEP})) AS t),
r AS (SELECT coalesce(cast(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
l AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r WHERE length(run) >= 7),
c AS (SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS h FROM l GROUP BY id, run),
k AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                                         lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM c, crc),
p AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM k),
w AS (SELECT word, cast(sum(times) AS BIGINT) AS n FROM p WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
s AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM s),
pairs AS (SELECT x.word, y.word AS other, y.n FROM v x JOIN v y USING (i, a, b) WHERE x.word <> y.word
          UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.a || v.b
          UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.a || v.b),
near AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(other := other, n := n), struct_pack(d := -n, other := other)) AS best FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN best.other END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n
      FROM w LEFT JOIN near USING (word)),
led AS (SELECT word, word AS spot, 0 AS steps FROM f UNION ALL SELECT led.word, f.form, steps + 1 FROM led JOIN f ON f.word = led.spot WHERE f.form IS NOT NULL)
SELECT word, n, form, root, n_near, form_n FROM f JOIN (SELECT word, arg_max(spot, steps) AS root FROM led GROUP BY word) USING (word)""",
    "op13_minhash": _linked_sql(85, ", doc_id = component_id AS kept"),
}
