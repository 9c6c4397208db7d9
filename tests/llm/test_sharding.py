import hashlib

from pyspark.sql import functions as F

from opquality.llm.sharding import find_splitters, histogram_sort


def expected(rows, shards):
    key = lambda r: (int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16), -(2**63) if r[0] is None else r[0])
    size = lambda r: len((r[1] or "").encode()) + 1
    rows, below, out, slots = sorted(rows, key=key), 0, [], {}
    total = sum(map(size, rows))
    for r in rows:
        shard = sum(shards * below >= total * n for n in range(1, shards))
        out.append((r[0], size(r), shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        below += size(r)
    return sorted(out, key=str)


def test_shards_follow_the_bytes(make, prose):
    rows = prose + [(1000 + n, "one hot text of a third of all rows") for n in range(60)] + [(5000, None), (None, ""), (-7, "é" * 5000)]
    for shards in (1, 3, 8):
        out = histogram_sort(make(rows, "size", "shard", "slot", "_k", "_I", "_part", "_n"), shards=shards)
        assert out.columns == ["doc_id", "text", "_k", "_I", "_part", "_n", "size", "shard", "slot"]
        assert {(r._k, r._I, r._part, r._n) for r in out.collect()} == {("own",) * 4}
        assert sorted(((r.doc_id, r["size"], r.shard, r.slot) for r in out.collect()), key=str) == expected(rows, shards)


def test_rows_equal_in_all_stay_together(make):
    out = histogram_sort(make([(1, "same")] * 40 + [(2, "other")] * 3), shards=4).collect()
    assert len(out) == 43 and len({r.shard for r in out if r.doc_id == 1}) == 1
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_empty_and_tiny_tables(make):
    assert histogram_sort(make([])).collect() == []
    assert [(r.shard, r.slot) for r in histogram_sort(make([(1, "a")])).collect()] == [(0, 0)]


def test_tolerance_stops_the_probes_early(spark):
    slim = spark.createDataFrame([(n << 40, n, 10) for n in range(1000)], "k long, i long, s long")
    exact = find_splitters(slim, [2500, 5000], 0)
    assert [c.bytes_below for c in exact] == [2500, 5000]
    near = find_splitters(slim, [2505, 5003], 200)
    assert all(abs(c.bytes_below - t) <= 200 and c.rows_below * 10 == c.bytes_below for c, t in zip(near, [2505, 5003]))


def test_each_range_is_a_task(make, prose):
    out = histogram_sort(make(prose), shards=2, range_bytes=2000)
    total = sum(len(t.encode()) + 1 for _, t in prose)
    # Rows and bytes of each partition of the result, which no exchange follows.
    sizes = out.groupBy(F.spark_partition_id()).agg(F.sum("size").alias("bytes")).collect()
    assert len(sizes) > 8 and max(r.bytes for r in sizes) <= total / (2 * max(8, -(-total // 4000))) + max(len(t.encode()) + 1 for _, t in prose)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_a_very_long_text_is_one_row(make):
    rows = [(n, "short") for n in range(20)] + [(50, "é" * 3_000_000)]
    out = histogram_sort(make(rows), shards=3)
    assert sorted(((r.doc_id, r["size"], r.shard, r.slot) for r in out.drop("text").collect()), key=str) == expected(rows, 3)
