import itertools
import zlib

from pyspark.sql import functions as F

from tabloom.llm import sharding


def test_curve_steps_to_neighbours():
    for n, bits in ((1, 3), (2, 4), (3, 4)):
        places = sorted((sharding.hilbert_distance(p, bits), p) for p in itertools.product(range(1 << bits), repeat=n))
        assert [p for p, _ in places] == list(range(1 << bits * n))
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in itertools.pairwise(places))


def test_rows_law(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.shard_documents(docs).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(got.doc_id) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got.itertuples())
    sizes = got.groupby("shard").size()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    runs = got.sort_values(["shard", "slot"]).hilbert
    assert runs.is_monotonic_increasing


def test_shards_prune(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.hilbert_shards(docs, 16)
    per = got.groupBy("shard").agg(F.count_distinct("lang").alias("l"), F.count_distinct("source").alias("s")).toPandas()
    assert per.l.mean() < 2.5 and per.s.mean() < 10


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", 0, 2), (1, "", "en", "a", 0, 2), (2, "x" * 200_000, "de", None, -7, 3), (3, "é", "de", "b" * 100, 2**62, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot int")
    got = sharding.shard_documents(df).collect()
    assert len(got) == 5 and sorted(r["shard"] for r in got) == [0, 4, 9, 14, 19]
    assert {r["size"] for r in got if r["doc_id"] is None} == {8}
    assert sharding.hilbert_shards(df, 2).columns == ["doc_id", "text", "lang", "source", "n_chars", "hilbert", "shard", "slot"]
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_cells(spark):
    """Cells hold about equal numbers of rows whatever the values' common beginnings; NULLs are lowest; order is kept."""
    rows = spark.range(4000).selectExpr("'http://a-very-long-common-beginning.example/of/all/values/in/this/column/' || lpad(id, 6, '0') as a", "case when id % 4 = 0 then null else id end as b")
    got = sharding.with_hilbert(rows, ["a"]).toPandas()
    assert got.groupby("hilbert").size().between(249, 251).all() and len(set(got.hilbert)) == 16
    assert got.sort_values("a").hilbert.is_monotonic_increasing
    b = sharding.with_hilbert(rows, ["b"]).toPandas()
    assert set(b[b.b.isna()].hilbert) == {0} and b[b.b.notna()].hilbert.min() == 4
    assert b[b.b.notna()].sort_values("b").hilbert.is_monotonic_increasing

def test_boundaries_of_all_rows(spark):
    """Quantiles of every row of a table beyond any sample: a hot value, NULLs, texts and numbers."""
    rows = spark.range(50_000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else 'v' || pmod(xxhash64(id), 20011) end as value", "pmod(xxhash64(id, 1), 1000003) as rows")
    got = sharding.boundaries(rows, ["value", "rows"], 16)
    for d in ("value", "rows"):
        every = sorted((r[d] is not None, r[d] or "") for r in rows.select(d).collect())
        want = [every[len(every) * k // 16][1] for k in range(1, 16) if every[len(every) * k // 16][0]]
        assert sorted(got[d]) == want


def test_clashing_names(spark):
    names = ["_salt", "salt", "row", "start", "total", "rank", "_rank", "_c0", "_v0"]
    df = spark.createDataFrame([(i, "en", "s", i, *names) for i in range(30)], "doc_id long, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    got = sharding.hilbert_shards(df, 4)
    assert got.columns == [*df.columns, "hilbert", "shard", "slot"]
    assert all(tuple(r)[4 : 4 + len(names)] == tuple(names) for r in got.collect())


def test_write(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(sharding.hilbert_shards(docs, 4), path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4
