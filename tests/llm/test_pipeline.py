import corpus_pipeline
from tabloom.llm import decontam, mixing
from tabloom.sources.files import materialise

from test_decontam import brute as hits
from test_minhash import brute as groups


def test_stages(spark, sf):
    """Each stage on what the one before kept, against plain versions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)

    judged = materialise(steps["quality classifier"](spark, docs, sf))
    before = {r["doc_id"]: r["text"] for r in judged.collect()}
    assert judged.columns == columns and 0.5 * docs.count() < len(before) <= docs.count()

    dedup = materialise(steps["near-duplicates"](spark, judged, sf))
    texts = {r["doc_id"]: r["text"] for r in dedup.collect()}
    assert texts == {k: before[k] for k, g in groups(before, 5, 4, 5).items() if g[2]}

    clean = materialise(steps["benchmark decontamination"](spark, dedup, sf))
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    for k, t in texts.items():
        n, hit, _ = hits(t, items, decontam.WINDOW)
        assert (k in after) == (hit <= decontam.COVERAGE * n)
        if k in after:
            assert after[k] == t if not hit else after[k] != t and hits(after[k], items, decontam.WINDOW)[1] < hit
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    mix = materialise(steps["source mixing"](spark, clean, sf))
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.mix_documents(clean).collect()}
    assert mix.columns == columns and mix.count() == sum(taken.values())

    out = steps["sharding"](spark, mix, sf)
    sizes = out.groupBy("shard").count().collect()
    assert len(sizes) == 24 and max(s["count"] for s in sizes) - min(s["count"] for s in sizes) <= 1
    assert out.columns == [*columns, "hilbert", "shard", "slot"]


def test_run(spark, sf):
    a, b = (sorted((r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, sf).collect()) for _ in range(2))
    assert a == b and a


def write(spark, folder, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return f"file://{folder}"


def test_odd_rows(spark, tmp_path):
    """NULLs in every column, empty and very long texts, ties, repeated rows, clashing columns; labels and benchmark with odd rows."""
    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(30)]
    rows = [(i, t, "en", "a" if i % 3 else None, len(t)) for i, t in enumerate(words)]
    rows += [(0, words[0], "en", None, len(words[0])), (100, words[1], "en", "a", None), (101, None, None, None, None), (102, "", "de", "b", 0), (None, "solo text", "en", "a", 9), (103, "long " * 200_000, "en", "b", 10**6), (104, words[2] + " tail", None, "b", 1)]
    more = ["_n", "rate", "hit_row", "salt", "rank", "accepted", "kept", "copies"]
    docs = spark.createDataFrame([(*r, *more) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, words[5]), (2, None), (None, "")], "item_id long, text string")
    sf = write(spark, tmp_path, docs, labels, bench)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = materialise(stage(spark, kept, sf))
        assert kept.columns == docs.columns, name
        if name == "near-duplicates":
            ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
            assert ids == [-1, *range(30), 101, 102, 103]  # 100 and 104 are copies of 1 and 2, and 0 came twice
        if name == "benchmark decontamination":
            assert 5 not in {r["doc_id"] for r in kept.collect()}
    assert {tuple(r)[5:] for r in kept.collect()} == {tuple(more)}
    out = corpus_pipeline.run(spark, sf).collect()
    sizes = [sum(r["shard"] == s for r in out) for s in {r["shard"] for r in out}]
    assert len(out) == kept.count() and max(sizes) - min(sizes) <= 1


def test_empty_tables(spark, sf, tmp_path):
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    empty = write(spark, tmp_path / "a", docs.limit(0), labels, bench)
    assert corpus_pipeline.run(spark, empty).count() == 0
    bare = write(spark, tmp_path / "b", docs, labels.limit(0), bench.limit(0))
    judged = corpus_pipeline.judged(spark, docs, bare)
    assert judged.count() == docs.count() == corpus_pipeline.decontaminated(spark, docs, bare).count()


def test_cells_of_all_rows(spark, sf):
    """The last stage's cells hold equal numbers of rows on a table larger than any sample."""
    docs = spark.range(32_000).selectExpr("id as doc_id", "'' as text", "'en' as lang", "'a' as source", "id as n_chars")
    sizes = corpus_pipeline.sharded(spark, docs, sf).groupBy("hilbert").count().collect()
    assert [s["count"] for s in sizes] == [2000] * 16
