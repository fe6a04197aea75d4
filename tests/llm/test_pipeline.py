"""The pipeline's stages on a small made corpus, against what brute force keeps."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    rnd = random.Random(1)
    syllables = {"aa": "bal dor mik tan sul per".split(), "bb": "xyo qwi zzu vyx kwo uyi".split()}
    make = lambda lang, n: " ".join("".join(rnd.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(("aa", "bb")[i % 2], 120), ("aa", "bb")[i % 2]) for i in range(60)]
    item = make("aa", 30)
    w = rows[4][1].split()
    w[60] = "doranew"
    extra = [(100, rows[2][1].replace(" ", "  "), "aa"), (101, " ".join(w), "aa"), (102, f"{rows[6][1]} {item}", "aa"), (103, "1234 !!", "aa"), (104, None, "aa")]
    docs = spark.createDataFrame([(i, t, la, "s", len(t or "")) for i, t, la in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, sf), name)
        assert tuple(now.columns) == corpus_pipeline.COLUMNS
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
    everything = {r[0] for r in rows + extra}
    assert kept["language-id"] == everything - {103, 104}
    assert kept["exact-dedup"] == everything - {103, 104, 2}  # 100 has more code points
    assert kept["simhash-near-dedup"] == kept["exact-dedup"] - {101} or kept["simhash-near-dedup"] == kept["exact-dedup"] - {101, 102}
    assert kept["benchmark-decontamination"] == kept["simhash-near-dedup"] - {102}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == kept["benchmark-decontamination"] and len(corpus_pipeline.STAGES) == 5
    assert all(0 < r["length"] <= 4096 and r["offset"] + r["length"] <= 4096 for r in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, sf, rows, items):
    spark.createDataFrame([(i, t, la, "s", len(t or "")) for i, t, la in rows], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return corpus_pipeline.run(spark, sf).collect()


def test_pipeline_of_nothing(spark, tmp_path):
    assert run(spark, str(tmp_path / "a"), [], []) == []
    assert run(spark, str(tmp_path / "b"), [(1, None, None), (2, "", "aa"), (None, "12 !", "aa")], [(1, "x")]) == []


def words(seed, n, kinds="aa"):
    rnd, parts = random.Random(seed), {"aa": "bal dor mik tan sul per", "bb": "xyo qwi zzu vyx kwo uyi"}[kinds].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(n))


def test_pipeline_without_a_benchmark_keeps_all_clean_rows(spark, tmp_path):
    rows = [(i, words(i, 80), "aa") for i in range(40)]
    out = run(spark, str(tmp_path), rows, [])
    assert sorted(r["doc_id"] for r in out) == list(range(40))


def test_pipeline_tells_null_and_repeated_ids_apart(spark, tmp_path):
    """Rows go by their texts: a null id, or one that two texts share, takes no other row with it."""
    rows = [(i, words(i, 80, ("aa", "bb")[i % 2]), ("aa", "bb")[i % 2]) for i in range(40)]
    item = words(999, 30)
    rows += [(None, words(100, 80), "aa"), (None, words(101, 80), "aa"), (None, words(100, 80), "aa"), (7, words(102, 80), "aa"), (None, f"{words(103, 60)} {item}", "aa"), (8, f"{words(104, 60)} {item}", "aa"), (9, rows[9][1], "bb"), (10, rows[10][1].replace(" ", "  "), "aa")]
    out = run(spark, str(tmp_path), rows, [(1, item), (None, item), (2, None)])
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out)
    # both texts of id 7, one text of 8 and none of the null one that hold the item; rows that repeat an id and its text all stay (9, 10, null)
    assert ids == sorted([(True, i) for i in range(40)] + [(True, 7), (True, 9), (True, 10), (False, 0), (False, 0), (False, 0)])
    assert all(r["piece"] == 0 and r["start"] == 0 for r in out)


def test_stages_give_python_small_batches(spark, tmp_path, monkeypatch):
    """Texts of 24 MB in one partition, 200 rows: by Spark's own limits one batch, which fills an executor's memory beside its heap."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 200, 1, 1).selectExpr("id as doc_id", "repeat('bal dor mik ', 10000) as text", "'aa' as lang", "'s' as source", "120000L as n_chars")

    def sizes(docs, *_):
        def each(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({c: [1 if c == "doc_id" else b.nbytes if c == "n_chars" else 0 if c == "rejected" else "x"] for c in (*corpus_pipeline.COLUMNS, "rejected")})

        return docs.mapInArrow(each, "doc_id long, text string, lang string, source string, n_chars long, rejected long").withColumn("rejected", corpus_pipeline.language.F.col("rejected") > 0)

    monkeypatch.setattr(corpus_pipeline.language, "fit", lambda docs: None)
    monkeypatch.setattr(corpus_pipeline.language, "identify", sizes)
    for module, name in ((corpus_pipeline.simhash, "drop_near_copies"), (corpus_pipeline.benchmark, "drop_contaminated"), (corpus_pipeline.packing, "pack_documents")):
        monkeypatch.setattr(module, name, lambda docs, *_, **__: corpus_pipeline.stored(sizes(docs), "sizes"))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    for name, stage in corpus_pipeline.STAGES:
        if name != "exact-dedup":  # all in the JVM
            found = [r["n_chars"] for r in stage(spark, docs, "").collect()]
            assert sum(found) > 20_000_000 and max(found) < 6_000_000, name
        assert spark.conf.get(key, None) is None
    spark.conf.set(key, "1m")  # the session's own limit stays
    try:
        with corpus_pipeline.small_batches(spark):
            assert spark.conf.get(key) == "1m"
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
