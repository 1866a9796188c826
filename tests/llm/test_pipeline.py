"""The pipeline against its stages' own brute-force rules on the small documents table."""

import random
import re

import corpus_pipeline
from spanloom.llm import nearcopies, quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, "").write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        ids = {r.doc_id for r in after.select("doc_id").distinct().collect()}
        if i == 0:
            assert ids == kept
        if i == 1:
            assert ids == {r.class_id for r in nearcopies.join_classes(before).collect()}
        if i == 2:
            assert ids == {r.doc_id for r in before.select("doc_id").collect()}
            assert not any(re.search(r"AKIA[A-Z0-9]{16}", r.text) for r in after.collect())
        if i < 4:
            assert after.columns == columns, name
        before = after
    pieces = before.collect()
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(sum(n for _, n in v) <= 2048 and sorted(v)[0][0] == 0 for v in by.values())
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, pieces))


def nasty(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(60) for _ in range(12)]
    texts = [
        None, "", " \t", "one", *base, base[0], base[1], base[1] + " more", f"{text(40)} password = hunter2222", text(9000),
        text(40) + "\n" + "same line\n" * 30, "### " * 200
    ]
    rows = [
        (
            None if i == 7 else i % 19, t, None if i % 6 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}",
            None if t is None else len(t), f"n{i}", i
        ) for i,
        t in enumerate(texts)
    ]
    return spark.createDataFrame(
        [*rows, rows[5], rows[5]], "doc_id long, text string, lang string, source string, n_chars long, node string, rank int"
    ).repartition(3)


def test_stages_on_what_goes_wrong(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, one id with several texts and clashing columns through all five stages."""
    before = nasty(spark)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = before.columns
        stage(spark, before, "").write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert after.columns == columns, name
        if name == "quality rules":
            kept = after.collect()
            assert all(len((r.text or "").split()) >= 20 for r in kept) and len(kept) < before.count()
        if name == "n-gram Jaccard join":
            texts = [r.text for r in after.collect()]
            assert len(texts) == len(set(texts)) or any(r.doc_id is None for r in after.collect())
            assert {r.text for r in before.collect() if r.doc_id is None} <= set(texts)
        if name == "secret scans":
            assert not any("hunter2222" in r.text for r in after.collect()) and after.count() == before.count()
        before = after
    assert before.count() > 0


def test_stages_on_an_empty_table(spark):
    empty = nasty(spark).filter("false")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, empty, "").count() == 0
