"""The corpus pipeline, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from domloom.llm import decontaminate, minhash
from domloom.llm._store import durable, written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, durable(stage(spark, docs, data), name)
        seen[name] = before, docs
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["minhash_near_dedup"]
    found = minhash.near_duplicates(before, shingle=5)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found.where("kept").collect()}
    before, after = seen["benchmark_decontamination"]
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontaminate.contamination(after, items).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(before, items).where("n_hit > 0").count() == before.count() - after.count()
    before, after = seen["sentencepiece"]
    assert after.count() == before.count() and after.where("NOT round_trip").count() == 0
    before, after = seen["quality_classifier"]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id")
    assert good.join(after, "doc_id", "left_anti").count() <= 0.05 * good.count()
    before, after = seen["line_dedup"]
    assert after.agg(F.sum(F.length("text"))).first()[0] < before.agg(F.sum(F.length("text"))).first()[0]


def test_run(spark, data):
    before = written()
    out = P.run(spark, data)
    assert written() == before + 1  # the last written stage, which out reads; all else is deleted
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"]
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    """Verdicts of the dropping stages go by row."""
    words = lambda tag, n=60: " ".join(f"{tag}{i}" for i in range(n))
    spark.createDataFrame([(1, words("item", 12))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [
        (None, "null clean " + words("a")), (None, "null hit " + words("item", 12) + words("b")),
        (7, "shared clean " + words("c")), (7, "shared hit " + words("item", 12) + words("d")), (8, "plain " + words("e")),
    ]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    texts = lambda df: sorted(" ".join(r.text.split()[:2]) for r in df.collect())
    out = P.benchmark_decontamination(spark, frame(rows), str(tmp_path))
    assert texts(out) == ["null clean", "plain e0", "shared clean"]

    same = words("copy")
    rows = [
        (3, same), (None, same), (5, same), (5, "other text " + words("f")), (9, "twice here " + words("g")), (9, "twice here " + words("g")),
        (None, "lone null " + words("h")), (None, "both null " + words("k")), (None, "both null " + words("k")), (None, None), (None, None),
    ]
    out = P.minhash_near_dedup(spark, frame(rows), str(tmp_path))
    got = sorted(((r.doc_id, r.text and " ".join(r.text.split()[:2])) for r in out.collect()), key=str)
    assert got == sorted([(3, "copy0 copy1"), (5, "other text"), (9, "twice here"), (None, "lone null"), (None, "both null"), (None, None), (None, None)], key=str)
