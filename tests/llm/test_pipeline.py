"""The pipeline's stages on a small fixture, against what must stay and go."""

import corpus_pipeline
from sightline.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, difference

PASSAGE = " ".join(f"word{i}" for i in range(60))


def test_stages(spark, tmp_path):
    clean = " ".join(f"clean{i}" for i in range(40))
    item = " ".join(f"item{i}" for i in range(30))
    rows = [(1, clean), (2, clean), (3, "12 34"), (4, "alpha " * 2 + PASSAGE), (5, "beta other start " + " ".join(f"own{i}" for i in range(90)) + " " + PASSAGE), (6, "see " + item + " end"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        left[name] = sorted({r.doc_id for r in now.select("doc_id").collect()})
    assert left["language_id"] == [1, 2, 4, 5, 6]
    assert left["near_duplicates"] == [1, 4, 5, 6]
    assert left["substring_dedup"] == [1, 4, 5, 6]
    assert left["benchmark_decontamination"] == [1, 4, 5]
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == [1, 4, 5]


def test_sql(spark, small):
    con = connect(small)
    for name, sql in ORACLES.items():
        assert not difference(spark, small, con, QUERIES[name], sql)
