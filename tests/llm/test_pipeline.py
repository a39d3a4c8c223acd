"""The pipeline's stages on a small folder of tables."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and", "in"] * 20
    prose = lambda n=80: " ".join(rng.choice(vocabulary, n)).capitalize() + "."
    item = prose(30)
    rows = [(i, prose()) for i in range(60)]
    rows += [(100 + i, " ".join(x.upper() + "!! |" for x in rng.choice(vocabulary, 60))) for i in range(60)]
    rows += [(200, rows[0][1] + "\n" + "short"), (201, rows[1][1].replace("w1 ", "w2 ") + " end"), (202, prose() + " " + item + " " + prose()), (203, None), (204, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "cast(length(text) as bigint) AS n_chars", "1 AS h").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i, _ in rows if i % 3], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns and ids(out) <= ids(docs)
        if name == "quality":
            assert set(range(60)) <= ids(out) and not ids(out) & set(range(100, 160))
        if name == "line_dedup":
            assert out.filter("doc_id = 200").first().text == "short" and out.filter("doc_id = 200").first().n_chars == 5
        if name == "near_dup":
            assert set(range(60)) <= ids(out)
        if name == "decontaminate":
            assert 202 not in ids(out) and set(range(60)) <= ids(out)
        out.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
    assert docs.filter(F.col("offset") == 0).count() == docs.agg(F.max("sequence_id") + 1).first()[0]


def test_near_duplicates_of_a_stage_keep_one(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(3, text), (1, text + " more"), (2, "other words that stand alone here"), (None, text), (4, None)], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(x for x in got if x) == [1, 2, 4] and None in got
