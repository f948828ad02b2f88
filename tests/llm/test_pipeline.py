from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import frame, messy


def test_stages_in_a_row(spark, tmp_path):
    docs = frame(spark).withColumn("_taken", F.lit("mine")).withColumn("hit", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = Counter(tuple(r) for r in docs.collect())
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            after = Counter(tuple(r) for r in docs.collect())
            assert set(after) <= set(before)
            assert k == 3 or not after - before
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]


def test_empty_table(spark, tmp_path):
    frame(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_copy_of_each_group_stays(spark):
    rows = messy()
    out = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, frame(spark, rows), ""), "")
    assert out.count() < len(rows)
