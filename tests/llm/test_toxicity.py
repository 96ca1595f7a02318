import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidemark.llm import toxicity
from tidemark.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    got = toxicity.query(spark, table(spark, SF, "documents"), table(spark, SF, "labels"))
    return got.join(table(spark, SF, "labels"), "doc_id").toPandas()


def test_accuracy_on_held_out_rows(scored):
    x = scored[scored.held_out]
    toxic, clean = x[x.toxic == 1], x[x.toxic == 0]
    assert len(toxic) > 50
    assert (x.predicted == x.toxic).mean() > 0.93
    assert toxic.predicted.mean() > 0.7
    assert clean.predicted.mean() < 0.02


def test_held_out_is_the_stated_fifth(scored):
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(scored.doc_id, scored.held_out))
    assert scored.score.between(0, 1).all()


def test_odd_texts_and_few_labels(spark, docs):
    df = docs(ODD).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.query(spark, df, labels).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1
    model = toxicity.fit_texts(["you absolute idiot"] * 9, ["a fine day"] * 9)
    assert toxicity.score(df, model).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.query(spark, docs([]), labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    texts = [f"word{i} again idiot here {i}" if i % 2 else f"word{i} again fine here {i}" for i in range(200)]
    rows = [(i, 1, i % 2) for i in range(200)]
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in rows]
    a, b = (toxicity.query(spark, docs(texts), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in (rows, flipped))
    assert a == b
