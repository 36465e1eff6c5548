"""What the toxicity operator holds of texts at once does not grow with the rows of a task."""

import numpy as np
import pyarrow as pa
import pytest
from fieldledger.llm import common, toxicity
from pyspark.sql import functions as F

LENGTH = 20_000


class Counting:
    """Gives each text the number of texts that are scored together."""

    def features(self, text):
        return [0.0] * toxicity.FEATURES

    def score(self, features):
        return np.full(len(features), float(len(features)))


@pytest.fixture
def docs(spark):
    before = spark.conf.get(common.BATCH_SETTING, None)
    spark.conf.unset(common.BATCH_SETTING)
    yield spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), LENGTH // 2).alias("text"))
    spark.conf.unset(common.BATCH_SETTING)
    if before is not None:
        spark.conf.set(common.BATCH_SETTING, before)


def test_long_texts_are_scored_in_small_batches(docs):
    """1,500 texts of one task, 30 MB, were one batch in Arrow, scored by the thousand."""
    scored = toxicity.apply(docs, Counting()).select("row.doc_id", F.length("row.text").alias("n"), "score").collect()
    assert sorted(r["doc_id"] for r in scored) == list(range(1500)) and {r["n"] for r in scored} == {LENGTH}
    assert max(r["score"] for r in scored) * LENGTH <= 1.1 * common.BATCH_BYTES


def test_learning_reads_texts_in_small_batches(spark, docs):
    toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    found = [r["n"] for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 1500 * LENGTH and max(found) <= 1.1 * common.BATCH_BYTES


def test_a_given_size_stays(spark, docs):
    spark.conf.set(common.BATCH_SETTING, "1m")
    common.small_batches(spark)
    assert spark.conf.get(common.BATCH_SETTING) == "1m"
