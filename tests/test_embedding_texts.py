"""Vectors made in batches equal those of single texts, and texts do not go to Python."""

from pyspark.sql import functions as F

from fieldledger.functions import embedding


def test_batches_equal_single_texts(spark):
    texts = ["", "a", "é\n", "x" * 5000, *[f"t{i}" for i in range(60)], None]
    docs = spark.createDataFrame([*enumerate(texts)], "i int, text string")
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))  # as the query does
    rows = docs.select("i", "text", embedding.embedded_texts(F.col("text")).alias("fast"), F.array_join(embedding.embedded("text").cast("array<string>"), ",").alias("slow")).collect()
    assert len(rows) == len(texts) and all(r["fast"] == r["slow"] for r in rows)
    assert rows[-1]["fast"] == rows[0]["fast"]
    exact = [int(x.scaleb(10)) for x in embedding.embed("t7")]
    assert next(r["fast"] for r in rows if r["text"] == "t7") == ",".join(map(str, exact))
