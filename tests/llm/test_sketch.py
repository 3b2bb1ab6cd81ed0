"""The n-gram join's sketch is summed without an RDD, whose functions need a second Python worker in each task."""

import numpy as np
from pyspark.sql import functions as F

from vidtables.llm import ngram_join


def test_counts_of_all_partitions_by_tables_alone(spark, monkeypatch):
    def refused(self):
        raise AssertionError("a second Python worker")

    docs = spark.range(0, 400, 1, 20).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[((F.col("id") * k) % 7).cast("string") for k in range(1, 9)]).alias("text"))
    texts = docs.select("text").toArrow()
    counts = np.zeros(1 << 10, np.int64)
    for _, x in ngram_join.set_rows(texts.select(["text", "text"]).rename_columns(["a", "b"]).combine_chunks().to_batches()[0], 5):
        np.add.at(counts, ngram_join.cell_of(x, 1 << 10), 1)
    expected = np.empty(1 << 10, np.int32)
    expected[np.argsort(counts, kind="stable")] = np.arange(1 << 10, dtype=np.int32)
    monkeypatch.setattr(type(docs), "rdd", property(refused))
    assert counts.sum() > 0 and ngram_join.GroupedPrefixJoin(docs, cells=1 << 10).ranks() == expected.tobytes()
