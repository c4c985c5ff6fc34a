"""Vectors kept by content."""

import numpy as np
from pyspark.sql import functions as F

from textprep.operators import retrieval, vector_store
from textprep.session import shared_path


def test_only_new_texts_are_encoded(spark):
    def loading():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], float).reshape(-1, 2)

    def failing():
        raise RuntimeError("no text is new, so no model is loaded")

    path, encoder = shared_path(spark, "store"), vector_store.Encoder("m-1", loading, batch_texts=3)
    rows = [(i, f"text {'a' * (i % 7)}") for i in range(50)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    first = {r["id"]: list(r["embedding"]) for r in vector_store.encoded(docs, path, encoder, "id").collect()}
    assert first == {i: [float(len(t or "")), float((t or "").count("a"))] for i, t in rows}
    assert vector_store.stored(spark, path, encoder).count() == 8  # seven texts and the empty one
    again = vector_store.encoded(docs, path, vector_store.Encoder("m-1", failing), "id")
    assert {r["id"]: list(r["embedding"]) for r in again.collect()} == first
    more = docs.unionByName(spark.createDataFrame([(99, "new a")], docs.schema))
    assert vector_store.unseen(more, path, encoder).select("text").collect() == [("new a",)]
    assert vector_store.encoded(more, path, encoder, "id").where("id = 99").first()["embedding"] == [5.0, 1.0]
    assert vector_store.unseen(docs, path, vector_store.Encoder("m-2", loading)).count() == 8  # another encoder
    assert vector_store.encoded(docs.where("false"), path, encoder, "id").count() == 0


def test_encoder_is_loaded_once_for_a_task(spark):
    def load():
        state = {"calls": 0}

        def run(texts):
            state["calls"] += 1
            return np.full((len(texts), 1), state["calls"], float)

        return run

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.range(20).coalesce(1).select("id", F.lit("x").alias("text"))
        found = retrieval.encode(df, "id", "text", load=load).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted({r["embedding"][0] for r in found}) == [1.0, 2.0, 3.0, 4.0]
