"""Training rows of the quality trees."""

from __future__ import annotations

from martloom.llm import quality


def test_an_id_on_many_rows_is_one_training_row(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "grow", lambda x, y: sizes.append(len(y)))
    rows = [(1, f"text {k % 7} of one id") for k in range(200)] + [(k, f"text of {k}") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, quality int")
    known = labels.filter(~quality.held_out(labels["doc_id"]))
    quality.train(docs, labels)
    assert sizes == [known.count()] and known.filter("doc_id = 1").count() == 1
