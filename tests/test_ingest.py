"""Streaming ingestion: claims by state, failures, and each document once."""

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import ingest as I

CHUNKS = "chunk_id string, document_id string, chunk_index int, content string"


def submit(spark, folder, rows):
    spark.createDataFrame(rows, I.SUBMITTED).coalesce(1).write.mode("append").parquet(folder)


def cut(docs):
    """Sentences as chunks."""
    return docs.select("id", F.posexplode(F.filter(F.split("content", r"\. *"), lambda s: s != "")).alias("chunk_index", "content"))


def models():
    """Stand-ins for models; nested, so that workers get them by value."""

    def embed(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no embedding for this")
        return [[float(len(t))] for t in texts]

    def extract(texts):
        return [f"entity<|#|>{t.split()[0]}<|#|>T<|#|>d" for t in texts]

    return embed, extract


def follow(spark, tmp, cutter=cut):
    I.ingest(spark, str(tmp / "in"), str(tmp / "out"), cutter, *models()).awaitTermination(90)


def run(spark, tmp):
    follow(spark, tmp)
    return {r["id"]: (r["status"], r["attempt"], r["chunk_count"], r["entity_count"], r["batch"]) for r in I.statuses(spark, str(tmp / "out")).collect()}


def test_each_document_once_whatever_fails(spark, tmp_path):
    submit(spark, str(tmp_path / "in"), [("a", "one. two. three"), ("b", "some poison. here"), ("c", None), ("a", "one. two. three"), (None, "nobody's")])
    broken = tmp_path / "broken"
    broken.touch()

    def cut_or_break(docs):
        if broken.exists():
            raise OSError("the batch fails after its claims")
        return cut(docs)

    with pytest.raises(Exception, match="the batch fails"):
        follow(spark, tmp_path, cut_or_break)
    broken.unlink()
    first = run(spark, tmp_path)
    assert {k: v[:4] for k, v in first.items()} == {"a": ("COMPLETED", 1, 3, 3), "b": ("FAILED", 1, 0, 0), "c": ("COMPLETED", 1, 0, 0)}
    submit(spark, str(tmp_path / "in"), [("a", "changed"), ("d", "new. text")])  # a is complete already
    second = run(spark, tmp_path)
    assert second["a"] == first["a"] and second["d"][:4] == ("COMPLETED", 1, 2, 2) and second["b"] == first["b"]
    submit(spark, str(tmp_path / "in"), [("b", "again")])  # the least text of an id counts
    third = run(spark, tmp_path)
    assert third["b"][:4] == ("COMPLETED", 1, 1, 1) and third["a"] == first["a"]
    chunks = I.current(spark, str(tmp_path / "out"), "chunks", CHUNKS).collect()
    assert sorted((r["document_id"], r["chunk_index"], r["content"]) for r in chunks) == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "three"), ("b", 0, "again"), ("d", 0, "new"), ("d", 1, "text")]
    vectors = I.current(spark, str(tmp_path / "out"), "vectors", "chunk_id string, document_id string, vector array<double>")
    assert vectors.count() == 6


def test_leases_end(spark, tmp_path):
    """Claims without an outcome are given again, and at last as failed."""
    for name, rows, schema in (("in", [("a", "x"), ("b", "y")], I.SUBMITTED), ("done", [("b", 1, "COMPLETED", 0, 0, 0, None)], I.OUTCOME)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    claimed = []

    def once():
        streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("in", I.SUBMITTED), ("done", I.OUTCOME))]
        stream = I.claims(*streams, lease_ms=1, max_attempts=2)
        keep = lambda batch, _: claimed.extend(tuple(r) for r in batch.collect())
        I.started(stream, keep, str(tmp_path / "state")).awaitTermination(60)

    for k in range(4):
        once()
        spark.createDataFrame([(f"tick{k}", "")], I.SUBMITTED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    of = lambda name: [c[1:] for c in claimed if c[0] == name]
    assert of("a") == [(1, "PROCESSING"), (2, "PROCESSING"), (2, "FAILED")]
    assert of("b") == [(1, "PROCESSING")] or of("b") == of("a")  # its outcome came with, or before, its claim
