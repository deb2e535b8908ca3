"""Files, streaming claims."""

import hashlib
import io
import re
import zipfile

from pyspark.sql import functions as F

from graphloom.sources import files
from graphloom.streaming import claims


def test_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\n")
    (tmp_path / "b.md").write_text("one two\nthree\n")
    (tmp_path / "c.png").write_bytes(b"\x89PNG....")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.py").write_text("x")
    found = files.files(spark, str(tmp_path), ["*.py", "*.md"])
    assert sorted(r["name"] for r in found.collect()) == ["a.py", "b.md"]
    kinds = {r["name"]: r["kind"] for r in found.select("name", files.extractor(F.col("name")).alias("kind")).collect()}
    assert kinds == {"a.py": "code", "b.md": "text"}
    text = files.plain_text(spark, str(tmp_path / "b.md")).first()
    assert (text["word_count"], text["line_count"], text["character_count"]) == (3, 2, 13)
    assert {r["text"] for r in files.decoded(found).collect()} == {"import os\n", "one two\nthree\n"}


def test_claim_loop_processes_each_document_once(spark, tmp_path):
    src, target, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id string, text string"
    run = lambda: claims.claim_loop(spark, src, schema, target, cp, lambda b: b.select(F.col("id").alias("document_id"), F.upper("text").alias("text"))).awaitTermination()
    spark.createDataFrame([("1", "a"), ("2", "b")], schema).write.parquet(src)
    run()
    spark.createDataFrame([("2", "b"), ("3", "c")], schema).write.mode("append").parquet(src)
    run()
    assert sorted((r["document_id"], r["text"]) for r in spark.read.parquet(target).collect()) == [("1", "A"), ("2", "B"), ("3", "C")]


def test_metadata_of_files(spark, tmp_path):
    (tmp_path / "Report.final.MD").write_text("hello")
    (tmp_path / "hidden").write_text("x")
    rows = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("name", F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("hidden"), F.lit(".hidden")))
    more = F.when(F.col("name").startswith("R"), F.create_map(F.lit("title"), F.lit("T"), F.lit("size"), F.lit("from the extractor")))
    found = {r["name"]: r["metadata"] for r in files.metadata(rows, more).collect()}
    assert {k: found["Report.final.MD"][k] for k in ("originalFileName", "uploadedFileName", "contentType", "fileExtension", "size", "title")} == {"originalFileName": "Report.final.MD", "uploadedFileName": "Report.final.MD", "contentType": "text/markdown", "fileExtension": "md", "size": "from the extractor", "title": "T"}
    assert found["Report.final.MD"]["checksum"] == hashlib.sha256(b"hello").hexdigest() and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", found["Report.final.MD"]["uploadTimestamp"])
    assert (found[".hidden"]["fileExtension"], found[".hidden"]["contentType"], found[".hidden"]["size"]) == ("", "application/octet-stream", "1")


def test_properties_of_docx():
    core = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t"><dc:title>A title</dc:title><dc:creator>Ann</dc:creator><dc:subject></dc:subject><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("docProps/core.xml", core)
        z.writestr("docProps/app.xml", '<Properties xmlns="p"><Pages>7</Pages><Words>9</Words></Properties>')
    assert files.docx_properties(out.getvalue()) == {"title": "A title", "author": "Ann", "creationDate": "2024-01-02T03:04:05Z", "pageCount": "7"}
    assert files.docx_properties(b"no archive") == {}
