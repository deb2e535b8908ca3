"""Documents from files: routing by name, text with metadata, code, archives of text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import code, text
from graphloom.plans.session import findable

#: Which extractor takes which names. PDF and legacy DOC need libraries that a caller supplies.
EXTRACTORS = {"text": (".txt", ".md"), "pdf": (".pdf",), "docx": (".docx",), "doc": (".doc",)}


def extractor(name: Column) -> Column:
    out = F.when(code.is_code(name), "code")
    for kind, endings in EXTRACTORS.items():
        for ending in endings:
            out = F.when(F.lower(name).endswith(ending), kind).otherwise(out)
    return out


def files(spark: SparkSession, path: str, patterns: list[str] | None = None, max_bytes: int = 10 << 20) -> DataFrame:
    """Files below a folder with name and content: no .git, nothing over max_bytes, no binaries, names by patterns."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = found.filter((F.col("length") <= max_bytes) & ~F.contains("path", F.lit("/.git/"))).withColumn("name", name)
    if patterns:
        out = out.filter(F.col("name").rlike(text.glob_regex(patterns)))
    return out.filter(~code.is_binary(F.col("name"), F.substring("content", 1, 512)))


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, content and counts of characters, words and lines."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.rtrim(F.regexp_replace("value", r"\r\n?", "\n"), F.lit("\n")).alias("content"))
    return read.select("path", "content", F.length("content").alias("character_count"), text.word_count(F.col("content")).alias("word_count"), F.size(F.split("content", "\n")).alias("line_count"))


def decoded(files: DataFrame) -> DataFrame:
    """Text of code files by their detected encoding."""
    kind = code.encoding(F.col("content"))
    body = F.when(kind == "UTF-8", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", ""))
    for name in ("UTF-16BE", "UTF-16LE", "ISO-8859-1"):
        body = body.when(kind == name, F.regexp_replace(F.decode("content", name), "^﻿", ""))
    return files.withColumn("encoding", kind).withColumn("text", body)


#: Content types by ending; others are application/octet-stream.
CONTENT_TYPES = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "json": "application/json", "csv": "text/csv"}


def metadata(files: DataFrame, more: Column | None = None) -> DataFrame:
    """Files with a map of metadata: names, type, size, ending in lower case (none for a leading dot only), time in ISO form and
    checksum. What an extractor found (more: a map, or null) counts over these. A table without a contentType or
    modificationTime column has the type of the ending and no time."""
    ending = F.lower(F.regexp_extract("name", r"(?s)^.+\.([^.]*)$", 1))
    kind = F.lit("application/octet-stream")
    for end, value in CONTENT_TYPES.items():
        kind = F.when(ending == end, value).otherwise(kind)
    kind = F.coalesce(F.col("contentType"), kind) if "contentType" in files.columns else kind
    time = F.date_format(F.to_utc_timestamp(F.col("modificationTime").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if "modificationTime" in files.columns else F.lit(None).cast("string")
    own = {"originalFileName": F.col("name"), "contentType": kind, "size": F.col("length").cast("string"), "uploadedFileName": F.regexp_extract("path", r"([^/]*)$", 1) if "path" in files.columns else F.col("name"), "fileExtension": ending, "uploadTimestamp": time, "checksum": F.sha2("content", 256)}
    base = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    more = F.coalesce(more, F.expr("cast(map() AS map<string, string>)")) if more is not None else F.expr("cast(map() AS map<string, string>)")
    return files.withColumn("metadata", F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more))


def docx_properties(content: bytes) -> dict[str, str]:
    """What a DOCX archive says of itself: title, author, subject, creationDate, modificationDate and pageCount, where there."""
    names = {"title": "title", "creator": "author", "subject": "subject", "created": "creationDate", "modified": "modificationDate", "Pages": "pageCount"}
    out: dict[str, str] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for part in ("docProps/core.xml", "docProps/app.xml"):
                if part in z.namelist():
                    for e in ElementTree.fromstring(z.read(part)):
                        name = names.get(e.tag.rpartition("}")[2])
                        if name and e.text:
                            out[name] = e.text
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return {}
    return out


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX archive, by the standard library."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    ns = re.match(r"\{.*\}", root.tag)[0]
    return "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p"))


def extracted(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """Text by a Python extractor for each kind: (path, text). The caller may add ones for pdf and doc."""
    findable(files.sparkSession)
    by_kind = {"docx": docx_text} | (extractors or {})

    def run(batches):
        for batch in batches:
            rows = [by_kind[k](c) if k in by_kind and c is not None else None for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], ["path", "text"])

    return files.select("path", extractor(F.col("name")), "content").mapInArrow(run, "path string, text string")
