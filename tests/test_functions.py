"""Numeric goldens and small cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import code, extraction, html, similarity
from graphloom.functions import text as T
from graphloom.operators import chunking


def value(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string" if isinstance(v, str) or v is None else "binary" if isinstance(v, bytes | bytearray) else "double" for v in values.values()], strict=True)))
    return frame.select(column).first()[0]


@pytest.mark.parametrize("a, b, want", [("warren state home", "warren state home", 1.0), ("warren state home", "warren home", 2 / 3), ("", "", 0.0)])
def test_jaccard(spark, a, b, want):
    assert value(spark, T.jaccard(T.token_set(F.col("a")), T.token_set(F.col("b"))), a=a, b=b) == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("a, b, want", [("warren", "warran", 0.833), ("microsft", "microsoft", 0.889), ("abc", "xyz", 0.0), ("same", "same", 1.0)])
def test_edit_similarity(spark, a, b, want):
    assert value(spark, T.edit_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want, abs=1e-3)


def test_acronym_needs_two_words_and_skips_small_ones(spark):
    f = T.acronym(T.normal_name(F.col("a")), T.normal_name(F.col("b")))
    assert value(spark, f, a="MIT", b="Massachusetts Institute of Technology") == 1.0
    assert value(spark, f, a="M", b="Massachusetts") == 0.0


def test_acronym_pairs_stay_under_the_threshold(spark):
    f = similarity.name_score(F.col("a"), F.col("b"))
    assert value(spark, f, a="MIT", b="Massachusetts Institute of Technology") < 0.75


def test_score_gates(spark):
    f = similarity.score(F.col("a"), F.col("b"), F.col("ta"), F.col("tb"))
    assert value(spark, f, a="Apple Inc", b="Apple Inc", ta="ORG", tb="FRUIT") == 0.0
    assert value(spark, f, a="Warren State Home", b="Warren State Home", ta="ORG", tb="org") > 0.85
    assert value(spark, f, a="abcdefghijkl", b="zzzz " * 20, ta="ORG", tb="ORG") == 0.0


def test_names_and_tokens(spark):
    assert value(spark, T.extracted_name(F.col("a")), a='  "Alan   Turing" ') == "Alan Turing"
    assert value(spark, T.normal_name(F.col("a")), a=" São-Paulo  CITY! ") == "sopaulo city"
    assert value(spark, T.token_estimate(F.col("a")), a="abcde") == 2
    assert value(spark, T.word_count(F.col("a")), a="   ") == 1
    assert value(spark, T.name_uuid(F.col("a")), a="http://example.com/") == "0a300ee9-f9e4-5697-a51a-efc7fafaba67"


def test_html_decodes_entities_in_order(spark):
    assert value(spark, html.text(F.col("a")), a="<p>a &amp;lt; b</p><script>x<y</script> c") == "a < b c"
    assert value(spark, html.title(F.col("a")), a="<html><TITLE> T </TITLE>") == "T"


def test_tuple_repair_and_glued_records(spark):
    text = "entity<|#|>A<|#|>ORG<|#|>first{tuple_delimiter}entity{tuple_delimiter}B{tuple_delimiter}{tuple_delimiter}PERSON{tuple_delimiter}second\nentity|C|PLACE|third\nrelation{TUPLE_DELIMITER}A{tuple_delimiter}a{tuple_delimiter}k{tuple_delimiter}loop\nrelation{tuple_delimiter}A{tuple_delimiter}B{tuple_delimiter}k{tuple_delimiter} <|COMPLETE|>"
    frame = spark.createDataFrame([(1, text)], "id int, t string")
    entities, relations = extraction.parse_responses(frame, "id", "t")
    assert [(r["name"], r["type"]) for r in entities.orderBy("seq").collect()] == [("A", "ORG"), ("B", "PERSON"), ("C", "PLACE")]
    assert [(r["src"], r["tgt"], r["description"]) for r in relations.collect()] == [("A", "B", "RELATED_TO")]


def test_keywords_of_an_empty_high_line(spark):
    text = "HIGH_LEVEL_KEYWORDS:\nLOW_LEVEL_KEYWORDS: a, None, b"
    assert value(spark, extraction.keywords(F.col("a"), "LOW"), a=text) == ["a", "b"]
    assert value(spark, extraction.keywords(F.col("a"), "HIGH"), a=text) == ["low_level_keywords: a", "b"]


def test_code_detection(spark):
    f = code.detect(F.col("a"), F.col("b"))
    assert value(spark, f["language"], a="x.py", b="import os") == "python"
    assert value(spark, f["confidence"], a="x.py", b="import os") == 0.95
    assert value(spark, f["confidence"], a="x.py", b="hello") == 0.75
    assert value(spark, f["method"], a="x", b="") == "heuristic"
    assert value(spark, code.encoding(F.col("a")), a=bytearray(b"caf\xe9 au lait, beaucoup de texte")) == "ISO-8859-1"
    assert value(spark, code.is_binary(F.lit("x"), F.col("a")), a=bytearray(b"\x7fELF....")) is True


def test_declarations(spark):
    frame = spark.createDataFrame([(1, "import os\nclass A:\n    def m(self): pass\ndef f():\n    pass")], "id int, t string")
    assert [(r["line"], r["kind"], r["name"]) for r in code.declarations(frame, "id", "t", "python").collect()] == [(2, "class", "A"), (4, "function", "f")]


def test_sentence_chunks_overlap():
    text = " ".join(f"Sentence number {k} ends here." for k in range(40))
    chunks = chunking.by_sentence(text, 50, 10)
    assert len(chunks) > 3 and all(chunking.tokens(c) <= 62 for c in chunks)
    assert chunks[1].startswith(chunks[0][-40:].strip())
    assert chunking.by_sentence("", 10, 1) == []
    with pytest.raises(ValueError):
        chunking.by_sentence("x", 5, 5)


def test_code_chunks_keep_lines_and_scope():
    text = "class Big:\n" + "\n".join(f"    x{k} = {k}" for k in range(200))
    chunks = chunking.by_code(text, 50, 5)
    assert chunks[0][1] == 1 and chunks[-1][2] == 201 and {c[3] for c in chunks[1:]} == {"Big"}
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert b[1] <= a[2]


def test_window_slices_match_the_loop(spark):
    text = "abcdefghij" * 37
    assert value(spark, chunking.window_slices(F.col("a"), 20, 5), a=text) == chunking.slices(text, 20, 5)
